"""Queries over what a host shows beside its packets, over frames, models, settings and followed files; added to the registry of `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import config, schema
from flowlens.functions import network, pii, procfs, templates
from flowlens.operators import graph, host, ingest, joins, metrics, privacy, sessions, tokens
from flowlens.plans import fixtures
from flowlens.plans.fixtures import HOUR_NS, L7_SQL
from flowlens.plans.queries import ORACLES, _BASE, _EDGE_COLUMNS, _FLOWS, _PARSED, _STATS, _TEMPLATE, _as_stream, _drained, _reports, _stats, entity_sql, host_name, hourly, observations, query, state_partitions
from flowlens.session import materialize, shared_dir, spread, table
from flowlens.sinks import export
from flowlens.sources import capture
from flowlens.streaming import folds
from flowlens.streaming.held import use_keyed_state
from flowlens.streaming.pipeline import EdgeTable, edge_stream, flow_stream

_TIMED = "t AS (SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS tick, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


# ---- frames and routes ------------------------------------------------------------------------------------------

def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def frames(spark, sf) -> DataFrame:
    """A frame for each event: by its number IPv6, ICMP, empty, UDP or TCP."""
    e = F.col("event_id")
    kind, text = e % 5, F.concat(F.lit("u"), F.col("user_id").cast("string"))
    tcp = kind == 4
    payload = F.when(kind == 2, F.lit("")).otherwise(F.hex(text))
    size = F.length(payload) / 2 + F.when(tcp, 40).otherwise(28)
    rest = F.when(tcp, F.lit("0" * 16 + "50" + "0" * 14)).otherwise(F.lit("0" * 8))
    ip = F.concat(F.lit("4500"), _hex(size, 4), F.lit("0" * 8 + "40"), F.when(kind == 1, F.lit("01")).when(tcp, F.lit("06")).otherwise(F.lit("11")), F.lit("0000"), _hex(F.lit(0x0A000000) + e % 200, 8), F.lit("0A000002"))
    body = F.concat(ip, _hex(40000 + e % 1000, 4), F.lit("0050"), rest, payload)
    whole = F.concat(F.lit("0" * 24), F.when(kind == 0, F.concat(F.lit("86DD"), F.lit("0" * 120))).otherwise(F.concat(F.lit("0800"), body)))
    return table(spark, sf, "events").select("event_id", F.unhex(whole).alias("frame"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 6 ELSE 17 END AS ip_proto, 167772160 + event_id % 200 AS src_addr, 40000 + event_id % 1000 AS src_port, 80 AS dst_port, 'u' || user_id AS payload FROM events WHERE event_id % 5 IN (3, 4)")
def q_frames(spark, sf):
    return ingest.decode_frames(frames(spark, sf)).select("event_id", "ip_proto", "src_addr", "src_port", "dst_port", F.col("payload").cast("string").alias("payload"))


@query("SELECT count(*) AS frames, count(*) FILTER (event_id % 5 <> 0) AS ipv4, count(*) FILTER (event_id % 5 = 0) AS ipv6 FROM events")
def q_frame_counts(spark, sf):
    return ingest.frame_counts(frames(spark, sf))


@query("SELECT CASE WHEN event_type = 'signup' THEN 'starts' WHEN event_type = 'error' THEN 'ends' ELSE 'traffic' END AS route, count(*) AS n FROM events GROUP BY ALL")
def q_routes(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "ProcessExec").when(F.col("event_type") == "error", "ProcessExit").otherwise("TcPacket")
    parts = ingest.routed(table(spark, sf, "events").withColumn("event_type", kind))
    named = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("route"), "n") for name, p in zip(("starts", "ends", "traffic"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).filter("n > 0")


@query(f"WITH {_BASE} SELECT event_id AS socket_cookie, 'GET' AS method, 'user:' || n AS path FROM base")
def q_source_table(spark, sf):
    """The events source over a table format."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    fixtures.packets(spark, sf, "redis").write.parquet(path)
    return sessions.parse_sessions(ingest.with_session_key(capture.events_source(spark, "parquet", path))).select(F.col("session_key").alias("socket_cookie"), "method", "path")


@query(f"WITH {_TIMED} SELECT event_id FROM t WHERE user_id IN (3, 5, 8) AND k % 2 = 0")
def q_settings(spark, sf):
    settings = config.parse("pid_filter = [3, 5, 8]\nmax_events_per_sec = 0\n")
    rows = fixtures.base_events(spark, sf).select(
        "event_id", F.col("event_id").alias("seq"), "timestamp_ns", F.col("event_id").alias("socket_cookie"), F.lit("TcPacket").alias("event_type"), F.col("user_id").alias("pid"), F.col("user_id").alias("tgid"),
        F.lit(6).cast("short").alias("ip_proto"), F.when(F.col("k") % 2 == 0, 10).otherwise(0).cast("long").alias("payload_len"))
    return ingest.admitted(rows, settings, ["seq"]).select("event_id")


@query(f"WITH {_TIMED} SELECT event_id, CASE k % 4 WHEN 0 THEN k % 252 WHEN 1 THEN event_id % 65536 WHEN 2 THEN event_id * 7 % 16777216 ELSE event_id * 1000003 END AS value FROM t WHERE k % 5 <> 4")
def q_length_encoded(spark, sf):
    """Integers as the MySQL protocol writes them; where k % 5 is 4, the last byte is missing."""
    k, e = F.col("k"), F.col("event_id")
    little = lambda value, size: F.concat(*[_hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255)), 2) for i in range(size)])
    shown = F.when(k % 4 == 0, _hex(k % 252, 2)).when(k % 4 == 1, F.concat(F.lit("FC"), little(e % 65536, 2))).when(k % 4 == 2, F.concat(F.lit("FD"), little(e * 7 % 16777216, 3))).otherwise(F.concat(F.lit("FE"), little(e * 1000003, 8)))
    cut = F.when(k % 5 == 4, F.expr("left(shown, length(shown) - 2)")).otherwise(F.col("shown"))
    rows = fixtures.base_events(spark, sf).withColumn("shown", shown).select("event_id", network.length_encoded(F.unhex(cut)).alias("value"))
    return rows.filter("value is not null")


@query("SELECT doc_id, (SELECT md5(substr(text, 1, max(k))) FROM range(0, 102) r(k) WHERE strlen(substr(text, 1, k)) <= 101) AS digest FROM documents WHERE text IS NOT NULL")
def q_capped_text(spark, sf):
    rows = table(spark, sf, "documents").filter("text is not null")
    return rows.select("doc_id", F.md5(network.capped_text(F.col("text").cast("binary"), 101)).alias("digest"))


# ---- processes, TLS calls, libraries ----------------------------------------------------------------------------

@query("SELECT CASE event_type WHEN 'click' THEN 'SockConnect' WHEN 'view' THEN 'SockAccept' ELSE 'SockClose' END AS event_type, count(*) AS n FROM events GROUP BY ALL")
def q_socket_calls(spark, sf):
    kind = F.when(F.col("event_type") == "click", "UdpSend").when(F.col("event_type") == "view", "UdpRecv").otherwise("SockClose")
    return host.socket_events(table(spark, sf, "events").withColumn("event_type", kind)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_TIMED}, o AS (SELECT *, lead(event_type) OVER w AS following, lead(tick) OVER w AS next_at FROM t WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id))
SELECT user_id AS pid, 'p' || k AS comm, tick AS started_ns, CASE WHEN following = 'view' THEN next_at END AS ended_ns FROM o WHERE event_type = 'click'""")
def q_process_lifetimes(spark, sf):
    kind = F.when(F.col("event_type") == "click", "ProcessExec").when(F.col("event_type") == "view", "ProcessExit").otherwise("TcPacket")
    raw = F.concat(F.lit("p"), F.col("k").cast("string"), F.lit("\0\0rest")).cast("binary")
    rows = fixtures.base_events(spark, sf).select(kind.alias("event_type"), F.col("user_id").alias("pid"), F.col("user_id").alias("tgid"), F.lit(1).cast("long").alias("ppid"), network.c_string(raw).alias("comm"), "timestamp_ns", F.col("event_id").alias("seq"))
    return host.process_lifetimes(rows).select("pid", "comm", "started_ns", "ended_ns")


@query(f"""WITH {_TIMED}, o AS (SELECT *, event_type IN ('click', 'view') AS entry, lag(event_type IN ('click', 'view')) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS before FROM t)
SELECT event_id AS seq, user_id AS pid, tick AS timestamp_ns, 'TlsData' AS event_type, 0 AS socket_cookie, k AS payload_len FROM o WHERE NOT entry AND before AND k > 0""")
def q_tls_reads(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), "entry").otherwise("return")
    calls = fixtures.base_events(spark, sf).select(F.col("event_id").alias("seq"), "timestamp_ns", F.col("user_id").alias("pid"), F.col("user_id").alias("tgid"), kind.alias("kind"), F.col("k").alias("size"), F.lit(b"x").alias("payload"))
    return host.tls_reads(calls).select("seq", "pid", "timestamp_ns", "event_type", "socket_cookie", "payload_len")


@query(f"""WITH {_TIMED} SELECT event_id AS seq, user_id AS pid, tick AS timestamp_ns, 'Egress' AS direction, CASE WHEN k % 2 = 0 THEN 'OpenSsl' ELSE 'GoTls' END AS tls_library, k AS payload_len FROM t WHERE event_type IN ('click', 'view') AND k > 0""")
def q_tls_writes(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), "entry").otherwise("return")
    calls = fixtures.base_events(spark, sf).select(F.col("event_id").alias("seq"), "timestamp_ns", F.col("user_id").alias("pid"), F.col("user_id").alias("tgid"), kind.alias("kind"), F.col("k").alias("size"), F.lit(b"x").alias("payload"), F.when(F.col("k") % 2 == 0, "OpenSsl").otherwise("GoTls").alias("library"))
    return host.tls_writes(calls).select("seq", "pid", "timestamp_ns", "direction", "tls_library", "payload_len")


@query(f"WITH {_BASE} SELECT event_id + 1 AS pid, 'GET' AS method, 'user:' || n AS path, 'open_ssl' AS tls_library, CASE WHEN k % 7 = 0 THEN 'ERR no ' || k ELSE 'v' || k END AS payload_text FROM base")
def q_tls_messages(spark, sf):
    """Exchanges seen only by the TLS calls of a process: a write, and a read whose bytes are there when it returns."""
    rows = fixtures.packets(spark, sf, "redis").select((F.col("socket_cookie") + 1).alias("pid"), (F.col("socket_cookie") + 1).alias("tgid"), "timestamp_ns", (F.col("seq") * 3).alias("seq"), "direction", F.col("payload_len").alias("size"), "payload")
    writes = rows.filter("direction = 'Egress'").withColumns({"kind": F.lit("entry"), "library": F.lit("OpenSsl")})
    returns = rows.filter("direction = 'Ingress'").withColumn("kind", F.lit("return"))
    reads = returns.unionByName(returns.withColumns({"kind": F.lit("entry"), "seq": F.col("seq") - 1, "size": F.lit(0).cast("long")}))
    found = sessions.parse_sessions(ingest.with_session_key(host.tls_calls(reads.drop("direction"), writes.drop("direction"))))
    return found.select("pid", "method", "path", "tls_library", "payload_text")


def _maps(spark, sf) -> DataFrame:
    """The maps text of a process for each supplier: a program, a TLS library (mapped twice, and once not executable), an anonymous part."""
    k = F.col("s_suppkey")
    base = lambda n: F.lower(F.hex(k * 65536 + n * 4096))
    line = lambda n, perms, path: F.concat(base(n), F.lit("-"), base(n + 1), F.lit(f" {perms} 00000000 08:01 77 "), path)
    library = F.concat(F.lit("/usr/lib/libssl.so."), (k % 7).cast("string"))
    text = F.concat_ws("\n", line(1, "r--p", F.lit("/usr/lib/libssl.so.9")), line(2, "r-xp", F.lit("/usr/bin/app")), line(3, "r-xp", library), line(4, "r-xp", library), line(5, "rwxp", F.lit("[heap]")), F.lit("short line"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pid"), text.alias("content"))


_LIBRARIES = "libs AS (SELECT '/usr/lib/libssl.so.' || (s_suppkey % 7) AS path, min(s_suppkey) AS pid FROM supplier GROUP BY ALL)"


@query(f"WITH {_LIBRARIES} SELECT path, pid * 65536 + 3 * 4096 AS base, pid FROM libs")
def q_tls_libraries(spark, sf):
    return host.tls_libraries(_maps(spark, sf))


def _attached(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lit("/usr/lib/libssl.so."), (F.col("n_nationkey") % 5 + 4).cast("string")).alias("path")).distinct()


@query(f"WITH {_LIBRARIES} SELECT path FROM libs WHERE path NOT IN (SELECT '/usr/lib/libssl.so.' || (n_nationkey % 5 + 4) FROM nation)")
def q_new_targets(spark, sf):
    return host.new_targets(host.tls_libraries(_maps(spark, sf)), _attached(spark, sf)).select("path")


@query(f"WITH {_LIBRARIES} SELECT DISTINCT '/usr/lib/libssl.so.' || (n_nationkey % 5 + 4) AS path FROM nation WHERE '/usr/lib/libssl.so.' || (n_nationkey % 5 + 4) IN (SELECT path FROM libs)")
def q_still_attached(spark, sf):
    return host.still_attached(_attached(spark, sf), host.tls_libraries(_maps(spark, sf)))


@query("""SELECT p_partkey, p_partkey % 3 + 4 AS major, p_partkey % 12 AS minor, p_partkey % 200 AS patch, 'go1.' || (p_partkey % 30) || '.2' AS go_version, p_partkey % 30 >= 17 AS registers,
CASE WHEN (p_partkey % 3 + 4, p_partkey % 12) >= (5, 8) THEN CASE WHEN p_partkey % 2 = 0 THEN 'CAP_PERFMON' ELSE 'CAP_BPF,CAP_PERFMON,CAP_NET_ADMIN' END WHEN p_partkey % 2 = 0 THEN 'CAP_SYS_ADMIN' ELSE '' END AS missing, p_partkey % 4 = 0 AS mounted FROM part""")
def q_host_facts(spark, sf):
    k = F.col("p_partkey")
    shown = lambda c: c.cast("string")
    version = procfs.kernel_version(F.concat(F.lit("Linux version "), shown(k % 3 + 4), F.lit("."), shown(k % 12), F.lit("."), shown(k % 200), F.lit("-91-generic x.y")))
    status = F.concat(F.lit("Name:\tx\nCapEff:\t"), F.when(k % 2 == 0, F.lit("0000008000001000")).otherwise(F.lit("0000000000200000")), F.lit("\nCapBnd:\tff\n"))
    go = procfs.go_version(F.concat(F.lit("\x00\xffbuild go1.x go1."), shown(k % 30), F.lit(".2\x00path")))
    mounts = F.concat(F.lit("proc /proc proc rw 0 0\n"), F.when(k % 4 == 0, F.lit("none /sys/fs/bpf bpf rw 0 0")).otherwise(F.lit("none /sys/fs/bpf tmpfs rw 0 0")))
    rows = table(spark, sf, "part").select("p_partkey", version.alias("v"), procfs.effective_capabilities(status).alias("bits"), go.alias("go_version"), procfs.bpf_mounted(F.lit("/sys/fs/bpf/flowlens"), mounts).alias("mounted"))
    return rows.select("p_partkey", "v.*", "go_version", procfs.register_abi(F.col("go_version")).alias("registers"), F.array_join(procfs.missing_capabilities(F.col("v"), F.col("bits")), ",").alias("missing"), "mounted")


# ---- sessions ---------------------------------------------------------------------------------------------------

def _shared_sessions(spark, sf, protocol: str, pipelined: bool) -> DataFrame:
    """Eight exchanges on a connection: one after the other, or all requests before all responses."""
    n, part = F.col("socket_cookie"), F.col("seq")
    at = n % 8 * 1000 + part
    if pipelined:
        at = at + F.when(F.col("direction") == "Ingress", 1_000_000).otherwise(0)
    rows = fixtures.packets(spark, sf, protocol).withColumns({"timestamp_ns": at, "seq": n * 10 + part, "socket_cookie": F.floor(n / 8)})
    return ingest.with_session_key(rows)


@query(f"WITH {_BASE} SELECT event_id // 8 AS session_key, CAST(event_id % 8 - min(event_id % 8) OVER (PARTITION BY event_id // 8) AS BIGINT) AS msg_no, '/users/' || n || '/items/' || k AS path, 200 AS status, '{{\"item\": ' || k || '}}' AS payload_text, 2 AS latency_ns FROM base")
def q_parse_keepalive(spark, sf):
    return sessions.parse_sessions(_shared_sessions(spark, sf, "http1", False)).filter("error is null").select("session_key", "msg_no", "path", "status", "payload_text", "latency_ns")


@query(f"WITH {_BASE} SELECT event_id // 8 AS session_key, CAST(event_id % 8 - min(event_id % 8) OVER (PARTITION BY event_id // 8) AS BIGINT) AS msg_no, 'user:' || n AS path, CASE WHEN k % 7 = 0 THEN 'ERR no ' || k ELSE 'v' || k END AS payload_text FROM base")
def q_parse_pipelined(spark, sf):
    return sessions.parse_sessions(_shared_sessions(spark, sf, "redis", True)).filter("error is null").select("session_key", "msg_no", "path", "payload_text")


@query(f"WITH {_BASE} SELECT event_id AS session_key, CASE WHEN k % 2 = 0 THEN NULL ELSE 'GET' END AS method FROM base")
def q_session_close(spark, sf):
    """A close between request and response ends the session: the response has no request any more."""
    rows = fixtures.packets(spark, sf, "redis", marked=True)
    names = [c for c in rows.columns if c not in ("k", "answers")]
    at = F.col("seq") * 2

    def event(**other):
        return F.struct(*[other.get(c, F.col(c)).alias(c) for c in names])

    packet = event(seq=at, timestamp_ns=at)
    closes = event(seq=at - 1, timestamp_ns=at - 1, event_type=F.lit("SockClose"), payload=F.lit(None).cast("binary"))
    later = rows.select(F.inline(F.when(F.col("answers") & (F.col("k") % 2 == 0), F.array(closes, packet)).otherwise(F.array(packet))))
    return sessions.parse_sessions(ingest.with_session_key(later)).select("session_key", "method")


@query("SELECT r_regionkey AS session_key, 'stream overflow' AS error FROM region")
def q_session_overflow(spark, sf):
    """More bytes than a direction may hold before a message is whole: an error, and the session begins anew."""
    head = F.when(F.col("n") == 0, F.lit("*2\r\n$3\r\nGET\r\n$500000\r\n")).otherwise(F.lit(""))
    none = F.lit(0).cast("long")
    rows = table(spark, sf, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("n")).select(
        F.col("n").cast("long").alias("seq"), F.col("n").cast("long").alias("timestamp_ns"), F.col("r_regionkey").cast("long").alias("session_key"), F.lit("TcPacket").alias("event_type"), F.lit("Egress").alias("direction"),
        F.concat(head, F.repeat(F.lit("x"), 4096)).cast("binary").alias("payload"), none.alias("src_addr"), none.alias("dst_addr"), F.lit(40000).alias("src_port"), F.lit(6379).alias("dst_port"), none.alias("pid"), F.lit("None").alias("tls_library"))
    return sessions.parse_sessions(rows).filter("error is not null").select("session_key", "error").filter("error = 'stream overflow'")


@query("WITH s AS (SELECT event_type, count(DISTINCT user_id) AS live FROM events GROUP BY event_type) SELECT event_type, live, CASE WHEN live >= 47 THEN 'critical' WHEN live >= 40 THEN 'warning' ELSE 'ok' END AS level FROM s")
def q_capacity_level(spark, sf):
    live = table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("live"))
    return live.withColumn("level", sessions.capacity_level(F.col("live"), 50))


@query(f"""WITH RECURSIVE {_TIMED}, o AS (SELECT user_id, tick, max(event_id) AS event_id FROM t GROUP BY user_id, tick),
m(user_id, tick) AS (SELECT user_id, min(tick) FROM o GROUP BY user_id UNION ALL
  SELECT m.user_id, min(o.tick) FROM m JOIN o ON o.user_id = m.user_id AND o.tick >= m.tick + 86400000000000 GROUP BY m.user_id, m.tick)
SELECT o.user_id, o.tick AS timestamp_ns, 'n' || f.event_id AS memo FROM o ASOF JOIN m ON m.user_id = o.user_id AND m.tick <= o.tick JOIN o f ON f.user_id = m.user_id AND f.tick = m.tick""")
def q_identity_memo(spark, sf):
    rows = fixtures.base_events(spark, sf).groupBy("user_id", "timestamp_ns").agg(F.max("event_id").alias("e")).select("user_id", "timestamp_ns", F.concat(F.lit("n"), F.col("e").cast("string")).alias("name"))
    return joins.memoised(rows, ["user_id"], "name", 24 * HOUR_NS).select("user_id", "timestamp_ns", "memo")


# ---- personal data: models and services -------------------------------------------------------------------------

@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'IP_V4' WHEN 1 THEN 'DATE_OF_BIRTH' WHEN 2 THEN 'PERSON_NAME' WHEN 3 THEN 'AWS_KEY' WHEN 4 THEN 'EMAIL' END AS category FROM events""")
def q_category_names(spark, sf):
    names = F.array(*[F.lit(x) for x in ("ipv4", "Dob", "person_NAME", "AwsKey", "email", "nothing")])
    return table(spark, sf, "events").select("event_id", pii.category_of(F.get(names, (F.col("event_id") % 6).cast("int"))).alias("category"))


_PIECES = """v AS (SELECT DISTINCT piece FROM (
  SELECT substr(w, 1, n) AS piece FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part), range(1, 4) r(n) UNION ALL
  SELECT '##' || substr(w, 2 + n % 3, 1 + n) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 3 = 0), range(0, 4) r(n)) WHERE piece <> '' AND piece <> '##')"""


def _pieces(spark, sf) -> DataFrame:
    """A vocabulary from the parts' names: the beginnings of words, and pieces inside the words of every third name."""
    words = lambda rows: rows.select(F.explode(F.split("p_name", " ")).alias("w"))
    part = table(spark, sf, "part")
    head = words(part).select("w", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select(F.expr("substring(w, 1, n)").alias("piece"))
    rest = words(part.filter("p_partkey % 3 = 0")).select("w", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).select(F.concat(F.lit("##"), F.expr("substring(w, 2 + n % 3, 1 + n)")).alias("piece"))
    return head.unionByName(rest).filter("piece not in ('', '##')").distinct()


@query(f"""WITH RECURSIVE {_PIECES}, w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i, string_split(p_name, ' ') AS all_ FROM part),
o AS (SELECT p_partkey, word, i, CAST(list_sum(list_transform(all_[1:i - 1], lambda x: len(x) + 1)) AS BIGINT) AS base FROM w WHERE word <> ''),
c(word, pos, piece) AS (SELECT DISTINCT word, 0::BIGINT, '' FROM o UNION ALL
  SELECT word, n.pos, n.piece FROM (SELECT c.word, c.pos + len(v.piece) - CASE WHEN c.pos = 0 THEN 0 ELSE 2 END AS pos, v.piece,
    row_number() OVER (PARTITION BY c.word, c.pos ORDER BY len(v.piece) DESC) AS best
    FROM c JOIN v ON CASE WHEN c.pos = 0 THEN NOT starts_with(v.piece, '##') AND starts_with(c.word, v.piece) ELSE starts_with(v.piece, '##') AND starts_with(substr(c.word, c.pos + 1), substr(v.piece, 3)) END) n WHERE best = 1),
whole AS (SELECT word FROM c WHERE pos = len(word)),
t AS (SELECT p_partkey, i, c.pos, c.piece, coalesce(base, 0) + c.pos - len(c.piece) + CASE WHEN starts_with(c.piece, '##') THEN 2 ELSE 0 END AS s, coalesce(base, 0) + c.pos AS e FROM o JOIN c USING (word) WHERE c.piece <> '' AND word IN (SELECT word FROM whole)
  UNION ALL SELECT p_partkey, i, 0, '[UNK]', coalesce(base, 0), coalesce(base, 0) + len(word) FROM o WHERE word NOT IN (SELECT word FROM whole))
SELECT p_partkey, string_agg(piece || ':' || s || ':' || e, ' ' ORDER BY s) AS tokens FROM t GROUP BY p_partkey""")
def q_word_pieces(spark, sf):
    names = sorted(r["piece"] for r in _pieces(spark, sf).collect())  # a name's first letters and pieces: as bounded as words are
    vocabulary = {x: i for i, x in enumerate(["[UNK]", "[CLS]", "[SEP]", *names])}
    shown = tokens.with_tokens(table(spark, sf, "part"), "p_name", vocabulary, ["p_partkey"], lower=False)
    by_id = spark.createDataFrame([(i, x) for x, i in vocabulary.items()], "id int, piece string")
    each = shown.select("p_partkey", F.posexplode(F.arrays_zip("ids", "offsets")).alias("at", "t")).select("p_partkey", "at", F.col("t.ids").alias("id"), F.col("t.offsets").alias("o")).filter("o.end > 0")
    text = F.concat_ws(":", "piece", "o.start", "o.end")
    return each.join(by_id, "id").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("at", text.alias("x")))).alias("l")).select("p_partkey", F.array_join(F.transform("l", lambda y: y["x"]), " ").alias("tokens"))


_WORDS = "w AS (SELECT p_partkey, p_partkey % 9 AS i, string_split(p_name, ' ') AS p, p_name FROM part)"


@query(f"""WITH {_WORDS}, k AS (SELECT *, CASE i WHEN 1 THEN 'PERSON_NAME' WHEN 2 THEN 'PERSON_NAME' WHEN 3 THEN 'ORGANIZATION' WHEN 4 THEN 'ORGANIZATION' WHEN 5 THEN 'LOCATION' WHEN 6 THEN 'LOCATION' END AS first FROM w)
SELECT p_partkey, 'PERSON_NAME' AS category, 0 AS "start", CAST(length(p[1]) + 1 + length(p[2]) AS INT) AS "end", p[1] || ' ' || p[2] AS text FROM k WHERE first = 'PERSON_NAME'
UNION ALL SELECT p_partkey, first, 0, CAST(length(p[1]) AS INT), p[1] FROM k WHERE first <> 'PERSON_NAME'
UNION ALL SELECT p_partkey, 'PERSON_NAME', CAST(length(p[1]) + 1 AS INT), CAST(length(p[1]) + 1 + length(p[2]) AS INT), p[2] FROM k WHERE first IS NULL OR first <> 'PERSON_NAME'""")
def q_model_entities(spark, sf):
    """Scores of a token model: the first word's greatest score by the part's number, the second's for the inside of a name."""
    words = F.split("p_name", " ")
    one_hot = lambda at: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.when(j == at, 7.0).otherwise(0.0))
    a, b = F.length(F.get(words, F.lit(0))), F.length(F.get(words, F.lit(1)))
    offset = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.array(one_hot(F.col("p_partkey") % 9), one_hot(F.lit(2))).alias("logits"), F.array(offset(F.lit(0), a), offset(a + 1, a + 1 + b)).alias("offsets"))
    found = rows.select("p_partkey", F.inline(pii.model_findings(F.col("p_name"), F.col("logits"), F.col("offsets"), pii.MODEL_LABELS, 0.7)))
    return found.select("p_partkey", "category", "start", "end", "text")


@query(f"WITH {_WORDS} SELECT p_partkey, 'DATE_OF_BIRTH' AS category, 0 AS byte_start, CAST(length(p[1]) AS INT) AS byte_end, p[1] AS text FROM w WHERE p_partkey % 3 <> 0")
def q_external_entities(spark, sf):
    """Findings of a service, of which only sound ones of a known category are kept; it does not answer for every third text."""

    def client():
        def call(text: str):
            first = len(text.split(" ")[0])
            return [{"category": "dob", "start": 0, "end": first}, {"category": "what", "start": 0, "end": 1}, {"category": "EMAIL", "start": 3, "end": 3}, {"category": "EMAIL", "start": 0, "end": 10_000}] if not text.startswith("0:") else None

        return lambda text: call(text[2:]) if not text.startswith("0:") else None

    rows = table(spark, sf, "part").select("p_partkey", F.concat((F.col("p_partkey") % 3).cast("string"), F.lit(":"), F.col("p_name")).alias("text"))
    found = privacy.external_entities(rows.repartition(spread(spark), "p_partkey"), "p_partkey", "text", client, timeout_s=30)
    # the service sees the text behind the mark, and the texts found are those of the marked one
    e = found.select("p_partkey", F.inline("external_entities"))
    return e.join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "category", "byte_start", "byte_end", F.expr("substring(p_name, start + 1, end - start)").alias("text"))


@query(f"WITH {L7_SQL} SELECT count(DISTINCT regexp_replace(path, '[0-9]+', '#', 'g')) AS n FROM l7 WHERE protocol = 'http1'")
def q_template_hash(spark, sf):
    rows = fixtures.l7(spark, sf).filter("protocol = 'http1'").select("path")
    return privacy.template_hashes(rows, "path").agg(F.countDistinct("template_hash").alias("n"))


# ---- sinks ------------------------------------------------------------------------------------------------------

@query(f"WITH {entity_sql('documents', 'doc_id')} SELECT key * 1000 + 5 AS start_ns, key * 1000 + 5 AS end_ns, 'flowlens.pii' AS name, 'flowlens.pii.category=' || category || ';flowlens.pii.confidence=1.0' AS attributes FROM ent")
def q_finding_spans(spark, sf):
    rows = export.finding_spans(privacy.audit_rows(_reports(spark, sf)), 5)
    return rows.select("start_ns", "end_ns", "name", F.array_join(F.transform("attributes", lambda a: F.concat_ws("=", a["key"], a["value"])), ";").alias("attributes"))


@query(f"WITH {L7_SQL} SELECT event_id, '[' || timestamp_ns || '] ' || protocol || ' ' || method || ' ' || path || ' status=' || status || ' latency_ns=' || latency_ns AS value FROM l7")
def q_log_lines(spark, sf):
    return export.log_lines(fixtures.l7(spark, sf), keep=("event_id",))


@query(f"WITH {_STATS} SELECT events_received > 0 AS ready, CAST(events_received AS VARCHAR) AS received, CAST(events_dropped AS VARCHAR) AS dropped FROM stats")
def q_health(spark, sf):
    return export.health(_stats(spark, sf)).select("ready", F.get_json_object("state", "$.events_received").alias("received"), F.get_json_object("state", "$.events_dropped").alias("dropped"))


@query(f"""WITH {L7_SQL}, c AS (SELECT count(*) FILTER (latency_ns <= 1000) AS a, count(*) FILTER (latency_ns <= 100000) AS b, count(*) AS d, sum(latency_ns) AS s FROM l7)
SELECT v AS value FROM c, LATERAL (VALUES ('flowlens_parse_duration_seconds_bucket{{le="1000.0"}} ' || a), ('flowlens_parse_duration_seconds_bucket{{le="100000.0"}} ' || b), ('flowlens_parse_duration_seconds_bucket{{le="+Inf"}} ' || d), ('flowlens_parse_duration_seconds_sum ' || s), ('flowlens_parse_duration_seconds_count ' || d)) x(v)""")
def q_metrics_histogram(spark, sf):
    times = metrics.histogram(fixtures.l7(spark, sf), F.col("latency_ns"), (1000.0, 100000.0), with_sum=True)
    return export.metrics_text(_stats(spark, sf), times).filter("value like 'flowlens_parse%'")


# ---- streams ----------------------------------------------------------------------------------------------------

BATCH_RECORDS = 1 << 20


@query(f"WITH {_BASE} SELECT event_id AS socket_cookie, 'GET' AS method, 'user:' || n AS path FROM base")
def q_stream_capture(spark, sf):
    """Packed capture files followed as a stream: every file of the folder, in batches that end inside files."""
    capture.register(spark)
    path = f"{shared_dir(spark).removeprefix('file://')}/capture-{uuid.uuid4().hex}"
    fixtures.packets(spark, sf, "redis").write.format("capture").mode("append").option("path", path).option("compression", "gzip").option("maxRecordsPerFile", 20_000).save()
    back = _drained(capture.events_source(spark, "capture", path, stream=True, recordsPerBatch=str(BATCH_RECORDS)), "append", limited=True)
    return sessions.parse_sessions(ingest.with_session_key(back)).select(F.col("session_key").alias("socket_cookie"), "method", "path")


@query(f"WITH {_BASE} SELECT event_id AS session_key, 'GET' AS method, 'user:' || n AS path, CASE WHEN k % 7 = 0 THEN 'ERR no ' || k ELSE 'v' || k END AS payload_text FROM base")
def q_stream_sessions_ordered(spark, sf):
    """Responses come batches before their requests; the watermark holds them until their turn. A last event, far ahead in
    time, lets it pass all others."""
    rows = ingest.with_session_key(fixtures.packets(spark, sf, "redis")).withColumn("timestamp_ns", (F.col("seq") + 10_000) * 1_000_000_000 + F.col("socket_cookie") % 1000)
    stored = materialize(rows)
    end = stored.limit(1).withColumns({"timestamp_ns": F.lit(40_000_000_000_000).cast("long"), "session_key": F.lit(-9).cast("long"), "socket_cookie": F.lit(-9).cast("long")})
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    stream = _in_batches([stored.filter("direction = 'Ingress'"), stored.filter("direction = 'Egress'"), end], f"{path}/in")
    use_keyed_state(spark)
    return _drained(folds.parse_session_stream(stream, late="1 hour", idle_ns=10**15), "append").filter("session_key >= 0").select("session_key", "method", "path", "payload_text")


_LATE = "3 days"


def _in_batches(parts: list[DataFrame], path: str) -> DataFrame:
    """parts as a stream, each a batch; the last may be short. All have as many files, and as many as the shortest of the
    others fills, so that a batch ends where a part does."""
    spark = parts[0].sparkSession
    files = max(1, min(2 * spark.sparkContext.defaultParallelism, min(p.count() for p in parts[:-1]) // 10_000))
    for i, part in enumerate(parts):
        (part.repartition(files) if files > 1 and i + 1 < len(parts) else part.coalesce(1)).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def _disordered(rows: DataFrame, ts: str, number: str, unit_ns: int = 1, slices: int = 4) -> DataFrame:
    """rows as a stream that is out of order by up to two days: a batch for each slice of time, but rows come into the next one
    by chance. A last row, far ahead, lets the watermark pass all others; it has the number -1."""
    spark, day = rows.sparkSession, 24 * HOUR_NS // unit_ns
    stored = materialize(rows)
    first, last = stored.agg(F.min(ts), F.max(ts)).first()
    first, last = first or 0, last or 0
    path = f"{shared_dir(spark)}/disordered-{uuid.uuid4().hex}"
    width = max(1, (last + 2 * day - first) // slices + 1)
    place = F.floor((F.col(ts) - first + F.pmod(F.xxhash64(number), F.lit(2 * day))) / width)
    ahead = spark.range(1).select(*[F.lit({ts: last + 400 * day, number: -1}.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    use_keyed_state(spark)
    return _in_batches([*[stored.filter(place == i) for i in range(slices)], ahead], f"{path}/in")


@query(ORACLES["q_pair_correlated"])
def q_stream_correlated(spark, sf):
    rows = fixtures.base_events(spark, sf).select((F.col("user_id") % 40).alias("corr"), "event_id", "event_type", "timestamp_ns")
    stream = _disordered(rows, "timestamp_ns", "event_id")
    kind = lambda k: stream.filter(F.col("event_type") == k).drop("event_type")
    last = stream.filter("event_id = -1").drop("event_type")
    found = folds.pair_correlated_stream(kind("purchase").unionByName(last), kind("error"), ["corr"], 10 * HOUR_NS, _LATE)
    return _drained(found, "append").filter("outcome != 'no response'").select(F.col("event_id").alias("response_id"), F.col("request.event_id").alias("request_id"))


@query("""WITH e AS (SELECT user_id % 40 AS corr, event_id, event_type, epoch_us(ts) * 1000 AS t FROM events),
n AS (SELECT *, lead(t) OVER (PARTITION BY corr ORDER BY t, event_id) AS following FROM e WHERE event_type = 'purchase')
SELECT event_id AS request_id FROM n WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.event_type = 'error' AND r.corr = n.corr AND r.t >= n.t AND r.t - n.t <= 36000000000000 AND (n.following IS NULL OR r.t < n.following))""")
def q_stream_unanswered(spark, sf):
    """The requests that no response came for before their time was up or the next one came."""
    rows = fixtures.base_events(spark, sf).select((F.col("user_id") % 40).alias("corr"), "event_id", "event_type", "timestamp_ns")
    stream = _disordered(rows, "timestamp_ns", "event_id")
    kind = lambda k: stream.filter(F.col("event_type") == k).drop("event_type")
    last = stream.filter("event_id = -1").drop("event_type")
    found = folds.pair_correlated_stream(kind("purchase"), kind("error").unionByName(last), ["corr"], 10 * HOUR_NS, _LATE)
    return _drained(found, "append").filter("outcome = 'no response'").select(F.col("request.event_id").alias("request_id"))


def _named(spark, sf) -> DataFrame:
    """Events and answers for addresses in one stream: kind, number, at (seconds), ip, domain, ttl."""
    none = lambda kind: F.lit(None).cast(kind)
    c = F.col("c_custkey")
    answers = table(spark, sf, "customer").select(F.lit(0).alias("kind"), c.alias("number"), (1704067200 + c * 1700).alias("at"), (c % 150).alias("ip"), F.lower("c_name").alias("domain"), (3600 + c % 7 * 20000).alias("ttl"))
    events = fixtures.base_events(spark, sf).select(F.lit(1).alias("kind"), F.col("event_id").alias("number"), F.floor(F.col("timestamp_ns") / 1_000_000_000).alias("at"), F.col("user_id").alias("ip"), none("string").alias("domain"), none("long").alias("ttl"))
    return events.unionByName(answers)


@query(ORACLES["q_identity_asof"])
def q_stream_names(spark, sf):
    stream = _disordered(_named(spark, sf), "at", "number", 1_000_000_000)
    dns = stream.filter("kind = 0").select("ip", "domain", F.col("at").alias("inserted_at"), "ttl")
    rows = stream.filter("kind = 1 or number = -1").select(F.col("number").alias("event_id"), F.col("ip").alias("user_id"), "at")
    found = folds.asof_domain_stream(rows, dns, "user_id", "at", _LATE, unit_ns=1_000_000_000)
    return _drained(found, "append").filter("event_id >= 0").select("event_id", host_name().alias("name"))


@query("SELECT lower(c_name) AS domain, c_custkey % 150 AS address, (1704067200 + c_custkey * 1700) * 1000000000 AS since FROM customer UNION ALL SELECT lower(c_name), NULL, (1704067200 + c_custkey * 1700 + 3600 + c_custkey % 7 * 20000) * 1000000000 FROM customer")
def q_stream_addresses(spark, sf):
    """Each name's address, and when it has none any more; all of them have run out by the last row. Nanoseconds after 2262 don't
    fit a long, and the SQL stops there: where there are such, `since` is a decimal."""
    stream = _disordered(_named(spark, sf).filter("kind = 0"), "at", "number", 1_000_000_000)
    dns = stream.select(F.coalesce("domain", F.lit("")).alias("domain"), "ip", F.col("at").alias("inserted_at"), F.coalesce("ttl", F.lit(0)).alias("ttl"))
    found = _drained(folds.address_stream(dns, _LATE, unit_ns=1_000_000_000), "append").filter("domain != ''")
    last = found.agg(F.max("since")).first()[0] or 0
    since = F.col("since") if last * 1_000_000_000 < 1 << 63 else F.col("since").cast("decimal(19,0)")
    return found.select("domain", "address", (since * 1_000_000_000).alias("since"))


@query(ORACLES["q_rate_limit"])
def q_stream_rate_limit(spark, sf):
    rows = fixtures.base_events(spark, sf).select("event_id", "timestamp_ns")
    found = folds.rate_limited_stream(_disordered(rows, "timestamp_ns", "event_id"), 120, _LATE, order=["event_id"], tick_ns=HOUR_NS)
    return _drained(found, "append").filter("event_id >= 0").select("event_id")


@query(ORACLES["q_sampler_budget"])
def q_stream_budget(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", ((F.col("conv_id") * 7 + F.col("turn") + 10) * 100_000_000).alias("ts"))  # a period later: the watermark begins at 0
    found = folds.inference_budget_stream(_disordered(rows, "ts", "conv_id"), "text", "ts", 3, _LATE, ["conv_id", "turn"])
    return _drained(found, "append").filter("conv_id >= 0").select("conv_id", "turn")


@query(f"""WITH {_LIBRARIES}, n AS (SELECT path, pid, pid * 65536 + 3 * 4096 AS base, CAST(regexp_extract(path, '[0-9]+$') AS BIGINT) AS i, s FROM libs, range(3) r(s)),
p AS (SELECT *, (i + s) % 3 <> 0 AS present FROM n)
SELECT a.path, a.base, a.pid, (a.s + 1) * 86400000000000 AS "at", 'attach' AS change FROM p a LEFT JOIN p b ON b.path = a.path AND b.s = a.s - 1 WHERE a.present AND NOT coalesce(b.present, false)
UNION ALL SELECT a.path, a.base, a.pid, (a.s + 1) * 86400000000000 + 129600000000000, 'detach' FROM p a LEFT JOIN p b ON b.path = a.path AND b.s = a.s + 1 WHERE a.present AND NOT coalesce(b.present, false)""")
def q_stream_new_targets(spark, sf):
    """Three scans, a day apart, each without a third of the libraries."""
    scans = _maps(spark, sf).select("pid", "content", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("scan"))
    rows = scans.filter((F.col("pid") % 7 + F.col("scan")) % 3 != 0).select(((F.col("scan") + 1) * 24 * HOUR_NS).alias("scanned_ns"), "pid", "content")
    stream = _disordered(rows, "scanned_ns", "pid").withColumn("content", F.coalesce("content", F.lit("7f00-7f10 r-xp 0 08:01 1 /usr/lib/libssl.so.x")))
    found = folds.target_stream(stream, 24 * HOUR_NS, _LATE)
    return _drained(found, "append").select("path", "base", "pid", "at", "change").filter("path != '/usr/lib/libssl.so.x'")


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, user_id, epoch_us(ts) * 1000 AS t FROM events),
f(i, live, gone) AS (SELECT 0::BIGINT, MAP {}::MAP(BIGINT, BIGINT), NULL::BIGINT UNION ALL
  SELECT e.i, map_concat(map_from_entries(list_filter(map_entries(live), lambda x: x.key IS DISTINCT FROM v.gone)), MAP {e.user_id: e.t}), v.gone
  FROM f JOIN e ON e.i = f.i + 1, LATERAL (SELECT CASE WHEN map_contains(live, e.user_id) OR cardinality(live) < 20 THEN NULL ELSE list_sort(list_transform(map_entries(live), lambda x: {'t': x.value, 'k': x.key::VARCHAR, 'n': x.key}))[1].n END AS gone) v)
SELECT gone AS session_key, count(*) AS n FROM f WHERE gone IS NOT NULL GROUP BY gone""")
def q_stream_evicted(spark, sf):
    """How often each session had to give way in a table of 20: the one silent for the longest."""
    kinds = {f.name: f.dataType for f in schema.DATA_EVENT}
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in ("payload", "src_addr", "dst_addr", "src_port", "dst_port", "pid", "tls_library", "direction")]
    rows = fixtures.base_events(spark, sf).select(F.col("user_id").alias("session_key"), "timestamp_ns", F.col("event_id").alias("seq"), F.lit("TcPacket").alias("event_type"), *blank)
    stream = _disordered(rows, "timestamp_ns", "seq").withColumn("session_key", F.coalesce("session_key", "seq"))
    found = folds.parse_session_stream(stream, late=_LATE, idle_ns=10**18, capacity=20, buckets=1)
    return _drained(found, "append").filter("error = 'evicted'").groupBy("session_key").agg(F.count("*").alias("n"))


@query(f"WITH {_FLOWS} SELECT {_EDGE_COLUMNS.replace(', mean_latency_ns', '')} FROM edges")
def q_stream_edges(spark, sf):
    """Final flows of a stream merged into an edge table, by two queries one after the other, as after a restart."""
    rows = materialize(observations(spark, sf).withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000))))
    last = rows.agg(F.max("timestamp_ns")).first()[0] or 0
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    middle = last // 2 + (rows.agg(F.min("timestamp_ns")).first()[0] or 0) // 2
    middle -= middle % HOUR_NS
    ahead = rows.limit(1).withColumns({"timestamp_ns": F.lit(last + 400 * 24 * HOUR_NS).cast("long"), "event_time": F.timestamp_micros(F.lit((last + 400 * 24 * HOUR_NS) // 1000))})
    rows.filter(F.col("timestamp_ns") < middle).coalesce(1).write.parquet(f"{path}/in/part=0")
    for n, more in enumerate((rows.filter(F.col("timestamp_ns") >= middle), ahead)):
        if n == 0:
            _merge_once(spark, rows, path)
        more.coalesce(1).write.parquet(f"{path}/in/part={n + 1}")
    _merge_once(spark, rows, path)
    return EdgeTable(spark, f"{path}/table", 8).read().filter(F.col("last_seen") <= last)


def _merge_once(spark, rows: DataFrame, path: str) -> None:
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    flows = flow_stream(source, window="1 hour", late="1 hour")
    with state_partitions(spark):
        edge_stream(flows, EdgeTable(spark, f"{path}/table", 8), f"{path}/state", availableNow=True).awaitTermination()


# ---- extensions -------------------------------------------------------------------------------------------------

@query()
def q_latency_approx(spark, sf):
    """Percentiles from bounded summaries, for groups of any number of distinct values."""
    return fixtures.l7(spark, sf).groupBy("protocol").agg(F.percentile_approx("latency_ns", 0.5, 10_000).alias("p50"), F.percentile_approx("latency_ns", 0.99, 10_000).alias("p99"))
