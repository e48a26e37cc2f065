"""What shows only in larger tables: keys beyond a byte, rows that share a time, files and batches that end early."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def grown(spark, tmp_path):
    """Makes a folder of tables from SQL over the smallest ones, and gives a query's rows and those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")

    def both(name, **tables):
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        theirs = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in theirs.description]
        want = [[str(x) for x in row] for row in theirs.fetchall()]
        got = [[str(x) for x in row] for row in entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
        return sorted(got), sorted(want)

    return both


USERS = f"SELECT * REPLACE (user_id + 290 * (event_id % 3) AS user_id) FROM '{SF}/events.parquet'"
CUSTOMERS = f"SELECT * FROM '{SF}/customer.parquet'"


def test_names_of_users_beyond_a_byte(grown):
    got, want = grown("q_identity_asof", events=USERS, customer=CUSTOMERS)
    assert got == want and any(len(name) > len("0.0.0.255:443") for _, name in got)


def test_streamed_names_of_users_beyond_a_byte(grown):
    got, want = grown("q_stream_names", events=USERS, customer=CUSTOMERS)
    assert got == want and any(len(name) > len("0.0.0.255:443") for _, name in got)


SAME_TIME = f"SELECT * REPLACE (TIMESTAMP '2024-01-02 03:04:05.678901' AS ts) FROM '{SF}/events.parquet'"


@pytest.mark.parametrize("name", ["q_jsonl", "q_log_lines"])
def test_lines_of_events_at_one_time(grown, name):
    got, want = grown(name, events=SAME_TIME)
    assert got == want


def test_transaction_ids_that_look_like_other_protocols(grown):
    """84 is the tag T of PostgreSQL, 42 begins an array of RESP."""
    got, want = grown("q_parse_dns", events=f"SELECT * REPLACE (event_id + CASE WHEN event_id % 2 = 0 THEN 84 * 256 ELSE 65536 + 42 * 256 END AS event_id) FROM '{SF}/events.parquet'")
    assert got == want


def test_dns_is_told_by_its_header_on_its_port(spark):
    from pyspark.sql import functions as F

    from flowlens.functions.detect import detect, detect_bytes

    query = bytes.fromhex("5400010000010000000000000473766330056c6f63616c0000010001")
    startup = bytes.fromhex("0000001200030000") + b"user\0app\0\0"
    cases = [(query, 40000, 53, "dns"), (query, 53, 40000, "dns"), (query, 40000, 5432, "postgres"), (startup, 40000, 53, "postgres"), (b"GET / HTTP/1.1\r\n", 40000, 53, "http1"), (b"E\0\0\0\x0eSERROR\0\0\0\0", 53, 1, "postgres")]
    rows = spark.createDataFrame([(i, bytearray(p), s, d) for i, (p, s, d, _) in enumerate(cases)], "i int, p binary, s int, d int")
    shown = {r["i"]: r["x"] for r in rows.select("i", detect(F.col("p"), F.col("s"), F.col("d")).alias("x")).collect()}
    for i, (p, s, d, name) in enumerate(cases):
        assert detect_bytes(p, s, d) == name and shown[i] == name, i


def test_packed_capture_files_of_bounded_size(spark, tmp_path):
    import os

    from flowlens.plans import fixtures
    from flowlens.sources import capture

    capture.register(spark)
    rows, path = fixtures.packets(spark, SF, "redis"), f"{tmp_path}/c"
    rows.write.format("capture").mode("append").option("path", path).option("compression", "gzip").option("maxRecordsPerFile", 50).save()
    n = rows.count()
    assert len(os.listdir(path)) >= n // 50 and sum(os.path.getsize(f"{path}/{x}") for x in os.listdir(path)) < n * capture.STRIDE / 10
    keys = [c for c in rows.columns if c != "seq"]
    want = sorted(map(tuple, rows.select(*keys).collect()), key=repr)
    for back in (spark.read.format("capture").load(path), capture.read_stored(spark, f"file://{path}")):
        assert sorted(map(tuple, back.select(*keys).collect()), key=repr) == want


def test_floors_of_scores_come_from_all_rows(spark, monkeypatch):
    from flowlens.llm import language

    docs = spark.createDataFrame([(i, f"the cat number {i} sat on the mat", "en") if i % 2 else (i, f"der hund nummer {i} lief in den wald", "de") for i in range(40)], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "sample", lambda *a, **k: pytest.fail("a sample"))
    assert language.identified(docs).count() == 40


def test_capture_files_of_more_records_than_a_batch(grown, monkeypatch):
    from flowlens.plans import host_queries

    monkeypatch.setattr(host_queries, "BATCH_RECORDS", 1000, raising=False)
    got, want = grown("q_stream_capture", events=f"SELECT * FROM '{SF}/events.parquet'")
    assert got == want


def test_a_bounded_run_over_capture_files_takes_all(spark, tmp_path):
    from flowlens import schema
    from flowlens.sources import capture

    (tmp_path / "c").mkdir()
    for i, n in enumerate((700_000, 600_000)):
        with open(tmp_path / "c" / f"{i}.cap", "wb") as f:
            f.truncate(capture.HEADER.size + n * capture.STRIDE)  # only sizes are looked at
    assert sum(capture.CaptureStreamReader(schema.DATA_EVENT, {"path": str(tmp_path / "c")}).latestOffset().values()) == 1_300_000


def test_packets_are_made_in_many_tasks(spark):
    from flowlens.plans import fixtures, wire

    for protocol in wire.EXCHANGES:
        rows = fixtures.packets(spark, SF, protocol)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # the table itself is one row group
        base = fixtures.base_events(spark, SF).filter("event_id < 40").collect()
        want = {(e["event_id"], i, at, "Egress" if client else "Ingress", data) for e in base for i, (at, client, data) in enumerate(wire.packets(protocol, e["event_id"], e["k"], e["timestamp_ns"]))}
        got = rows.filter("socket_cookie < 40").collect()
        assert {(r["socket_cookie"], r["seq"], r["timestamp_ns"], r["direction"], bytes(r["payload"])) for r in got} == want and len(got) == len(want)
        port = wire.EXCHANGES[protocol][1]
        assert all((r["src_port"] == port) == (r["direction"] == "Ingress") and r["payload_len"] == len(r["payload"]) and r["ip_proto"] == (17 if protocol == "dns" else 6) for r in got)


def test_messages_made_by_column_are_those_made_one_by_one(spark):
    from pyspark.sql import functions as F

    from flowlens.operators import ingest, sessions
    from flowlens.plans import fixtures

    rows = fixtures.packets(spark, SF, "http1").unionByName(fixtures.packets(spark, SF, "redis").withColumns({"socket_cookie": F.col("socket_cookie") + 5000, "pid": F.lit(0).cast("long"), "tls_library": F.lit("OpenSsl")}))
    broken = rows.filter("seq = 0 and socket_cookie >= 5000").withColumns({"seq": F.lit(9).cast("long"), "timestamp_ns": F.col("timestamp_ns") + 50_000_000, "payload": F.lit(b"?\r\n")})
    closed = rows.filter("seq = 0 and socket_cookie % 3 = 0").withColumns({"seq": F.lit(1).cast("long"), "event_type": F.lit("SockClose"), "payload": F.lit(None).cast("binary")})
    events = ingest.with_session_key(rows.unionByName(broken).unionByName(closed)).filter("socket_cookie % 10 = 3").select(*sessions.INPUT)
    want, runners = [], {}
    for e in sorted(events.collect(), key=lambda e: (e["session_key"], e["timestamp_ns"], e["seq"])):
        runner = runners.setdefault(e["session_key"], sessions.SessionRunner())
        first = runner.made
        found = runner.feed(e.asDict())
        assert [m["msg_no"] for m in found] == list(range(first, runner.made))
        want += found
    got = [r.asDict(recursive=True) for r in sessions.parse_sessions(events).collect()]
    key = lambda r: (r["session_key"], r["msg_no"])
    assert sorted(got, key=key) == sorted(want, key=key) and any(r["error"] for r in got) and any(r["headers"] for r in got) and any(r["method"] is None for r in got)


def test_service_calls_cost_little_beside_themselves():
    import threading
    import time

    from flowlens.operators import privacy

    began, before = time.monotonic(), threading.active_count()
    assert privacy.calls_in_flight(lambda x: [x] if x % 3 else None, list(range(60_000)), 8, 5, 1) == [[x] if x % 3 else None for x in range(60_000)]
    assert time.monotonic() - began < 2 and threading.active_count() <= before + 8


def test_a_call_that_hangs_holds_up_its_own_place_only():
    import time

    from flowlens.operators import privacy

    began = time.monotonic()
    out = privacy.calls_in_flight(lambda x: time.sleep(3 if x % 20 == 7 else 0.01) or x, list(range(100)), 2, 0.5, 0)
    assert out == [None if x % 20 == 7 else x for x in range(100)] and time.monotonic() - began < 3.5


def test_service_calls_of_a_small_table_go_out_from_many_tasks(spark):
    from flowlens.operators import privacy

    plain, seen = privacy.external_entities, []

    def watched(rows, *args, **more):
        seen.append(rows.rdd.getNumPartitions())
        return plain(rows, *args, **more)

    privacy.external_entities = watched
    try:
        entry.queries()["q_external_entities"](spark, SF)
    finally:
        privacy.external_entities = plain
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_decompressed_payloads_are_handed_on_in_pieces(spark):
    import gzip

    import pyarrow as pa
    from pyspark.sql import functions as F

    from flowlens.functions import compression

    bomb = gzip.compress(bytes(2_000_000))
    data, encoding = pa.array([bomb, None, b"junk", *[bomb] * 40]), pa.array(["gzip", "gzip", "GZIP", *["gzip"] * 39, "zstd"])
    pieces = list(compression.decompressed.func(iter([(data, encoding), (data[:0], encoding[:0])])))
    assert sum(map(len, pieces)) == 43 and max(p.nbytes for p in pieces) < compression.PIECE + 2_100_000
    rows = spark.createDataFrame([(i, bytearray(bomb), "gzip") for i in range(30)] + [(30, None, "br")], "id int, data binary, encoding string").coalesce(1)
    got = {r["id"]: (r["status"], r["n"]) for r in rows.select("id", compression.decompressed("data", "encoding").alias("d")).select("id", "d.status", F.length("d.data").alias("n")).collect()}
    assert got == {i: ("success", 2_000_000) for i in range(30)} | {30: ("unsupported", None)}


def test_a_close_comes_from_the_packets_themselves(spark):
    import re

    plan = entry.queries()["q_session_close"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"\bMapInArrow\b", initial)) == 2 and "Join" not in initial and "Aggregate" not in initial  # made once, parsed once


def test_marked_packets_name_the_first_answer_of_each_event(spark):
    from pyspark.sql import functions as F

    from flowlens.plans import fixtures

    for protocol in ("redis", "mysql", "amqp"):
        rows = fixtures.packets(spark, SF, protocol, marked=True)
        want = rows.filter("direction = 'Ingress'").groupBy("socket_cookie").agg(F.min("seq").alias("seq"), F.first("k").alias("k"))
        assert sorted(map(tuple, rows.filter("answers").select("socket_cookie", "seq", "k").collect())) == sorted(map(tuple, want.collect()))
        base = fixtures.base_events(spark, SF).select("event_id", "k")
        assert {(r[0], r[1]) for r in rows.select("socket_cookie", "k").distinct().collect()} == {tuple(r) for r in base.collect()}
        assert rows.drop("k", "answers").schema == fixtures.packets(spark, SF, protocol).schema


def test_events_are_dealt_before_anything_is_computed(spark):
    from flowlens.plans import fixtures

    rows = fixtures.base_events(spark, SF, 24)
    assert rows.rdd.getNumPartitions() == 24
    plan = fixtures.packets(spark, SF, "http1")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.index("get_json_object") < plan.index("REPARTITION_BY_NUM")  # above the exchange, so in many tasks
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, fixtures.base_events(spark, SF).collect()))


def test_small_batches_are_put_together():
    import pyarrow as pa

    from flowlens import session

    parts = [pa.record_batch({"x": pa.array(range(i, i + n), pa.int64()), "b": pa.array([b"." * w] * n, pa.binary())}) for i, n, w in ((0, 3, 1), (3, 0, 1), (3, 4, 1), (7, 1, 900), (8, 2, 1), (10, 9, 1))]
    got = list(session.gathered(iter(parts), rows=6, size=800))
    assert [g.num_rows for g in got] == [7, 1, 11] and [x for g in got for x in g.column("x").to_pylist()] == list(range(19))
    assert list(session.gathered(iter([]))) == []


def test_a_session_is_read_over_the_ends_of_batches(spark):
    from flowlens import schema
    from flowlens.operators import ingest, sessions
    from flowlens.plans import fixtures

    def read(protocol):
        rows = ingest.with_session_key(fixtures.packets(spark, SF, protocol))
        return sorted((tuple(r) for r in sessions.parse_sessions(rows).collect()), key=lambda r: r[:2])

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for protocol in ("http1", "http2", "kafka", "amqp"):
        want, before = read(protocol), spark.conf.get(setting)
        try:
            spark.conf.set(setting, "3")
            assert read(protocol) == want
        finally:
            spark.conf.set(setting, before)
    rows = ingest.with_session_key(fixtures.packets(spark, SF, "http1"))
    parsed = sessions.parse_sessions(rows)
    assert parsed.schema == schema.SESSION_ROW
    assert parsed.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # joined to as many as cores and one, the last would run alone


def test_packed_capture_files_are_followed(spark, tmp_path):
    from flowlens import schema
    from flowlens.plans import fixtures
    from flowlens.sources import capture

    capture.register(spark)
    path = tmp_path / "c"
    rows = fixtures.packets(spark, SF, "redis").filter("socket_cookie < 40")
    rows.coalesce(2).write.format("capture").mode("append").option("path", str(path)).option("compression", "gzip").option("maxRecordsPerFile", 50).save()
    (path / "z.cap.gz").write_bytes(b"")  # its header is not there yet
    n = rows.count()
    reader = capture.CaptureStreamReader(schema.DATA_EVENT, {"path": str(path), "recordsPerBatch": "33", "recordsPerPartition": "20"})
    got, start = [], reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        assert sum(p.count for p in parts) == min(33, n - len(got))
        got += [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        start = end
    keys = [c for c in rows.columns if c != "seq"]
    assert sorted((tuple(r[c] for c in keys) for r in got), key=repr) == sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.select(*keys).collect()), key=repr)
    torn = path / "a.cap.gz"
    import gzip

    torn.write_bytes(gzip.compress(capture.HEADER.pack(capture.MAGIC, capture.VERSION, 0, 9) + bytes(10)))
    with pytest.raises(capture.CaptureError):
        list(reader.read(capture.Part(str(torn), 0, 9)))


def test_followed_capture_files_take_little_disk(grown, spark):
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(root) for f in files if "/capture-" in d)
    before = size()
    got, want = grown("q_stream_capture", events=f"SELECT * FROM '{SF}/events.parquet'")
    assert got == want and size() - before < 1000 * 4 * 4156 / 10


def test_one_event_in_capture_files(grown):
    got, want = grown("q_stream_capture", events=f"SELECT * FROM '{SF}/events.parquet' LIMIT 1")
    assert got == want and len(got) == 1


def test_records_made_by_column_are_those_made_one_by_one(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from flowlens import schema
    from flowlens.sources import capture

    shape = to_arrow_schema(schema.DATA_EVENT)
    base = {"seq": 5, "timestamp_ns": 2**62, "socket_cookie": -3, "event_type": "TlsData", "direction": "Egress", "pid": 7, "tgid": None, "src_addr": 2**32 - 1, "dst_addr": 0, "payload_len": 9000, "tls_library": "GoTls", "src_port": 65535, "dst_port": None, "ip_proto": 17, "payload": bytes(range(256)) * 16}
    rows = [base, base | {"payload": None, "payload_len": 0, "socket_cookie": 2**63 - 1}, base | {"payload": b"x", "payload_len": 1, "direction": "Ingress"}]
    raw = capture.batch_bytes(pa.RecordBatch.from_pylist(rows, schema=shape))
    assert raw == b"".join(map(capture.record_bytes, rows))
    for cut in (raw, raw[:-capture.STRIDE], raw + b"\1\2", b""):
        assert capture.record_batch(cut, 4, shape).to_pylist() == capture.read_records(cut, 4)
    for bad in (raw[:-1], raw + raw[:4], b"\0" + raw[1:], raw[:20] + b"\xff" + raw[21:]):
        with pytest.raises(capture.CaptureError):
            capture.record_batch(bad, 0, shape)
    for bad in ({"payload": bytes(4097)}, {"direction": None}, {"event_type": "x"}, {"src_addr": 2**32}, {"pid": -1}, {"socket_cookie": None}):
        with pytest.raises(capture.CaptureError):
            capture.batch_bytes(pa.RecordBatch.from_pylist([base | bad], schema=shape))


FAR = f"SELECT * REPLACE (c_custkey + 5398500 * (c_custkey % 2) AS c_custkey) FROM '{SF}/customer.parquet'"


def test_streamed_addresses_after_2262(spark, tmp_path):
    """The SQL's nanoseconds overflow there, so they are reckoned with wider numbers."""
    con = duckdb.connect()
    con.execute(f"COPY ({FAR}) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    sql = entry.oracle_sql()["q_stream_addresses"]
    with pytest.raises(duckdb.OutOfRangeException):
        con.execute(sql).fetchall()
    want = con.execute(sql.replace("* 1000000000", "* 1000000000::HUGEINT")).fetchall()
    got = entry.queries()["q_stream_addresses"](spark, str(tmp_path)).select("domain", "address", "since").collect()
    assert sorted((d, str(a), int(t)) for d, a, t in got) == sorted((d, str(a), t) for d, a, t in want)
    assert max(int(r["since"]) for r in got) >= 1 << 63
    near = entry.queries()["q_stream_addresses"](spark, SF)
    assert dict(near.dtypes)["since"] == "bigint"


def test_a_late_event_is_dropped_by_the_clock_of_its_unit(spark, tmp_path):
    from pyspark.sql import functions as F

    from flowlens.plans.queries import _drained
    from flowlens.streaming import folds, held

    held.use_keyed_state(spark)
    day, far = 86400, 12_000_000_000  # seconds; beyond 2262
    parts = [[("a", 1, far, 10 * day)], [("b", 2, far + 5 * day, 10 * day)], [("c", 4, far + 4 * day, day)], [("late", 3, far + day, day)], [("d", 5, far + 900 * day, day)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "domain string, ip long, inserted_at long, ttl long").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema("domain string, ip long, inserted_at long, ttl long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = _drained(folds.address_stream(stream, "3 days", unit_ns=1_000_000_000), "append").filter(F.col("domain") != "d").collect()
    assert sorted((r["domain"], r["since"] - far) for r in got) == [("a", 0), ("a", 10 * day), ("b", 5 * day), ("b", 15 * day), ("c", 4 * day), ("c", 5 * day)]
