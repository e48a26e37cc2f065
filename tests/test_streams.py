"""Streams: order over batches, bounded state, the job in both modes, counters, sinks that are written again."""

import functools
import json
import pickle
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens import __main__ as job
from flowlens import config
from flowlens.plans import fixtures
from flowlens.plans.queries import _drained
from flowlens.sinks import export
from flowlens.sources import capture
from flowlens.streaming import folds, held, live

SECOND = 1_000_000_000


class Store(dict):
    """Stands for a value and for a map of a state store; counts what is read and written."""

    def __init__(self):
        self.trips = 0

    def get(self):
        return super().get(None)

    def update(self, value):
        self[None] = value

    def getValue(self, key):
        self.trips += 1
        return super().get(key)

    def updateValue(self, key, value):
        self.trips += 1
        self[key] = value

    def removeKey(self, key):
        self.trips += 1
        del self[key]


class Handle:
    def __init__(self):
        self.timers, self.stores = set(), {}

    def getValueState(self, name, *_):
        return self.stores.setdefault(name, Store())

    getMapState = getValueState

    def registerTimer(self, at):
        assert not self.timers, "one timer a bucket"
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def watermark(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


class Bucket:
    """A bucket outside Spark."""

    def __init__(self, make, columns, out, slot_ns=SECOND, capacity=None, is_held=True):
        self.processor, self.handle = held.HeldProcessor(make, columns, [], out, [], slot_ns, capacity, is_held), Handle()
        self.processor.init(self.handle)
        self.slot_ns = slot_ns

    def add(self, rows, size=500):
        """rows: (key, at, *values)"""
        names = [f"c{i}" for i in range(len(self.processor.columns))]
        frame = pd.DataFrame([dict(zip(names, values, strict=True)) | {"key": k, "at": at, "nulls": 0, "slot": at // self.slot_ns} for k, at, *values in rows])
        parts = [frame[i:i + size] for i in range(0, len(frame), size)]
        return [r for out in self.processor.handleInputRows(None, iter(parts), watermark(0)) for r in out.to_dict("records")]

    def pass_(self, ms):
        out = []
        while due := [t for t in self.handle.timers if t <= ms]:
            self.handle.timers.clear()
            assert len(due) == 1
            out += [r for frame in self.processor.handleExpiredTimer(None, watermark(ms), None) for r in frame.to_dict("records")]
        return out


class Last(held.Fold):
    """Hands events on, with how many came before."""

    def begin(self, key):
        return {"n": 0}

    def feed(self, state, event):
        state["n"] += 1
        return [{"key": event["__key"], "at": event["__at"], "n": state["n"]}]

    def until(self, state, at):
        return at + 5 * SECOND

    def gone(self, key, state, last, evicted):
        return [{"key": key, "at": last, "n": -1 if evicted else 0}]


def test_a_key_with_very_many_waiting_events():
    bucket = Bucket(Last, ["at"], ["key", "at", "n"])
    times = [i * SECOND // 100 for i in range(100_000)]
    random.Random(2).shuffle(times)
    for i in range(0, len(times), 10_000):
        assert bucket.add([("k", t, t) for t in times[i:i + 10_000]]) == []
    waiting = bucket.handle.stores["waiting"]
    assert sum(len(pickle.loads(v[0])) for v in waiting.values()) == 100_000
    waiting.trips = 0
    first = bucket.pass_(500_000)
    assert [r["at"] for r in first] == sorted(t for t in times if t < 500 * SECOND) and [r["n"] for r in first] == list(range(1, len(first) + 1))
    assert waiting.trips == 2 * 500 * 10  # only the slots that were due: each part read once and removed once
    rest = bucket.pass_(10_000_000)
    assert [r["n"] for r in rest] == [*range(len(first) + 1, 100_001), 0]  # at last the key is silent and goes
    assert not waiting and not bucket.handle.stores["states"] and not bucket.handle.timers


def test_the_longest_silent_key_gives_way():
    rng, bucket = random.Random(4), Bucket(Last, ["at"], ["key", "at", "n"], capacity=7)
    events = [(f"k{rng.randrange(20)}", i * SECOND // 10, 0) for i in range(3000)]
    got = [r for i in range(0, 3000, 700) for r in bucket.add(events[i:i + 700]) + bucket.pass_(i * 100 - 3000)]
    got += bucket.pass_(301_000)
    seen, want = {}, []
    for key, at, _ in events:
        if key not in seen and len(seen) == 7:
            oldest = min(seen, key=lambda k: (seen[k], k))
            want.append((oldest, seen.pop(oldest)))
        seen[key] = at
    assert [(r["key"], r["at"]) for r in got if r["n"] == -1] == want and len(want) > 100
    assert len(bucket.handle.stores["states"]) <= 7


def test_capacity_is_told():
    make = functools.partial(folds.SessionFold, 10 * SECOND)
    columns = ["session_key", "timestamp_ns", "event_type", "payload"]
    bucket = Bucket(make, columns, ["session_key", "error", "state", "msg_no"], capacity=20)
    bucket.add([(str(i), i * SECOND // 10, i, i * SECOND // 10, "TcPacket", None) for i in range(25)])
    rows = bucket.pass_(4000)
    assert [(r["session_key"], r["state"], r["msg_no"]) for r in rows if r["error"] == "capacity"] == [(15, "warning", 16), (18, "critical", 19)]
    assert [r["session_key"] for r in rows if r["error"] == "evicted"] == [0, 1, 2, 3, 4]


def test_nothing_is_kept_of_names_whose_time_is_up():
    bucket = Bucket(functools.partial(folds.NameFold, SECOND, ["row"]), ["__kind", "__domain", "__ttl", "row"], ["row", "domain"])
    bucket.add([("10", 0, 0, "a", 5, 0), ("10", 3 * SECOND, 1, None, 0, 1), ("10", 4 * SECOND, 0, "b", 2, 0), ("10", 5 * SECOND, 1, None, 0, 2), ("10", 6 * SECOND, 1, None, 0, 3), ("11", SECOND, 1, None, 0, 4)])
    assert [(r["row"], r["domain"]) for r in bucket.pass_(60_000)] == [(4, None), (1, "a"), (2, "b"), (3, None)]
    assert not bucket.handle.stores["states"] and not bucket.handle.timers


def test_keyed_state_says_what_it_needs(spark):
    rows = spark.readStream.format("rate").load().selectExpr("value as k", "value as timestamp_ns")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            folds.rate_limited_stream(rows, 5, "1 second")
    finally:
        spark.conf.set(provider, before)


def test_nulls_and_odd_names_pass_through(spark, tmp_path):
    shape = "_x long, `from` string, timestamp_ns long, flag boolean"
    rows = [(None, "a", 5 * SECOND, None), (2**60 + 1, None, 6 * SECOND, True), (1, "b", None, False), (7, "c", 900 * SECOND, False)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    held.use_keyed_state(spark)
    out = _drained(folds.rate_limited_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), 100, "10 seconds"), "append").select("_x", "from", "timestamp_ns", "flag")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[:2], key=str)


@pytest.mark.parametrize("limits", ["", "max_events_per_sec = 30\n", 'sampling_mode = "head_only"\nhead_bytes = 40\n', 'sampling_mode = "connection_sample"\nsample_rate = 0.5\n'])
def test_the_job_gives_the_same_rows_in_both_modes(spark, tmp_path, limits):
    capture.register(spark)
    rows = fixtures.packets(spark, "/root/testdata/sf0.001", "redis").filter("socket_cookie < 60").withColumn("timestamp_ns", (F.col("socket_cookie") * 3 + F.col("seq") + 10) * 20_000_000)
    bad = rows.filter("socket_cookie < 3").withColumns({"ip_proto": F.lit(1).cast("short"), "socket_cookie": F.col("socket_cookie") + 500})
    # a limit is a stream of its own, so each stage takes an event far ahead to let go what came before; of twenty sessions, as some are sampled out
    far = rows.limit(1).withColumn("timestamp_ns", F.explode(F.array(F.lit(10**15), F.lit(2 * 10**15)))).withColumns({"socket_cookie": F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1019).cast("long"))), "payload": F.lit(b"x"), "payload_len": F.lit(1).cast("long")})
    for part in (rows.unionByName(bad), far):
        part.coalesce(1).write.format("capture").mode("append").option("path", str(tmp_path / "in")).save()
    (tmp_path / "s.toml").write_text("idle_connection_timeout_secs = 300\n" + limits)
    out = {}
    for mode in ("batch", "stream"):
        args = ["--input", str(tmp_path / "in"), "--config", str(tmp_path / "s.toml"), "--json-export", str(tmp_path / mode), "--span-export", str(tmp_path / f"{mode}-spans")]
        done = job.run(spark, job.arguments(args + (["--follow", str(tmp_path / "state"), "--once"] if mode == "stream" else [])))
        if mode == "stream":
            done.awaitTermination()
        out[mode] = sorted(r["value"] for r in spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / mode)).collect())
        spans = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / f"{mode}-spans")).collect()
        assert len(spans) == len(out[mode]) and all(len(json.loads(r["value"])["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["traceId"]) == 32 for r in spans)
    assert out["batch"] == out["stream"] and out["batch"] and (limits or len(out["batch"]) == 60)


def test_a_batch_that_comes_again_leaves_no_duplicate(spark, tmp_path):
    settings = config.Settings(json_export_path=str(tmp_path / "json"), span_export_path=str(tmp_path / "spans"))
    settings.otlp.enabled = True
    shape = "protocol string, direction string, timestamp_ns long, latency_ns long, method string, path string, status long, content_type string, payload_text string, headers array<struct<name: string, value: string>>, request_size_bytes long, response_size_bytes long"
    batch = spark.createDataFrame([("http1", "ingress", 5, 3, "GET", "/", 200, None, None, None, 1, 2)], shape)
    for number in (0, 1, 1, 0, 2):
        job.write(batch, settings, number)
    assert spark.read.text(str(tmp_path / "json")).count() == 3 and spark.read.text(str(tmp_path / "spans")).count() == 3


def test_all_log_lines_are_shown(spark, capsys):
    rows = spark.range(1500).selectExpr("'http1' AS protocol", "id AS timestamp_ns", "id AS latency_ns", "'GET' AS method", "'/' AS path", "200L AS status")
    job.write(rows, config.Settings(log_events=True))
    assert len(capsys.readouterr().out.splitlines()) == 1500


def test_counters_of_the_job_and_the_report(spark, tmp_path):
    said, now = [], [0.0]
    report = live.Report(10.0, said.append, lambda: now[0])
    row = lambda **n: SimpleNamespace(asDict=lambda: n)
    progress = lambda **places: SimpleNamespace(progress=SimpleNamespace(observedMetrics=places))
    report.onQueryProgress(progress(received=row(events_received=100), admitted=row(events_admitted=100), messages=row(rows=50, drops_parser_error=2)))
    assert said == []
    now[0] = 11.0
    report.onQueryProgress(progress(received=row(events_received=100), admitted=row(events_admitted=80), other=row(x=1)))
    assert said == ["WARNING: over 5 % dropped: events_received=200 events_dropped=22 events_processed=178 drops_rate_limit=20 drops_parser_error=2"]
    report.onQueryTerminated(None)
    assert said[-1] == "nothing new"
    capture.register(spark)
    rows = fixtures.packets(spark, "/root/testdata/sf0.001", "redis").filter("socket_cookie < 20")
    broken = rows.filter("seq = 0").limit(2).withColumns({"payload": F.lit(b"*1\r\n$x\r\n"), "payload_len": F.lit(8).cast("long"), "socket_cookie": F.col("socket_cookie") + 900})
    rows.unionByName(broken).write.format("capture").mode("append").option("path", str(tmp_path / "in")).save()
    totals = job.run(spark, job.arguments(["--input", str(tmp_path / "in"), "--json-export", str(tmp_path / "out")])).totals()
    assert totals["events_received"] == rows.count() + 2 and totals["drops_parser_error"] == 2 and totals["drops_rate_limit"] == 0 and totals["events_processed"] == rows.count()
    assert export.L7


def test_the_job_builds_the_graph(spark, tmp_path):
    capture.register(spark)
    held.use_keyed_state(spark)
    base = fixtures.packets(spark, "/root/testdata/sf0.001", "redis").filter("socket_cookie < 30").withColumn("timestamp_ns", (F.col("socket_cookie") * 3 + F.col("seq") + 500) * 20_000_000)
    names = fixtures.packets(spark, "/root/testdata/sf0.001", "dns").filter("socket_cookie between 200 and 203").withColumn("timestamp_ns", (F.col("socket_cookie") % 10 + F.col("seq") + 10) * 1_000_000)
    far = base.limit(1).withColumns({"timestamp_ns": F.lit(10**15), "socket_cookie": F.lit(1000).cast("long"), "payload": F.lit(b"x"), "payload_len": F.lit(1).cast("long")})
    base.unionByName(names).unionByName(far).coalesce(1).write.format("capture").mode("append").option("path", str(tmp_path / "in")).save()
    (tmp_path / "s.toml").write_text("idle_connection_timeout_secs = 300\n[graph]\nstale_edge_timeout_secs = 100000\n")
    edges = {}
    for mode in ("batch", "stream"):
        args = job.arguments(["--input", str(tmp_path / "in"), "--config", str(tmp_path / "s.toml"), "--edges", str(tmp_path / mode)] + (["--follow", str(tmp_path / "state"), "--once"] if mode == "stream" else []))
        done = job.run(spark, args)
        if mode == "stream":
            done.awaitTermination()
        found = job.current_edges(job.EdgeTable(spark, f"{tmp_path / mode}/edges"), job.settings_of(args))
        edges[mode] = sorted((r["src"], r["dst"], r["protocol"], r["request_count"], r["last_seen"]) for r in found.collect())
    assert edges["batch"] == edges["stream"] and sum(e[3] for e in edges["batch"] if e[2] == "redis") == 30 and any(e[2] == "dns" for e in edges["batch"])


def test_the_job_asks_a_service(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
            asked.append(text)
            self.send_response(500 if "fail" in text else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"entities": [{"category": "dob", "start": 0, "end": 3, "confidence": 0.9}, {"category": "email", "start": 4, "end": 5, "confidence": 0.1}]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/scan"
    settings = config.parse(f'pii_external_url_allowlist = ["{url}"]\n[pii.mode]\nkind = "external"\nurl = "{url}"\nsample_rate = 1.0\ntimeout_ms = 5000\n')
    rows = spark.createDataFrame([(1, "Ann was here"), (2, "Ann was here"), (3, "fail Ann"), (4, None), (5, ""), (6, "a@b.co x")], "id long, payload_text string")
    got = {r["id"]: r["pii"] and [(e["category"], e["text"]) for e in r["pii"]["entities"]] for r in job.scanned(rows, settings).collect()}
    assert got == {1: [("DATE_OF_BIRTH", "Ann")], 2: [("DATE_OF_BIRTH", "Ann")], 3: None, 4: None, 5: None, 6: [("EMAIL", "a@b.co")]}
    assert sorted(set(asked)) == ["Ann was here", "a@b.co x", "fail Ann"] and asked.count("Ann was here") == 1 and asked.count("fail Ann") == 2
    settings.pii_external_url_allowlist = ["https://elsewhere.example"]
    with pytest.raises(ValueError, match="allowlist"):
        job.scanned(rows, settings)
    server.shutdown()


def test_states_of_many_keys_cost_few_calls():
    bucket = Bucket(Last, ["at"], ["key", "at", "n"])
    bucket.add([(f"k{i % 5000}", i * SECOND // 20_000, 0) for i in range(10_000)])
    bucket.handle.stores["states"].trips = 0
    out = bucket.pass_(1000)
    assert sorted(r["n"] for r in out) == [1] * 5000 + [2] * 5000
    assert bucket.handle.stores["states"].trips <= 200  # by page, not by key


def test_a_long_batch_that_does_not_wait_is_folded_in_parts():
    bucket = Bucket(Last, ["at"], ["key", "at", "n"], is_held=False)
    rows = [(f"k{i % 50}", i, 0) for i in range(25_000)]
    random.Random(3).shuffle(rows)
    out = bucket.add(rows)
    assert sorted((r["key"], r["at"], r["n"]) for r in out) == sorted((f"k{i % 50}", i, i // 50 + 1) for i in range(25_000))
    assert bucket.handle.stores["waiting"].trips > 0 and not bucket.handle.stores["waiting"]


def test_slots_of_few_events_share_an_entry():
    bucket = Bucket(Last, ["at"], ["key", "at", "n"])
    times = [i * 7 * SECOND for i in range(10_000)]
    random.Random(5).shuffle(times)
    assert bucket.add([(f"k{t}", t, t) for t in times]) == []
    waiting = bucket.handle.stores["waiting"]
    assert waiting.trips <= 40  # 10,000 when each slot had its own
    got = []
    for ms in (1_000, 20_000_500, 20_000_900, 50_000_000):
        now = bucket.pass_(ms)
        assert max([r["at"] for r in now], default=0) < ms * 1_000_000
        got += now
    assert [r["at"] for r in got if r["n"] == 1] == sorted(t for t in times if t < 50_000 * SECOND)
    got += bucket.pass_(10**9)
    assert sorted(r["at"] for r in got if r["n"] == 1) == sorted(times) and not waiting and not bucket.handle.stores["states"] and not bucket.handle.timers
    assert waiting.trips <= 150


def test_a_name_that_comes_back_had_no_address_before():
    bucket = Bucket(functools.partial(folds.AddressFold, 1), ["__domain", "__address", "__ttl"], ["domain", "address", "since"])
    bucket.add([("a", 0, "a", 1, 2 * SECOND), ("a", 2 * SECOND, "a", 1, 2 * SECOND), ("a", 9 * SECOND, "a", 1, SECOND), ("a", 20 * SECOND, "a", 2, SECOND)])
    got = [(r["domain"], r["address"], r["since"] // SECOND) for r in bucket.pass_(60_000)]
    assert [(d, None if a != a else a, t) for d, a, t in got] == [("a", 1, 0), ("a", None, 4), ("a", 1, 9), ("a", None, 10), ("a", 2, 20), ("a", None, 21)]


def test_units_of_time(spark):
    rows = spark.readStream.format("rate").load().selectExpr("value as k", "value as at")
    held.use_keyed_state(spark)
    with pytest.raises(ValueError, match="unit"):
        held.held_fold(rows, F.col("k"), Last, rows.schema, "1 second", ts="at", unit_ns=1000)


def test_a_key_stays_while_its_events_wait():
    """The watermark stands inside a slot: what lies before it in that slot has not been folded yet."""
    bucket = Bucket(functools.partial(folds.NameFold, 1, ["row"]), ["__kind", "__domain", "__ttl", "row"], ["row", "domain"], slot_ns=10 * SECOND)
    bucket.add([("10", 0, 0, "a", 13 * SECOND, 0), ("10", 12 * SECOND, 1, None, 0, 1)])
    assert bucket.pass_(15_000) == []
    assert [(r["row"], r["domain"]) for r in bucket.pass_(60_000)] == [(1, "a")]
    assert not bucket.handle.stores["states"] and not bucket.handle.timers
