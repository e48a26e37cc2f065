"""The engine as a job: `python -m flowlens --input FOLDER [--config FILE] ...` or by spark-submit.

Captured events come from a folder (capture files or a table format), are let in as the settings say, parsed, scanned and
written. With --follow the folder is followed as a stream; else what is there is handled once.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from flowlens import config, schema
from flowlens.functions import pii, urls
from flowlens.operators import graph, ingest, joins, privacy, sessions
from flowlens.sinks import export
from flowlens.sources import capture
from flowlens.streaming import folds, live
from flowlens.streaming.held import use_keyed_state
from flowlens.streaming.pipeline import EdgeTable


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("flowlens")
    parser.add_argument("--input", required=True, help="folder of captured events")
    parser.add_argument("--format", default="capture", help="capture, or a table format of Spark")
    parser.add_argument("--config", default=os.environ.get("FLOWLENS_CONFIG"), help="TOML file of settings")
    parser.add_argument("--json-export", help="folder for messages as JSON lines")
    parser.add_argument("--pii-audit-log", help="folder for audit rows")
    parser.add_argument("--log-events", action="store_true", help="show a line for each message")
    parser.add_argument("--follow", metavar="CHECKPOINT", help="follow the folder as a stream, with this folder for its state")
    parser.add_argument("--once", dest="trigger", action="store_const", const={"availableNow": True}, default={"processingTime": "1 second"}, help="with --follow: stop when all that is there was handled")
    parser.add_argument("--edges", help="folder for the service graph")
    parser.add_argument("--span-export", help="folder for spans, as OTLP requests in JSON, one a line")
    parser.add_argument("--smoke-test", action="store_true", help="check settings and input, and stop")
    parser.add_argument("--verbose", action="store_true", help="Spark's own messages too")
    return parser.parse_args(given)


def settings_of(args: argparse.Namespace) -> config.Settings:
    """The settings file, with the command line laid over it."""
    found = config.load(args.config) if args.config else config.Settings()
    found.json_export_path = args.json_export or found.json_export_path
    found.pii_audit_log_path = args.pii_audit_log or found.pii_audit_log_path
    found.edge_path = args.edges or found.edge_path
    if args.span_export:
        found.span_export_path, found.otlp.enabled = args.span_export, True
    found.log_events = found.log_events or args.log_events
    return found


def scanned(messages: DataFrame, settings: config.Settings) -> DataFrame:
    """Messages with their report on personal data, as the settings ask for it."""
    if not settings.pii.enabled:
        return messages
    text, none = F.col("payload_text"), F.array().cast(f"array<{pii.ENTITY}>")
    rows = messages.withColumn("__found", F.coalesce(pii.entities(text), none) if settings.pii.regex_enabled else none)
    mode = settings.pii.mode
    if mode.kind == "external" and mode.url:
        if not messages.sparkSession.range(1).select(urls.allowed(F.lit(mode.url), settings.pii_external_url_allowlist)).first()[0]:
            raise ValueError(f"{mode.url} is not in pii_external_url_allowlist")
        rows = privacy.with_service(rows, "payload_text", "__found", privacy.http_client(mode.url, mode.timeout_ms / 1000), mode.sample_rate, timeout_s=mode.timeout_ms / 1000)
    sure = F.filter("__found", lambda e: e["confidence"] >= F.lit(settings.pii.min_confidence).cast("float"))
    return rows.withColumn("pii", pii.report(text, sure, settings.pii.redact)).drop("__found")


def flows_of(messages: DataFrame, settings: config.Settings, answers: DataFrame | None = None) -> DataFrame:
    """Messages as flows by window, their ends by the name that an address had at the time. answers: what is known of names; else
    what the messages themselves tell."""
    second = 1_000_000_000
    dns = joins.dns_answers(messages.filter("protocol = 'dns'")) if answers is None else answers
    dns = dns.withColumn("ttl", F.least("ttl", F.lit(settings.graph.identity_cache_ttl_secs)) * second)
    rows = messages.withColumn("has_pii", F.col("pii").isNotNull() if "pii" in messages.columns else F.lit(False)).drop("pii")
    for end in ("src", "dst"):
        rows = joins.asof_domain(rows, dns, f"{end}_addr", "timestamp_ns", settings.graph.identity_cache_ttl_secs * second).withColumnRenamed("domain", f"{end}_domain")
    return graph.flows(graph.observed(rows), F.floor(F.col("timestamp_ns") / (settings.graph.aggregation_window_secs * second)))


def current_edges(table: EdgeTable, settings: config.Settings) -> DataFrame | None:
    """The edges of the graph that are not stale, as seen from the newest."""
    edges = table.read()
    if edges is None:
        return None
    newest = edges.agg(F.max("last_seen")).first()[0] or 0
    return graph.pruned(edges, newest, settings.graph.stale_edge_timeout_secs * 1_000_000_000)


def merge_edges(messages: DataFrame, settings: config.Settings, path: str, batch: int) -> None:
    """A batch's flows into the edge table. Its answers are kept beside, for the messages of later batches that they still hold for."""
    spark = messages.sparkSession
    joins.dns_answers(messages.filter("protocol = 'dns'")).write.mode("overwrite").parquet(f"{path}/names/batch={batch}")
    oldest = messages.agg(F.min("timestamp_ns")).first()[0] or 0
    known = spark.read.schema("domain string, ip long, ttl long, inserted_at long").parquet(f"{path}/names").filter(F.col("inserted_at") >= oldest - settings.graph.identity_cache_ttl_secs * 1_000_000_000)
    EdgeTable(spark, f"{path}/edges").upsert(flows_of(messages, settings, known), batch)


def write(messages: DataFrame, settings: config.Settings, batch: int | None = None) -> None:
    """Messages to all sinks that the settings name. A stream's batch has a folder of its own, which it fills anew when it comes
    again; else rows are added."""
    where = lambda path: path if batch is None else f"{path.rstrip('/')}/batch={batch}"
    mode = "append" if batch is None else "overwrite"
    if settings.json_export_path:
        export.write_json(messages, where(settings.json_export_path), mode=mode)
    if settings.pii_audit_log_path and "pii" in messages.columns:
        export.write_audit(privacy.audit_rows(messages.filter("pii is not null")), where(settings.pii_audit_log_path), mode=mode)
    if settings.otlp.enabled and settings.span_export_path:
        export.write_spans(messages, where(settings.span_export_path), settings.otlp.service_name, mode=mode)
    if settings.graph.enabled and settings.edge_path:
        merge_edges(messages, settings, settings.edge_path, batch or 0)
    if settings.log_events:
        for row in export.log_lines(messages).toLocalIterator():
            print(row["value"])


def run(spark: SparkSession, args: argparse.Namespace):
    """Handles the input once and returns its counters, or starts and returns a streaming query. Both let in and parse alike."""
    settings = settings_of(args)
    events = capture.events_source(spark, args.format, args.input, stream=bool(args.follow))
    if args.smoke_test:
        missing = sorted(set(schema.DATA_EVENT.names) - set(events.columns))
        if missing:
            raise ValueError(f"the input lacks {missing}")
        return None
    return _followed(spark, events, settings, args) if args.follow else _once(events, settings)


def _once(events: DataFrame, settings: config.Settings) -> live.Counters:
    idle = settings.idle_connection_timeout_secs * 1_000_000_000
    seen = {place: Observation(place) for place in ("received", "admitted", "messages", "scanned")}
    received = live.counted(ingest.considered(events, settings), "received", seen["received"])
    admitted = live.counted(ingest.limited(received, settings, ["seq"]), "admitted", seen["admitted"])
    parsed = live.counted(sessions.parse_sessions(admitted, idle), "messages", seen["messages"])
    messages = scanned(parsed.filter("error is null"), settings)
    if "pii" in messages.columns:
        messages = live.counted(messages, "scanned", seen["scanned"])
    else:
        seen.pop("scanned")
    messages = messages.persist()
    messages.count()  # the pass that is observed
    write(messages, settings)
    messages.unpersist()
    counters = live.Counters()
    for observation in seen.values():
        counters.add(observation.get)
    return counters


def _followed(spark: SparkSession, events: DataFrame, settings: config.Settings, args: argparse.Namespace):
    use_keyed_state(spark)
    # a source in Python is else taken in one batch, after which nothing runs that the watermark has let go
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    spark.streams.addListener(live.Report())
    late, idle = f"{settings.idle_connection_timeout_secs} seconds", settings.idle_connection_timeout_secs * 1_000_000_000
    rows = live.counted(ingest.considered(events, settings), "received")
    limits = []
    if settings.max_events_per_sec:
        limits.append(("limit", lambda r: folds.rate_limited_stream(r, settings.max_events_per_sec, late, order=["seq"])))
    if settings.sampling_mode == "head_only":
        limits.append(("head", lambda r: folds.head_only_stream(ingest.with_session_key(r), F.col("session_key"), "payload_len", settings.head_bytes, late, 2 * idle, ["seq"]).drop("session_key")))
    for name, limit in limits:  # each is a query of its own, as what it lets through is late for a second watermark
        rows = _staged(spark, limit(rows), f"{args.follow.rstrip('/')}-{name}", args.trigger)
    rows = ingest.with_session_key(rows)
    if settings.sampling_mode == "connection_sample":
        rows = ingest.connection_sample(rows, settings.sample_rate, F.col("session_key"))
    rows = live.counted(rows, "admitted")
    parsed = live.counted(folds.parse_session_stream(rows, idle, late=late, capacity=settings.max_connections_tracked or None), "messages")

    def sink(batch: DataFrame, number: int) -> None:
        rows = scanned(batch.filter("error is null"), settings).persist()  # several sinks, one pass over the state
        write(rows, settings, number)
        rows.unpersist()

    return parsed.writeStream.option("checkpointLocation", args.follow).foreachBatch(sink).trigger(**args.trigger).start()


def _staged(spark: SparkSession, rows: DataFrame, path: str, trigger: dict) -> DataFrame:
    """rows by way of a table that a query of its own writes, each batch once; a bounded run waits for it."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(**trigger).start()
    if "availableNow" in trigger:
        query.awaitTermination()
    return spark.readStream.schema(rows.schema).parquet(f"{path}/rows")


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.appName("flowlens").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    done = run(spark, args)
    if isinstance(done, live.Counters):
        print(done.line())
    elif done is not None:
        done.awaitTermination()


if __name__ == "__main__":
    main()
