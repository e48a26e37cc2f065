"""What leaves: JSON lines, the audit log, spans, metrics as text, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import schema
from flowlens.functions import network
from flowlens.operators.metrics import COUNTERS, GAUGES

L7 = [f.name for f in schema.L7_FIELDS]
TRANSPORT = [f.name for f in schema.TRANSPORT_FIELDS]


def json_rows(messages: DataFrame, redact_payload: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object a message, in column `value`: what is null is left out, as are empty headers; headers are pairs; a
    report's findings are written without the text found. redact_payload writes the redacted text in the payload's place. keep: columns
    that stay beside `value`."""
    have = messages.columns
    headers = F.transform("headers", lambda h: F.array(h["name"], h["value"]))
    columns = []
    for name in [*L7, *[c for c in TRANSPORT if c in have]]:
        column = F.col(name)
        if name == "headers":
            column = F.when(F.size("headers") > 0, headers)
        elif name == "payload_text" and redact_payload and "pii" in have:
            column = F.coalesce(F.col("pii.redacted_text"), column)
        columns.append(column.alias(name))
    if "pii" in have:
        shown = F.transform("pii.entities", lambda e: F.struct(*[e[c].alias(c) for c in ("category", "source", "start", "end", "confidence")]))
        columns.append(F.when(F.col("pii").isNotNull(), F.struct(shown.alias("entities"), F.col("pii.redacted_text").alias("redacted_text"), F.col("pii.scanned_bytes").alias("scanned_bytes"))).alias("pii"))
    return messages.select(*keep, F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("value"))


def write_json(messages: DataFrame, path: str, redact_payload: bool = False, mode: str = "overwrite") -> None:
    json_rows(messages, redact_payload).write.mode(mode).text(path)


def write_audit(audit: DataFrame, path: str, mode: str = "append") -> None:
    """Audit rows are only ever added; a stream's batch that comes again replaces its own folder."""
    audit.write.mode(mode).json(path)


def _attribute(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def spans(messages: DataFrame, boot_offset_ns: int = 0) -> DataFrame:
    """A span for each message: name, start and end (end null without a latency), and attributes, of which five may be missing."""
    shown = F.create_map(*[F.lit(x) for pair in schema.PROTOCOL_NAMES.items() for x in pair])
    optional = ["method", "path", "status", "content_type", "latency_ns"]
    attributes = F.array_compact(F.array(
        _attribute("flowlens.protocol", F.coalesce(F.try_element_at(shown, F.col("protocol")), F.lit("Unknown"))), _attribute("flowlens.direction", F.initcap("direction")),
        *[F.when(F.col(c).isNotNull(), _attribute(f"flowlens.{c}", F.col(c))) for c in optional], *[_attribute(f"flowlens.{c}", F.col(c)) for c in ("request_size_bytes", "response_size_bytes")]))
    start = F.col("timestamp_ns") + boot_offset_ns
    return messages.select(F.lit("flowlens.l7").alias("name"), start.alias("start_ns"), (start + F.col("latency_ns")).alias("end_ns"), network.wall_clock(F.col("timestamp_ns"), boot_offset_ns).alias("start_time"), attributes.alias("attributes"))


def otlp_lines(spans_: DataFrame, service_name: str = "flowlens") -> DataFrame:
    """Spans as trace export requests of OTLP in JSON, in column `value`: a request with one span on each line. Ids come from the
    span's content, so a span that is written again keeps them; 64-bit numbers are text, as the format has it."""
    text = lambda key, value: F.struct(key.alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    digest = F.md5(F.concat_ws("|", "name", F.col("start_ns").cast("string"), F.coalesce("end_ns", "start_ns").cast("string"), F.to_json("attributes")))
    span = F.struct(
        digest.alias("traceId"), F.substring(F.md5(F.concat(digest, F.lit("span"))), 1, 16).alias("spanId"), "name", F.lit(1).alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.coalesce("end_ns", "start_ns").cast("string").alias("endTimeUnixNano"),
        F.transform("attributes", lambda a: text(a["key"], a["value"])).alias("attributes"))
    resource = F.struct(F.array(text(F.lit("service.name"), F.lit(service_name))).alias("attributes"))
    scope = F.struct(F.struct(F.lit("flowlens").alias("name")).alias("scope"), F.array(span).alias("spans"))
    return spans_.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


def write_spans(messages: DataFrame, path: str, service_name: str = "flowlens", boot_offset_ns: int = 0, mode: str = "append") -> None:
    """Spans of messages, and of their findings where they have a report."""
    lines = otlp_lines(spans(messages, boot_offset_ns), service_name)
    if "pii" in messages.columns:
        from flowlens.operators.privacy import audit_rows

        lines = lines.unionByName(otlp_lines(finding_spans(audit_rows(messages.filter("pii is not null")), boot_offset_ns), service_name))
    lines.write.mode(mode).text(path)


def finding_spans(audit: DataFrame, boot_offset_ns: int = 0) -> DataFrame:
    """A span of no length for each finding, with its category and confidence."""
    at = F.col("timestamp_ns") + boot_offset_ns
    return audit.select(F.lit("flowlens.pii").alias("name"), at.alias("start_ns"), at.alias("end_ns"), network.wall_clock(F.col("timestamp_ns"), boot_offset_ns).alias("start_time"),
                        F.array(_attribute("flowlens.pii.category", F.col("category")), _attribute("flowlens.pii.confidence", F.col("confidence").cast("double"))).alias("attributes"))


def metrics_text(stats: DataFrame, parse_times: DataFrame | None = None) -> DataFrame:
    """One row of counters as lines of the text exposition format, in column `value`; with parse_times (le, n of
    metrics.histogram, and the values' sum in every row), the histogram's lines before the end."""
    lines = []
    for kind, names in (("counter", COUNTERS), ("gauge", GAUGES)):
        for name, helped in names.items():
            shown = f"flowlens_{name}" + ("_total" if kind == "counter" else "")
            lines += [F.lit(f"# HELP flowlens_{name} {helped}."), F.lit(f"# TYPE flowlens_{name} {kind}"), F.concat(F.lit(shown + " "), F.col(name).cast("string"))]
    end = F.lit("# EOF")
    if parse_times is None:
        return stats.select(F.explode(F.array(*lines, end)).alias("value"))
    name = "flowlens_parse_duration_seconds"
    bounds = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("le").try_cast("double"), F.lit(float("inf"))).alias("bound"), "le", "n")))  # a row for each bound
    head = [F.lit(f"# HELP {name} Seconds that decoding an event took."), F.lit(f"# TYPE {name} histogram")]
    buckets = parse_times.agg(bounds.alias("b"), F.max("n").alias("count"), F.max("sum").alias("sum"))
    shown = F.transform("b", lambda x: F.concat(F.lit(name + '_bucket{le="'), x["le"], F.lit('"} '), x["n"].cast("string")))
    tail = [F.concat(F.lit(f"{name}_sum "), F.col("sum").cast("string")), F.concat(F.lit(f"{name}_count "), F.col("count").cast("string"))]
    first = stats.select(F.posexplode(F.array(*lines)).alias("no", "value"))
    more = buckets.select(F.posexplode(F.concat(F.array(*head), shown, F.array(*tail, end))).alias("no", "value"))
    return first.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1))).orderBy("part", "no").select("value")


def health(stats: DataFrame) -> DataFrame:
    """One row: ready once anything was received, and the state as JSON."""
    return stats.select((F.col("events_received") > 0).alias("ready"), F.to_json(F.struct(*stats.columns)).alias("state"))


def log_lines(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A line for each message, for a console, in column `value`. keep: columns that stay beside it."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return messages.select(*keep, F.format_string("[%s] %s %s %s status=%s latency_ns=%s", F.col("timestamp_ns"), F.col("protocol"), dash("method"), dash("path"), dash("status"), dash("latency_ns")).alias("value"))
