"""Counters over events and messages, and the checks of an exported table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.schema import BACKPRESSURE_SHARE

#: Counters by name, and the upper bounds of the parse-time histogram, in seconds.
COUNTERS = {
    "events_received": "Captured events that reached the engine", "events_dropped": "Events given up, for whatever reason", "events_processed": "Events that went through to the end",
    "drops_rate_limit": "Events over the token bucket's allowance", "drops_channel_full": "Events that a bounded queue had no place for", "drops_parser_error": "Events whose bytes could not be decoded",
    "pii_detections": "Findings of personal data",
}
GAUGES = {"active_connections": "Connections with state at this moment", "approx_pending": "Events received and neither processed nor given up, about"}
BOUNDS = (0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.1)
REQUIRED, LEAST_EVENTS = ("http1", "mysql", "postgres", "redis"), 5


def counters(events: DataFrame, reason: Column, connection: Column, pii: Column, by: list[Column] | None = None) -> DataFrame:
    """One row (for each `by`) of all counters. reason: null for a processed event, else rate_limit, channel_full or parser_error."""
    found = events.groupBy(*(by or [])).agg(
        F.count("*").alias("events_received"), F.count(reason).alias("events_dropped"), F.count_if(reason.isNull()).alias("events_processed"),
        *[F.count_if(reason.eqNullSafe(F.lit(r))).alias(f"drops_{r}") for r in ("rate_limit", "channel_full", "parser_error")],
        F.sum(pii.cast("long")).alias("pii_detections"), F.countDistinct(connection).alias("active_connections"))
    return with_pressure(found)


def with_pressure(stats: DataFrame) -> DataFrame:
    """Counters with what is pending, and whether so much was dropped that someone should look."""
    pending = F.greatest(F.col("events_received") - F.col("events_processed") - F.col("events_dropped"), F.lit(0).cast("long"))
    share = F.coalesce(F.try_divide(F.col("events_dropped"), F.col("events_received")), F.lit(0.0))
    return stats.withColumns({"approx_pending": pending, "backpressure": share > BACKPRESSURE_SHARE})


def histogram(values: DataFrame, value: Column, bounds: tuple[float, ...] = BOUNDS, with_sum: bool = False) -> DataFrame:
    """Cumulative counts: le (the bound, +Inf for all) and n; with_sum: the sum of the values too, in every row."""
    row = values.agg(*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"), F.sum(value).alias("sum"))
    pairs = [F.struct(F.lit(repr(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return row.select(F.inline(F.array(*pairs)), *["sum"] * with_sum)


def validation(messages: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Checks of exported messages, one row each: check, n, of, passed. One pass; the rows are unfolded from one row of counts."""
    protocol = F.lower("protocol")
    http, mysql, postgres, redis = protocol.isin("http1", "http2"), protocol == "mysql", protocol == "postgres", protocol == "redis"
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    wanted = {f"protocol_{p}": (protocol == p, None, "any") for p in required} | {
        "http_method_missing": (http & ~filled("method"), http, "half"), "http_path_missing": (http & ~filled("path"), http, "half"),
        "mysql_statement": (mysql & (filled("method") | filled("path") | filled("payload_text")), mysql, "some"), "postgres_statement": (postgres & (filled("method") | filled("path")), postgres, "some"),
        "redis_command": (redis & filled("method"), redis, "some"), "latency": (F.coalesce(F.col("latency_ns") > 0, F.lit(False)), None, "note"),
    } | {f"field_{c}": (F.col(c).isNotNull(), None, "any") for c in ("src_addr", "dst_addr", "src_port", "dst_port") if c in messages.columns}
    row = messages.agg(F.count("*").alias("all"), *[F.count_if(c).alias(f"{k}__n") for k, (c, _, _) in wanted.items()], *[(F.count("*") if of is None else F.count_if(of)).alias(f"{k}__of") for k, (_, of, _) in wanted.items()])
    checks = [F.struct(F.lit("events").alias("check"), F.col("all").alias("n"), F.col("all").alias("of"), (F.col("all") >= LEAST_EVENTS).alias("passed"))]
    for k, (_, _, rule) in wanted.items():
        n, of = F.col(f"{k}__n"), F.col(f"{k}__of")
        passed = {"any": n > 0, "half": n * 2 <= of, "some": (of == 0) | (n > 0), "note": F.lit(True)}[rule]
        checks.append(F.struct(F.lit(k).alias("check"), n.alias("n"), of.alias("of"), passed.alias("passed")))
    return row.select(F.inline(F.array(*checks)))
