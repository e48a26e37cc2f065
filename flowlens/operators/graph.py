"""The service graph: windowed flows, edges that flows are merged into, and what is asked of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions import network, templates
from flowlens.session import ship

FLOW_KEY, EDGE_KEY = ["src", "dst", "protocol", "template"], ["src", "dst", "protocol"]


def observed(messages: DataFrame, faithful: bool = False) -> DataFrame:
    """messages (with addresses, ports, src_domain and dst_domain) as observations: src and dst by name, client first, and
    template. A message seen from the server's side is turned round as a whole; faithful turns only its ports."""
    protocol, sp, dp = F.col("protocol"), F.col("src_port"), F.col("dst_port")
    swap = F.coalesce(network.swapped(protocol, sp, dp), F.lit(False))
    client_port, server_port = network.server_ports(protocol, sp, dp)
    turn = F.lit(False) if faithful else swap

    def end(here: str, there: str, port: Column) -> Column:
        pick = lambda c: F.when(turn, F.col(f"{there}_{c}")).otherwise(F.col(f"{here}_{c}"))
        return network.identity_name(pick("domain"), pick("addr"), port)

    path = F.when(protocol.isin(*templates.SQL), F.coalesce("path", "payload_text")).otherwise(F.col("path"))
    return messages.withColumns({"src": end("src", "dst", client_port), "dst": end("dst", "src", server_port), "template": templates.request_template(protocol, F.col("method"), path)})


def flows(observations: DataFrame, window: Column) -> DataFrame:
    """One row for each flow (source, destination, protocol, template) and window.

    An error is a status of 400 or more, whatever the protocol. Missing latencies are passed over. window: a column, such
    as F.window(event_time, '10 seconds') or a bucket number.
    """
    return observations.groupBy(window.alias("window"), *FLOW_KEY).agg(
        F.count("*").alias("request_count"), F.count_if(F.coalesce(F.col("status") >= 400, F.lit(False))).alias("error_count"), F.count_if(F.coalesce(F.col("has_pii"), F.lit(False))).alias("pii_hit_count"),
        F.sum("request_size_bytes").alias("total_request_bytes"), F.sum("response_size_bytes").alias("total_response_bytes"), F.coalesce(F.sum("latency_ns"), F.lit(0).cast("long")).alias("latency_sum_ns"),
        F.coalesce(F.max("latency_ns"), F.lit(0).cast("long")).alias("latency_max_ns"), F.min("timestamp_ns").alias("first_seen"), F.max("timestamp_ns").alias("last_seen"))


def active_flows(observations: DataFrame, window: Column) -> DataFrame:
    return observations.select(window.alias("window"), *FLOW_KEY).distinct().groupBy("window").agg(F.count("*").alias("active_flows"))


def _average(steps: DataFrame) -> DataFrame:
    """The moving average of each edge: steps (EDGE_KEY, __place, avg) are taken in order of __place, the first as it is, each
    further one by half; a null step is passed over. They stream by, so an edge of any number of flows is one number."""
    ship(steps.sparkSession)
    ordered = steps.repartition(*EDGE_KEY).sortWithinPartitions(*EDGE_KEY, "__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = None, 0
        shape = ["src", "dst", "protocol", "avg_latency_ns"]
        kinds = [pa.string()] * 3 + [pa.int64()]
        for batch in batches:
            out = []
            for src, dst, protocol, step in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (src, dst, protocol) != key:
                    if key is not None:
                        out.append((*key, value))
                    key, value = (src, dst, protocol), step or 0
                elif step is not None:
                    value = (value + step) // 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], shape)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*key, value), kinds, strict=True)], shape)

    return ordered.select(*EDGE_KEY, "avg").mapInArrow(run, "src string, dst string, protocol string, avg_latency_ns long")


def merged_edges(flow_rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Edges (source, destination, protocol) with these flows merged in: counts add up, and the average latency moves half
    way to that of each flow that has one, in the order of window and template.

    The average depends on that order, so it is folded in order, streaming; all else folds before it shuffles.
    mean_latency_ns is the exact mean over the batch.
    """
    found = flow_rows.groupBy(*EDGE_KEY).agg(
        F.sum("request_count").alias("request_count"), F.sum("error_count").alias("error_count"), F.sum("pii_hit_count").alias("pii_hit_count"), F.max("latency_max_ns").alias("max_latency_ns"),
        F.max("last_seen").alias("last_seen"), F.expr("sum(latency_sum_ns) div sum(request_count)").alias("mean_latency_ns"))
    step = F.expr("if(request_count > 0 and latency_sum_ns > 0, latency_sum_ns div request_count, null)")
    steps = flow_rows.select(*EDGE_KEY, F.struct(F.lit(1).alias("since"), "window", "template").alias("__place"), step.alias("avg"))
    if base is None:
        return found.join(_average(steps), EDGE_KEY)
    place = F.struct(F.lit(0).alias("since"), F.lit(None).cast(flow_rows.schema["window"].dataType).alias("window"), F.lit(None).cast("string").alias("template"))
    averages = _average(steps.unionByName(base.select(*EDGE_KEY, place.alias("__place"), F.col("avg_latency_ns").alias("avg"))))
    old = base.select(*EDGE_KEY, *[F.col(c).alias(f"old_{c}") for c in ("request_count", "error_count", "pii_hit_count", "max_latency_ns", "last_seen")])
    add = lambda c: (F.coalesce(F.col(f"old_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c)
    return old.join(found, EDGE_KEY, "full").join(averages, EDGE_KEY).select(
        *EDGE_KEY, add("request_count"), add("error_count"), add("pii_hit_count"), "avg_latency_ns", F.greatest("old_max_latency_ns", "max_latency_ns").alias("max_latency_ns"), F.greatest("old_last_seen", "last_seen").alias("last_seen"))


def pruned(edges: DataFrame, now: int, most_age: int) -> DataFrame:
    """Edges seen within most_age of now; nodes() of them leaves out what lost its last edge."""
    return edges.filter(F.col("last_seen") >= max(0, now - most_age))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node)


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node)


def adjacency(edges: DataFrame) -> DataFrame:
    """Each node with its targets, sorted; those of an edge in several protocols once."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def top_error_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.filter("error_count > 0").orderBy(F.desc("error_count"), *EDGE_KEY).limit(n)
