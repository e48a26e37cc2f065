"""Flows over streams, with windows and a watermark, and edges by batch. What needs the order of events is in `folds`."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators import graph

def flow_stream(observations: DataFrame, event_time: str = "event_time", window: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Flows by window of event time; a window is final once the watermark has passed it, and what comes later is dropped."""
    return graph.flows(observations.withWatermark(event_time, late), F.window(event_time, window))


class EdgeTable:
    """Edges that every batch of flows is merged into, in buckets by their key. A batch reads and writes only the buckets that its
    flows fall into; then a manifest, which says for each bucket the batch that wrote it last, makes the batch count. So a
    query that starts again goes on from the last manifest, and what no manifest names was never there. The last KEPT stay."""

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The batches that count and are still kept, in order."""
        root, store = self._at("manifests")
        if not store.exists(root):
            return []
        names = [str(x.getPath().getName()) for x in store.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "m" and n[1:].isdigit())

    def _manifest(self, version: int) -> dict[int, int]:
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/m{version}").collect())  # a line, with a number for each bucket
        return {int(b): v for b, v in json.loads(text).items()}

    def _publish(self, version: int, manifest: dict[int, int]) -> None:
        """Writes a manifest beside its place and moves it there, so it is whole or absent."""
        where, store = self._at(f"manifests/m{version}")
        beside, _ = self._at(f"manifests/.m{version}")
        out = store.create(beside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        store.rename(beside, where)

    def _rows(self, manifest: dict[int, int], wanted: set[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(manifest.items()) if wanted is None or b in wanted]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The edges as of the last manifest; None before the first."""
        found = self.versions()
        return self._rows(self._manifest(found[-1])) if found else None

    def upsert(self, flow_rows: DataFrame, batch: int) -> None:
        """For foreachBatch. A batch that comes again after it counted changes nothing."""
        found = self.versions()
        if found and batch <= found[-1]:
            return
        if dict(flow_rows.dtypes)["window"].startswith("struct"):
            flow_rows = flow_rows.withColumn("window", F.unix_seconds("window.start"))
        bucket = F.pmod(F.xxhash64(*graph.EDGE_KEY), F.lit(self.buckets))
        flow_rows = flow_rows.persist()
        touched = {r["bucket"] for r in flow_rows.select(bucket.alias("bucket")).distinct().collect()}
        manifest = self._manifest(found[-1]) if found else {}
        if touched:
            merged = graph.merged_edges(flow_rows, self._rows(manifest, touched)).drop("mean_latency_ns")
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{batch}")
        self._publish(batch, manifest | dict.fromkeys(touched, batch))
        flow_rows.unpersist()
        kept = [*found, batch][-self.KEPT:]
        named = {x for v in kept for x in self._manifest(v).items()}
        for old in found[:max(0, len(found) + 1 - self.KEPT)]:
            for b, v in self._manifest(old).items():
                if (b, v) not in named:
                    where, store = self._at(f"data/v{v}/bucket={b}")
                    store.delete(where, True)
            where, store = self._at(f"manifests/m{old}")
            store.delete(where, False)


def edge_stream(flow_rows: DataFrame, table: EdgeTable, checkpoint: str, **trigger):
    """Starts a query that merges every batch of final flows (append mode) into the table."""
    return flow_rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(table.upsert).trigger(**trigger).start()
