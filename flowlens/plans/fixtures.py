"""Network-shaped rows derived from plain tables, by rules that Spark and SQL state alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens import schema
from flowlens.plans import wire
from flowlens.session import gathered, ship, spread, table

HOUR_NS = 3_600_000_000_000

#: The messages of `events`, for DuckDB.
L7_SQL = """
base AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) * 1000 AS timestamp_ns FROM events),
l7 AS (
  SELECT event_id, user_id, k, timestamp_ns, 'svc-' || (user_id % 10) AS src, 'svc-' || ((user_id * 7 + 3) % 10) AS dst,
    CASE event_type WHEN 'click' THEN 'http1' WHEN 'view' THEN 'http2' WHEN 'purchase' THEN 'mysql' WHEN 'signup' THEN 'redis' ELSE 'kafka' END AS protocol,
    CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'GET' WHEN event_type = 'purchase' THEN 'SELECT' ELSE 'Produce' END AS method,
    CASE WHEN event_type IN ('click', 'view') THEN '/users/' || user_id || '/items/' || k WHEN event_type = 'purchase' THEN 'SELECT * FROM items WHERE id = ' || k || ' AND owner = ''u' || user_id || ''''
      WHEN event_type = 'signup' THEN 'user:' || user_id ELSE 'orders-' || (k % 4) END AS path,
    CASE WHEN event_type = 'error' THEN 500 + k % 4 WHEN event_type IN ('click', 'view') THEN 200 ELSE 0 END AS status,
    CAST(round(value * 1000) AS BIGINT) AS latency_ns, event_id % 1500 + 40 AS request_size_bytes, event_id % 9000 + 100 AS response_size_bytes, k % 10 = 0 AS has_pii
  FROM base)"""


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + F.hour(ts) * F.lit(3_600_000_000).cast("long") + F.minute(ts) * F.lit(60_000_000).cast("long") + seconds


def base_events(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The events' columns that messages are made of. parts: rows are dealt to so many parts before anything is computed."""
    rows = table(spark, sf_dir, "events")
    rows = rows.repartition(parts, "event_id") if parts else rows
    return rows.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), (epoch_micros(F.col("ts")) * 1000).alias("timestamp_ns"))


def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each event."""
    e, user, k = F.col("event_type"), F.col("user_id").cast("string"), F.col("k").cast("string")
    http = e.isin("click", "view")
    return base_events(spark, sf_dir).select(
        "event_id", "user_id", "k", "timestamp_ns", F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("src"), F.concat(F.lit("svc-"), ((F.col("user_id") * 7 + 3) % 10).cast("string")).alias("dst"),
        F.when(e == "click", "http1").when(e == "view", "http2").when(e == "purchase", "mysql").when(e == "signup", "redis").otherwise("kafka").alias("protocol"),
        F.when(http | (e == "signup"), "GET").when(e == "purchase", "SELECT").otherwise("Produce").alias("method"),
        F.when(http, F.concat(F.lit("/users/"), user, F.lit("/items/"), k)).when(e == "purchase", F.concat(F.lit("SELECT * FROM items WHERE id = "), k, F.lit(" AND owner = 'u"), user, F.lit("'")))
        .when(e == "signup", F.concat(F.lit("user:"), user)).otherwise(F.concat(F.lit("orders-"), (F.col("k") % 4).cast("string"))).alias("path"),
        F.when(e == "error", 500 + F.col("k") % 4).when(http, F.lit(200)).otherwise(F.lit(0)).cast("long").alias("status"),
        F.round(F.col("value") * 1000).cast("long").alias("latency_ns"), (F.col("event_id") % 1500 + 40).alias("request_size_bytes"), (F.col("event_id") % 9000 + 100).alias("response_size_bytes"),
        (F.col("k") % 10 == 0).alias("has_pii"))


def packets(spark: SparkSession, sf_dir: str, protocol: str, marked: bool = False) -> DataFrame:
    """The exchange of each event as capture events; a session for each event. marked: with the event's `k`, and `answers` on the
    first packet from the server.

    Events are dealt out first, as a small table is few row groups and an event many packets. Python makes the bytes only; what
    is the same for every packet, or follows from the event's number, is columns.
    """
    ship(spark)
    port = wire.EXCHANGES[protocol][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2_000):
            counts, made = [], []
            for n, k, ts in zip(*(c.to_numpy().tolist() for c in batch.columns), strict=True):
                exchange = wire.packets(protocol, n, k, ts)
                counts.append(len(exchange))
                made += exchange
            at, client, data = zip(*made, strict=True) if made else ((), (), ())
            events = np.repeat(batch.column(0).to_numpy(), counts)
            places = np.arange(len(made)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
            columns = {"seq": pa.array(places, pa.int64()), "timestamp_ns": pa.array(at, pa.int64()), "socket_cookie": pa.array(events, pa.int64()), "client": pa.array(client, pa.bool_()), "payload": pa.array(data, pa.binary())}
            if marked:
                whose = np.repeat(np.arange(len(counts)), counts)
                served = np.flatnonzero(~np.array(client, bool))
                answers = np.zeros(len(made), bool)
                answers[served[np.unique(whose[served], return_index=True)[1]]] = True
                columns |= {"k": pa.array(np.repeat(batch.column(1).to_numpy(), counts), pa.int64()), "answers": pa.array(answers)}
            yield pa.RecordBatch.from_pydict(columns)

    base = base_events(spark, sf_dir, spread(spark)).select("event_id", "k", "timestamp_ns")
    marks = ["k", "answers"] if marked else []
    made = base.mapInArrow(run, "seq long, timestamp_ns long, socket_cookie long, client boolean, payload binary" + (", k long, answers boolean" if marked else ""))
    n, client = F.col("socket_cookie"), F.col("client")
    user, server = 40000 + n % 1000, F.lit(port).cast("long")
    known = {
        "event_type": F.lit("TcPacket"), "direction": F.when(client, "Egress").otherwise("Ingress"), "pid": n % 100, "tgid": n % 100, "src_addr": F.lit(0x0A000001), "dst_addr": F.lit(0x0A000002),
        "payload_len": F.octet_length("payload"), "tls_library": F.lit("None"), "src_port": F.when(client, user).otherwise(server), "dst_port": F.when(client, server).otherwise(user), "ip_proto": F.lit(17 if protocol == "dns" else 6)}
    return made.select(*[(known[f.name].cast(f.dataType) if f.name in known else F.col(f.name)).alias(f.name) for f in schema.DATA_EVENT], *marks)
