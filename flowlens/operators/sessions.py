"""Sessions: parsing of a connection's bytes in order, idle gaps, and eviction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowlens import codecs, schema
from flowlens.functions import network
from flowlens.functions.detect import detect_bytes
from flowlens.session import gathered, ship, whole_spread

TRANSPORT = [f.name for f in schema.TRANSPORT_FIELDS]
INPUT = ["session_key", "timestamp_ns", "seq", "event_type", "direction", "payload", *TRANSPORT]


class SessionRunner:
    """What is known of one connection. Plain attributes only, so that it can be stored between batches.

    The protocol is looked for on every payload until it is found. An error, a close or an idle gap ends the session, and
    the next payload begins a new one.
    """

    def __init__(self, idle_ns: int = schema.IDLE_SECONDS * 1_000_000_000):
        self.idle_ns = idle_ns
        self.codec: codecs.Codec | None = None
        self.last = 0
        self.made = 0

    def feed(self, event: dict) -> list[dict]:
        """The rows that an event completes."""
        found = self.step(event["timestamp_ns"], event["event_type"] == "SockClose", event.get("direction") == "Egress", event["payload"], event.get("src_port"), event.get("dst_port"))
        return [self._row(event, *each) for each in found]

    def step(self, now: int, closes: bool, egress: bool, payload: bytes | None, src_port: int | None, dst_port: int | None) -> list[tuple]:
        """The same, as message, number, state, version and error, without what is known of the event anyway."""
        if self.codec and now - self.last > self.idle_ns:
            self.codec = None
        self.last = now
        if closes:
            self.codec = None
            return []
        if not payload:
            return []
        if self.codec is None:
            self.codec = codecs.create(detect_bytes(payload, src_port, dst_port) or "")
            if self.codec is None:
                return []
        try:
            found = self.codec.feed(payload, egress, now)
        except codecs.CodecError as error:
            protocol, self.codec = self.codec.protocol, None
            self.made += 1
            return [(codecs.message(protocol, now, headers=None), self.made - 1, "error", None, str(error))]
        if not found:
            return []
        first, self.made = self.made, self.made + len(found)
        return [(m, first + i, self.codec.state, self.codec.version, None) for i, m in enumerate(found)]

    @staticmethod
    def _row(event: dict, message: dict, number: int, state: str, version: str | None, error: str | None) -> dict:
        row = {k: event[k] or None for k in TRANSPORT} | message | {"session_key": event["session_key"], "msg_no": number, "state": state, "protocol_version": version, "error": error}
        row["tls_library"] = schema.TLS_NAMES.get(event["tls_library"])
        if row["headers"] is not None:
            row["headers"] = [{"name": k, "value": v} for k, v in row["headers"]]
        return row


def _pairs(cells: list[list[tuple[str, str]] | None], kind: pa.ListType) -> pa.Array:
    """Headers as a column."""
    flat = [pair for cell in cells for pair in cell or ()]
    ends = np.cumsum([0, *(len(cell or ()) for cell in cells)])
    pairs = pa.StructArray.from_arrays([pa.array([pair[i] for pair in flat], pa.string()) for i in (0, 1)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=kind, mask=pa.array([cell is None for cell in cells], pa.bool_()))


def _rows(batch: pa.RecordBatch, places: list[int], found: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    """What SessionRunner.step found, with the events at these places of the batch, column by column."""
    events, columns = batch.select(["session_key", *TRANSPORT]).take(pa.array(places, pa.int64())), []
    messages, *rest = zip(*found, strict=True) if found else ((),) * 5
    own = dict(zip(("msg_no", "state", "protocol_version", "error"), rest, strict=True))
    for field in shape:
        if field.name == "session_key" or field.name in TRANSPORT:
            columns.append(events.column(field.name))
        elif field.name == "headers":
            columns.append(_pairs([m["headers"] for m in messages], field.type))
        else:
            columns.append(pa.array(own[field.name] if field.name in own else [m[field.name] for m in messages], field.type))
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def _values(column: pa.Array) -> list:
    """to_pylist, by way of NumPy where that gives the same: it takes a tenth of the time."""
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def parse_sessions(events: DataFrame, idle_ns: int = schema.IDLE_SECONDS * 1_000_000_000) -> DataFrame:
    """The messages in events (columns INPUT), as schema.SESSION_ROW.

    Events are dealt by session and sorted by time and sequence; the parser streams over them, so it holds one session's
    buffers, never a session's events. A session is sequential by nature: a busy one is not split.
    """
    ship(events.sparkSession)
    shape = to_arrow_schema(schema.SESSION_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runner = None, None
        for batch in gathered(batches):
            places, found = [], []
            fields = [_values(batch.column(c)) for c in ("session_key", "timestamp_ns", "payload", "src_port", "dst_port", "closes", "egress")]
            for i, (session, now, payload, src, dst, closes, egress) in enumerate(zip(*fields, strict=True)):
                if runner is None or session != key:
                    key, runner = session, SessionRunner(idle_ns)
                for each in runner.step(now, closes, egress, payload, src, dst):
                    places.append(i)
                    found.append(each)
            yield _rows(batch, places, found, shape)

    # codes and names are settled before the shuffle, so narrower rows are sorted, and Python reads no strings
    known = {c: network.null_if_zero(F.col(c)) for c in TRANSPORT} | {"tls_library": network.tls_name(F.col("tls_library"))}
    narrow = events.select("session_key", "timestamp_ns", "seq", (F.col("event_type") == "SockClose").alias("closes"), (F.col("direction") == "Egress").alias("egress"), "payload", *[known[f.name].cast(f.dataType).alias(f.name) for f in schema.TRANSPORT_FIELDS])
    ordered = narrow.repartition(whole_spread(events.sparkSession), "session_key").sortWithinPartitions("session_key", "timestamp_ns", "seq")
    return ordered.mapInArrow(run, schema.SESSION_ROW)


def idle_sessions(events: DataFrame, key: str, ts: str, gap: Column | int, order: list[str]) -> DataFrame:
    """events with `session_no`, from 1 for each key: a new one begins after a silence of more than gap."""
    over = Window.partitionBy(key).orderBy(ts, *order)
    breaks = F.when(F.col(ts) - F.lag(ts).over(over) > gap, 1).otherwise(0)
    return events.withColumn("__break", breaks).withColumn("session_no", F.sum("__break").over(over) + 1).drop("__break")


def capacity_level(live: Column, capacity: int) -> Column:
    """How full a table of sessions is: `ok`, `warning` from 80 % on, `critical` from 95 % on (shares of whole sessions)."""
    return F.when(live >= capacity * 95 // 100, "critical").when(live >= capacity * 80 // 100, "warning").otherwise("ok")


def evicted(sessions: DataFrame, capacity: int, last_seen: str = "last_seen", key: str = "session_key") -> DataFrame:
    """The sessions that give way where only `capacity` are kept: those seen last the longest ago."""
    kept = sessions.orderBy(F.desc(last_seen), F.desc(key)).limit(capacity)
    return sessions.join(kept.select(key), key, "left_anti")
