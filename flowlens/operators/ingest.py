"""From captured events to those worth parsing: filters, routing, limits, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens import schema
from flowlens.config import Settings
from flowlens.functions import network
from flowlens.session import ship

PROCESS_EVENTS = ("ProcessExec", "ProcessExit")


def captured(events: DataFrame, enabled: bool = True) -> DataFrame:
    """Nothing, if capture is switched off; Catalyst then drops the scan itself."""
    return events if enabled else events.filter(F.lit(False))


def transport_only(packets: DataFrame) -> DataFrame:
    """TCP and UDP with a payload."""
    return packets.filter(F.col("ip_proto").isin(6, 17) & (F.col("payload_len") > 0))


def for_pids(events: DataFrame, pids: list[int] | DataFrame | None) -> DataFrame:
    """Events of these processes; all for None. A table of pids (column pid) is joined, so it may be of any size."""
    if pids is None:
        return events
    return events.join(pids.select("pid").distinct(), "pid", "left_semi") if isinstance(pids, DataFrame) else events.filter(F.col("pid").isin(*pids))


def routed(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Process starts (which call for a new scan of libraries), process ends, and all that carries traffic."""
    kind = F.col("event_type")
    return events.filter(kind == "ProcessExec"), events.filter(kind == "ProcessExit"), events.filter(~kind.isin(*PROCESS_EVENTS))


def with_session_key(events: DataFrame) -> DataFrame:
    return events.withColumn("session_key", network.session_key(F.col("socket_cookie"), F.col("event_type"), F.col("pid"), F.col("tgid")))


def with_worker(events: DataFrame, workers: int) -> DataFrame:
    return events.withColumn("worker", network.worker_of(F.col("socket_cookie"), workers))


def rate_limited(events: DataFrame, most: int, order: list[str], host: str | None = None, ts: str = "timestamp_ns", tick_ns: int = 100_000_000) -> DataFrame:
    """Events within a token bucket of event time: it holds `most` tokens, gains most // 10 each tick, and an event takes one.

    0 is no limit. There is a bucket for each host (one in all if None). Ticks are counted first, so only a row a tick is
    folded in order; the fold streams and keeps one number. Inside a tick, events are taken by `order`.
    """
    if most == 0:
        return events
    ship(events.sparkSession)
    rows = events.withColumns({"__host": F.col(host).cast("string") if host else F.lit(""), "__tick": F.floor(F.col(ts) / tick_ns).cast("long")})
    ticks = rows.groupBy("__host", "__tick").agg(F.count("*").alias("n")).repartition("__host").sortWithinPartitions("__host", "__tick")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host_now, last, tokens = None, 0, most
        for part in parts:
            out = []
            for name, tick, n in zip(part["__host"], part["__tick"], part["n"], strict=True):
                if name != host_now:
                    host_now, tokens = name, most
                else:
                    tokens = min(most, tokens + (tick - last) * (most // 10))
                last = tick
                out.append(min(n, tokens))
                tokens -= out[-1]
            yield pd.DataFrame({"__host": part["__host"], "__tick": part["__tick"], "__allowed": out})

    allowed = ticks.mapInPandas(fold, "__host string, __tick long, __allowed long")
    place = F.row_number().over(Window.partitionBy("__host", "__tick").orderBy(*order))
    return rows.withColumn("__place", place).join(allowed, ["__host", "__tick"]).filter("__place <= __allowed").select(*events.columns)


def within_capacity(events: DataFrame, capacity: int, order: list[str], workers: int, ts: str = "timestamp_ns", drain_ns: int = 1_000_000_000) -> DataFrame:
    """Events that bounded queues would take, were each worker's queue drained every drain_ns: `accepted` is false for the
    rest. Spark's own flow control never drops; this shows what a bounded queue would."""
    keyed = with_worker(events, workers).withColumn("__slot", F.floor(F.col(ts) / drain_ns))
    place = F.row_number().over(Window.partitionBy("worker", "__slot").orderBy(*order))
    return keyed.withColumn("accepted", place <= capacity).drop("__slot")


def connection_sample(events: DataFrame, rate: float, key: Column) -> DataFrame:
    """All events of a share of the connections; by the digest of the key, so a connection is in or out as a whole."""
    if rate >= 1:
        return events
    return events.filter(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") < int(max(rate, 0) * (1 << 32)))


def head_only(events: DataFrame, key: str, size: str, most_bytes: int, order: list[str]) -> DataFrame:
    """The first events of each connection, as long as their bytes come to most_bytes at most."""
    so_far = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("__so_far", so_far).filter(F.col("__so_far") <= most_bytes).drop("__so_far")


def considered(events: DataFrame, settings: Settings) -> DataFrame:
    """Events that the settings ask for: capture switched on, the processes of the filter, TCP and UDP with a payload (other event
    types pass). Row by row, so alike for tables and streams."""
    rows = for_pids(captured(events, settings.capture_enabled), settings.pid_filter)
    return rows.filter((F.col("event_type") != "TcPacket") | (F.col("ip_proto").isin(6, 17) & (F.col("payload_len") > 0)))


def limited(events: DataFrame, settings: Settings, order: list[str]) -> DataFrame:
    """Events within the token bucket and the sampling mode, with their session_key."""
    rows = with_session_key(rate_limited(events, settings.max_events_per_sec, ["timestamp_ns", *order]))
    if settings.sampling_mode == "connection_sample":
        return connection_sample(rows, settings.sample_rate, F.col("session_key"))
    if settings.sampling_mode == "head_only":
        return head_only(rows, "session_key", "payload_len", settings.head_bytes, ["timestamp_ns", *order])
    return rows


def admitted(events: DataFrame, settings: Settings, order: list[str]) -> DataFrame:
    """Events as the settings let them in."""
    return limited(considered(events, settings), settings, order)


def transport_context(events: DataFrame) -> DataFrame:
    """Where an event was seen; null for what is not known."""
    return events.withColumns({c: network.null_if_zero(F.col(c)) for c in ("src_addr", "dst_addr", "src_port", "dst_port", "pid")} | {"tls_library": network.tls_name(F.col("tls_library"))})


def decoded(records: DataFrame, record: str = "record") -> DataFrame:
    """Capture records (binary, little-endian, schema.RECORD_BYTES long) as event columns; a record of another length or with an unknown code is dropped."""
    raw = F.col(record)

    def unsigned(at: int, size: int) -> Column:
        # the bytes are in reverse order: the hex digits are turned round in pairs
        digits = F.concat(*[F.hex(F.substring(raw, F.lit(at + 1 + i), F.lit(1))) for i in range(size - 1, -1, -1)])
        value = F.conv(digits, 16, -10) if size == 8 else F.conv(digits, 16, 10)
        return value.cast("long")

    length = unsigned(40, 4)
    out = records.filter(F.octet_length(raw) == schema.RECORD_BYTES).select(
        *[c for c in records.columns if c != record],
        unsigned(0, 8).alias("timestamp_ns"), unsigned(8, 8).alias("socket_cookie"), network.named(unsigned(16, 4), schema.EVENT_TYPES).alias("event_type"),
        network.named(unsigned(20, 4), schema.DIRECTIONS).alias("direction"), unsigned(24, 4).alias("pid"), unsigned(28, 4).alias("tgid"), unsigned(32, 4).alias("src_addr"),
        unsigned(36, 4).alias("dst_addr"), length.alias("payload_len"), network.named(unsigned(44, 4), schema.TLS_LIBRARIES).alias("tls_library"), unsigned(48, 2).cast("int").alias("src_port"),
        unsigned(50, 2).cast("int").alias("dst_port"), unsigned(52, 1).cast("short").alias("ip_proto"), network.payload_slice(F.substring(raw, F.lit(57), F.lit(schema.MAX_PAYLOAD)), length).alias("payload"))
    return out.filter("event_type is not null and direction is not null and tls_library is not null")


def frame_counts(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """One row: all frames, and those of each IP version; what decode_frames drops as IPv6 is counted here."""
    kind = F.hex(F.substring(F.col(frame), F.lit(13), F.lit(2)))
    return frames.agg(F.count("*").alias("frames"), F.count_if(kind == "0800").alias("ipv4"), F.count_if(kind == "86DD").alias("ipv6"))


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Ethernet frames to addresses, ports and payload: IPv4 with TCP or UDP, all else dropped (ip_version tells IPv6 apart before that)."""
    raw = F.col(frame)

    def number(at: Column | int, size: int) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.conv(F.hex(F.substring(raw, at + 1, F.lit(size))), 16, 10).cast("long")

    head = number(14, 1).bitwiseAND(F.lit(15)) * 4 + 14
    rows = frames.withColumn("ip_version", F.when(number(12, 2) == 0x0800, 4).when(number(12, 2) == 0x86DD, 6)).filter("ip_version = 4")
    rows = rows.withColumns({"__l4": head.cast("int"), "ip_proto": number(23, 1).cast("short"), "src_addr": number(26, 4), "dst_addr": number(30, 4), "__total": number(16, 2)}).filter("ip_proto in (6, 17)")
    offset = F.when(F.col("ip_proto") == 6, F.shiftright(number(F.col("__l4") + 12, 1), 4) * 4).otherwise(8)
    rows = rows.withColumns({"src_port": number(F.col("__l4"), 2).cast("int"), "dst_port": number(F.col("__l4") + 2, 2).cast("int"), "__start": (F.col("__l4") + offset).cast("int")})
    rows = rows.withColumn("payload", F.substring(raw, F.col("__start") + 1, (F.col("__total") + 14 - F.col("__start")).cast("int")))
    return rows.withColumn("payload_len", F.octet_length("payload").cast("long")).filter("payload_len > 0").drop("__l4", "__total", "__start", frame)


def connections(events: DataFrame) -> DataFrame:
    """Open connections: of each key the latest of its connect, accept and close events, unless that is a close."""
    latest = events.filter(F.col("event_type").isin("SockConnect", "SockAccept", "SockClose")).groupBy("socket_cookie").agg(
        F.max_by(F.struct("event_type", "timestamp_ns", "src_addr", "dst_addr", "src_port", "dst_port", "pid", "tgid"), F.struct("timestamp_ns", "seq")).alias("last"))
    return latest.filter("last.event_type != 'SockClose'").select("socket_cookie", "last.*").drop("event_type").withColumnRenamed("timestamp_ns", "connect_ts")
