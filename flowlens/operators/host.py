"""What happens on a host beside its packets: processes, TLS calls, socket calls, and the libraries that are mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowlens import schema
from flowlens.functions import procfs

#: Datagram calls are reported as the stream calls they resemble.
DATAGRAM_CALLS = {"UdpSend": "SockConnect", "UdpRecv": "SockAccept"}


def socket_events(calls: DataFrame) -> DataFrame:
    """Socket calls as events: what sends a datagram counts as a connect, what receives one as an accept."""
    kind = F.col("event_type")
    for call, event in DATAGRAM_CALLS.items():
        kind = F.when(F.col("event_type") == call, event).otherwise(kind)
    return calls.withColumn("event_type", kind)


def process_lifetimes(events: DataFrame) -> DataFrame:
    """A row for each start of a process (pid, tgid, ppid, comm, started_ns), with the end that comes next for its pid, if any.

    An end without a start is passed over; a pid that starts again before it ended has no end.
    """
    over = Window.partitionBy("pid").orderBy("timestamp_ns", "seq")
    following = events.filter(F.col("event_type").isin("ProcessExec", "ProcessExit")).withColumns({"__kind": F.lead("event_type").over(over), "__at": F.lead("timestamp_ns").over(over)})
    ended = F.when(F.col("__kind") == "ProcessExit", F.col("__at"))
    return following.filter("event_type = 'ProcessExec'").select("pid", "tgid", "ppid", "comm", F.col("timestamp_ns").alias("started_ns"), ended.alias("ended_ns"))


def tls_reads(calls: DataFrame) -> DataFrame:
    """TLS reads as events. calls: pid, tgid, timestamp_ns, seq, kind (entry or return), size (of a return) and payload.

    A return belongs to the entry of its thread that came before it, if none but that is between; one without an entry,
    and one that gives no bytes, is no event. The event has no socket: cookie and addresses are 0.
    """
    over = Window.partitionBy("pid", "tgid").orderBy("timestamp_ns", "seq")
    answered = calls.withColumn("__before", F.lag("kind").over(over)).filter("kind = 'return' and __before = 'entry' and size > 0")
    zero = F.lit(0).cast("long")
    return answered.select(
        "seq", "timestamp_ns", zero.alias("socket_cookie"), F.lit("TlsData").alias("event_type"), F.lit("Ingress").alias("direction"), "pid", "tgid", zero.alias("src_addr"), zero.alias("dst_addr"),
        F.col("size").cast("long").alias("payload_len"), F.lit("OpenSsl").alias("tls_library"), F.lit(0).alias("src_port"), F.lit(0).alias("dst_port"), F.lit(6).cast("short").alias("ip_proto"), "payload")


def tls_writes(calls: DataFrame) -> DataFrame:
    """TLS writes as events. calls: pid, tgid, timestamp_ns, seq, kind, size, payload and library (OpenSsl or GoTls).

    What a write hands over is there when it begins, so its entry is the event, whether it returns or not; one of no bytes is
    none. Of the payload what a capture record holds is kept. As with reads, there is no socket.
    """
    zero = F.lit(0).cast("long")
    return calls.filter("kind = 'entry' and size > 0").select(
        "seq", "timestamp_ns", zero.alias("socket_cookie"), F.lit("TlsData").alias("event_type"), F.lit("Egress").alias("direction"), "pid", "tgid", zero.alias("src_addr"), zero.alias("dst_addr"),
        F.col("size").cast("long").alias("payload_len"), F.col("library").alias("tls_library"), F.lit(0).alias("src_port"), F.lit(0).alias("dst_port"), F.lit(6).cast("short").alias("ip_proto"),
        F.substring("payload", 1, schema.MAX_PAYLOAD).alias("payload"))


def tls_calls(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """All TLS calls of processes as one table of events: both sides of what a process says in plaintext."""
    return tls_reads(reads).unionByName(tls_writes(writes))


def tls_libraries(maps: DataFrame, pattern: str = procfs.TLS_LIBRARY) -> DataFrame:
    """The TLS libraries that any process has mapped, each path once. maps: pid and content (the text of its maps).

    Returns path, base and pid of the least pid that has it.
    """
    each = maps.select("pid", F.inline(procfs.mapped_files(F.col("content")))).filter(F.col("path").rlike(pattern))
    return each.groupBy("path").agg(F.min(F.struct("pid", "base")).alias("first")).select("path", "first.base", "first.pid")


def new_targets(found: DataFrame, attached: DataFrame) -> DataFrame:
    """Libraries that are found and not attached yet."""
    return found.join(attached.select("path").distinct(), "path", "left_anti")


def still_attached(attached: DataFrame, found: DataFrame) -> DataFrame:
    """What is attached and still mapped by some process."""
    return attached.join(found.select("path").distinct(), "path", "left_semi")
