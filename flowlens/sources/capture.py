"""Capture files: a header, then records of one length. A Spark data source (batch, stream and writer), and a reader for any store.

The file: a magic of 6 bytes, version, start time and record count (little-endian), then each record with its length
before it. Records are alike in size, so a file is split by record number, and parts are read side by side. As records are
mostly filling, a file may be packed as a whole with gzip (option compression, name *.cap.gz): such a one is read as one part,
and the writer begins a new file after maxRecordsPerFile records. Files of both kinds can be followed; a packed one counts as
its header says, so it must be whole when it gets its name.
"""

from __future__ import annotations

import gzip
import os
import struct
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from flowlens import schema
from flowlens.operators.ingest import decoded
from flowlens.session import ship

#: The format.
MAGIC, VERSION = b"PNCAP\x01", 1
HEADER = struct.Struct("<6sIQQ")
LENGTH = struct.Struct("<I")
RECORD = np.dtype([
    ("timestamp_ns", "<u8"), ("socket_cookie", "<u8"), ("event_type", "<u4"), ("direction", "<u4"), ("pid", "<u4"), ("tgid", "<u4"), ("src_addr", "<u4"), ("dst_addr", "<u4"),
    ("payload_len", "<u4"), ("tls_library", "<u4"), ("src_port", "<u2"), ("dst_port", "<u2"), ("ip_proto", "u1"), ("pad", "V3"), ("payload", f"V{schema.MAX_PAYLOAD}"),
])
STRIDE = LENGTH.size + RECORD.itemsize
#: A record with the length before it, its payload as bytes.
_FRAMED = np.dtype([("length", "<u4"), *((n, ("u1", schema.MAX_PAYLOAD) if n == "payload" else RECORD[n]) for n in RECORD.names)])
#: What zlib calls a member of a gzip file.
_GZIP = 16 + zlib.MAX_WBITS
_NUMBERS = ("timestamp_ns", "pid", "tgid", "src_addr", "dst_addr", "payload_len", "src_port", "dst_port", "ip_proto")
_CODES = {"event_type": schema.EVENT_TYPES, "direction": schema.DIRECTIONS, "tls_library": schema.TLS_LIBRARIES}


class CaptureError(ValueError):
    """The file is no capture file, or its records are damaged."""


def read_header(raw: bytes) -> tuple[int, int]:
    """Start time and record count."""
    if len(raw) < HEADER.size:
        raise CaptureError("truncated header")
    magic, version, started, count = HEADER.unpack(raw[:HEADER.size])
    if magic != MAGIC:
        raise CaptureError("bad magic")
    if version != VERSION:
        raise CaptureError(f"version {version}")
    return started, count


def read_records(raw: bytes, first_seq: int = 0) -> list[dict]:
    """The events in raw, which begins at a length. A rest too short for a length is the end; a record cut short is an error."""
    out = []
    for n, at in enumerate(range(0, len(raw) - LENGTH.size + 1, STRIDE)):
        if LENGTH.unpack_from(raw, at)[0] != RECORD.itemsize:
            raise CaptureError(f"record {first_seq + n}: bad length")
        if at + STRIDE > len(raw):
            raise CaptureError(f"record {first_seq + n}: truncated")
        r = np.frombuffer(raw, RECORD, 1, at + LENGTH.size)[0]
        codes = [(int(r["event_type"]), schema.EVENT_TYPES), (int(r["direction"]), schema.DIRECTIONS), (int(r["tls_library"]), schema.TLS_LIBRARIES)]
        if any(code >= len(names) for code, names in codes):
            raise CaptureError(f"record {first_seq + n}: unknown code")
        row = {k: int(r[k]) for k in ("timestamp_ns", "pid", "tgid", "src_addr", "dst_addr", "payload_len", "src_port", "dst_port", "ip_proto")}
        size = min(row["payload_len"], schema.MAX_PAYLOAD)
        out.append(row | {"seq": first_seq + n, "socket_cookie": int(r["socket_cookie"].view(np.int64)), "payload": r["payload"].tobytes()[:size]} | dict(zip(("event_type", "direction", "tls_library"), (names[code] for code, names in codes), strict=True)))
    return out


def record_bytes(event: dict) -> bytes:
    """An event as its record, with the length before it."""
    r = np.zeros(1, RECORD)
    payload = event["payload"] or b""
    if len(payload) > schema.MAX_PAYLOAD:
        raise CaptureError("payload too long")
    for k in ("timestamp_ns", "pid", "tgid", "src_addr", "dst_addr", "payload_len", "src_port", "dst_port", "ip_proto"):
        r[k] = event[k] or 0
    r["socket_cookie"] = event["socket_cookie"] % (1 << 64)
    for k, names in (("event_type", schema.EVENT_TYPES), ("direction", schema.DIRECTIONS), ("tls_library", schema.TLS_LIBRARIES)):
        r[k] = names.index(event[k])
    raw = r.tobytes()
    return LENGTH.pack(RECORD.itemsize) + raw[:RECORD.fields["payload"][1]] + payload + raw[RECORD.fields["payload"][1] + len(payload):]


def record_batch(raw: bytes, first_seq: int, shape: pa.Schema) -> pa.RecordBatch:
    """read_records as a batch, made by columns."""
    whole = len(raw) // STRIDE
    r = np.frombuffer(raw, _FRAMED, whole)
    sound = len(raw) - whole * STRIDE < LENGTH.size and (r["length"] == RECORD.itemsize).all() and (r["timestamp_ns"] < 1 << 63).all()
    if not sound or any((r[c] >= len(names)).any() for c, names in _CODES.items()):
        return pa.RecordBatch.from_pylist(read_records(raw, first_seq), schema=shape)  # it says what is wrong
    starts = range(STRIDE - schema.MAX_PAYLOAD, whole * STRIDE, STRIDE)
    columns = {c: pa.array(r[c].astype(np.int64)) for c in _NUMBERS} | {c: pa.array(names).take(pa.array(r[c])) for c, names in _CODES.items()} | {
        "seq": pa.array(np.arange(first_seq, first_seq + whole)), "socket_cookie": pa.array(r["socket_cookie"].astype(np.int64)),
        "payload": pa.array([raw[a:a + n] for a, n in zip(starts, np.minimum(r["payload_len"], schema.MAX_PAYLOAD).tolist(), strict=True)], pa.binary())}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in shape], schema=shape)


def batch_bytes(batch: pa.RecordBatch) -> bytes:
    """The events of a batch as their records, each as record_bytes gives it, made by columns."""
    r = np.zeros(batch.num_rows, _FRAMED)
    r["length"] = RECORD.itemsize
    for c in _NUMBERS:
        values, most = batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(RECORD[c]).max
        if ((values < 0) | (values.astype(np.uint64) > most)).any():
            raise CaptureError(f"{c} out of range")
        r[c] = values
    if batch.column("socket_cookie").null_count:
        raise CaptureError("no socket_cookie")
    r["socket_cookie"] = batch.column("socket_cookie").cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64)
    for c, names in _CODES.items():
        codes = pc.index_in(batch.column(c).cast(pa.string()), pa.array(names))
        if codes.null_count:
            raise CaptureError(f"unknown {c}")
        r[c] = codes.to_numpy(zero_copy_only=False)
    raw = memoryview(r.view(np.uint8))
    for n, payload in enumerate(batch.column("payload").to_pylist(), 1):
        if payload:
            if len(payload) > schema.MAX_PAYLOAD:
                raise CaptureError("payload too long")
            at = n * STRIDE - schema.MAX_PAYLOAD
            raw[at:at + len(payload)] = payload
    return raw.tobytes()


def capture_bytes(events: list[dict], started: int = 0) -> bytes:
    return HEADER.pack(MAGIC, VERSION, started, len(events)) + b"".join(map(record_bytes, events))


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _opened(file: str):
    return gzip.open(file, "rb") if file.endswith(".gz") else open(file, "rb")


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))
    return [path]


@dataclass
class Part(InputPartition):
    file: str
    first: int
    count: int


class CaptureReader(DataSourceReader):
    def __init__(self, shape: StructType, options: dict):
        self.shape, self.path, self.size = shape, options["path"], int(options.get("recordsPerPartition", 100_000))

    def partitions(self) -> list[Part]:
        out = []
        for file in _files(self.path):
            with _opened(file) as f:
                _, told = read_header(f.read(HEADER.size))
            if file.endswith(".gz"):  # not split: the count is in its header
                out.append(Part(file, 0, told))
                continue
            body = os.path.getsize(file) - HEADER.size
            count = body // STRIDE + (1 if body % STRIDE >= LENGTH.size else 0)
            out += [Part(file, i, min(self.size, count - i)) for i in range(0, count, self.size)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.shape)
        with _opened(partition.file) as f:
            f.seek(HEADER.size + partition.first * STRIDE)
            for at in range(0, partition.count, 512):
                most = min(512, partition.count - at)
                batch = record_batch(f.read(most * STRIDE), partition.first + at, shape)
                if partition.file.endswith(".gz") and batch.num_rows < most:
                    raise CaptureError(f"record {partition.first + at + batch.num_rows}: truncated")
                yield batch


class CaptureStreamReader(DataSourceStreamReader):
    """Follows all files of a folder, new ones and growing ones. The offset is the number of records read of each file; a
    batch takes all that is there, or recordsPerBatch at most, in the order of the files' names, and its parts are read by the
    executors. A bounded run (availableNow) asks a source in Python for one end only, so with a limit it handles one batch.

    Only file sizes, and headers of packed files, are looked at on the driver. A file whose header is not there yet waits for a
    later batch. A packed file doesn't grow; a batch that begins inside one unpacks what lies before. Parts of a batch come in
    no order: sort by timestamp_ns and seq inside a key. seq counts the records of a file.
    """

    def __init__(self, shape: StructType, options: dict):
        self.reader = CaptureReader(shape, options)
        self.path, self.most = options["path"], int(options.get("recordsPerBatch", sys.maxsize))
        self.given: dict[str, int] = {}
        self.told: dict[str, int] = {}

    def _there(self, file: str) -> int:
        """How many whole records a file has."""
        if not file.endswith(".gz"):
            return max(0, os.path.getsize(file) - HEADER.size) // STRIDE
        if file not in self.told:
            with _opened(file) as f:
                try:
                    raw = f.read(HEADER.size)
                except EOFError:
                    raw = b""
            if len(raw) < HEADER.size:
                return 0
            self.told[file] = read_header(raw)[1]
        return self.told[file]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left, out = self.most, dict(self.given)
        for file in _files(self.path):
            name = os.path.basename(file)
            take = min(left, self._there(file) - out.get(name, 0)) if left else 0
            if take > 0:
                out[name] = out.get(name, 0) + take
                left -= take
        self.given = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        folder = _local(self.path)
        where = folder if os.path.isdir(folder) else os.path.dirname(folder)
        out, size = [], self.reader.size
        for name in sorted(end):
            file, first = os.path.join(where, name), start.get(name, 0)
            if end[name] > first:
                with _opened(file) as f:
                    read_header(f.read(HEADER.size))
                step = end[name] - first if file.endswith(".gz") else size
                out += [Part(file, i, min(step, end[name] - i)) for i in range(first, end[name], step)]
        self.given = {name: max(n, self.given.get(name, 0)) for name, n in (self.given | end).items()}
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class CaptureWriter(DataSourceArrowWriter):
    """Files of maxRecordsPerFile records at most for each partition that has rows; they get their final names when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.started = _local(options["path"]), overwrite, int(options.get("started", 0))
        self.most, self.packed = int(options.get("maxRecordsPerFile", 100_000)), options.get("compression", "none") == "gzip"

    def _hidden(self, file: str) -> str:
        return os.path.join(self.path, "." + os.path.basename(file))

    def _header(self, count: int) -> bytes:
        """The header; of a packed file as a member of its own, stored, so that it can be put in its place at last."""
        raw = HEADER.pack(MAGIC, VERSION, self.started, count)
        packer = zlib.compressobj(0, zlib.DEFLATED, _GZIP)
        return packer.compress(raw) + packer.flush() if self.packed else raw

    def _close(self, f, packer, count: int) -> None:
        if packer:
            f.write(packer.flush())
        f.seek(0)
        f.write(self._header(count))
        f.close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        files, f, packer, count = [], None, None, 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                if f is not None and count == self.most:
                    self._close(f, packer, count)
                    f = None
                if f is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(files):05d}.cap" + (".gz" if self.packed else "")
                    files.append(os.path.join(self.path, name))
                    f, packer, count = open(self._hidden(files[-1]), "wb"), zlib.compressobj(1, zlib.DEFLATED, _GZIP) if self.packed else None, 0
                    f.write(self._header(0))
                some = batch.slice(at, min(512, self.most - count))
                f.write(packer.compress(batch_bytes(some)) if packer else batch_bytes(some))
                at, count = at + some.num_rows, count + some.num_rows
        if f is not None:
            self._close(f, packer, count)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for old in _files(self.path):
                os.unlink(old)
        for m in messages:
            for file in m.files if m else []:
                os.replace(self._hidden(file), file)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for file in m.files if m else []:
                os.unlink(self._hidden(file))


class CaptureSource(DataSource):
    """spark.read.format("capture").load(path), readStream and write alike. The path is one that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return schema.DATA_EVENT

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(schema, self.options)

    def streamReader(self, schema: StructType) -> CaptureStreamReader:
        return CaptureStreamReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CaptureSource)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Capture files, packed or not, from any store that Spark reads. A file is one row first, so it should be of bounded size
    (maxRecordsPerFile; 2 GB at most as stored); it is cut into records one after the other, and these are decoded by column
    expressions."""
    ship(spark)
    magic, head, gap, stride = MAGIC, HEADER.size, LENGTH.size, STRIDE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                f = gzip.GzipFile(fileobj=pa.BufferReader(raw)) if raw[:2] == b"\x1f\x8b" else pa.BufferReader(raw)
                if f.read(head)[:len(magic)] != magic:
                    continue
                first = 0
                while len(block := f.read(512 * stride)) >= stride:
                    n = len(block) // stride
                    records = [block[i * stride + gap:(i + 1) * stride] for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.array(records, pa.binary())], ["seq", "record"])
                    first += n

    whole = spark.read.format("binaryFile").load(path).select("content")
    return decoded(whole.mapInArrow(cut, "seq long, record binary")).select(*schema.DATA_EVENT.names)


def events_source(spark: SparkSession, fmt: str, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Events from capture files or from a table format; of a stream whose parts arrive in no order, sort by timestamp_ns and seq inside a key."""
    if fmt == "capture":
        register(spark)
    reader = spark.readStream if stream else spark.read
    if fmt != "capture":
        reader = reader.schema(schema.DATA_EVENT)
    return reader.format(fmt).options(**options).load(path)
