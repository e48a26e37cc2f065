"""Token-ID output: texts as token ids, packed into rows of one length by best-fit-decreasing.

A document longer than a row is split losslessly into full rows and a rest. Inside a window of segments, the longest
comes first, and each goes to the open row with the least capacity that still holds it; a segment tree over the
capacities finds that row in log(length) steps. A window is a bounded run of a partition's segments, so packing needs no
shuffle, and memory does not grow with the input. Matrices are little-endian bytes, of 2 bytes an id where the
vocabulary allows it, else 4.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlens.session import ship

#: Fixed value: how the byte-level BPE vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A session may name another vocabulary file here.
VOCABULARY_SETTING = "spark.flowlens.vocabulary"
ROW = 2048
WINDOW_TOKENS = 4 << 20
_MOST_VOCABULARY_BYTES = 64 << 20

_encodings: dict = {}


def encoding(raw: bytes):
    """The tokenizer of a vocabulary file's bytes, made once in each worker."""
    key = hash(raw)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


class Capacities:
    """A segment tree over capacities 0..size: how many open rows have each, and the least one that is large enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Takes out a row of the least capacity >= need: capacity and row."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a sibling to the right has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of segment numbers; no row's lengths exceed size. Equal lengths keep their order."""
    tree, rows = Capacities(size), []
    for segment in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[segment]
        found = tree.take(need)
        if found is None:
            found = size, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(segment)
        if capacity > need:
            tree.add(capacity - need, row)
    return rows


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, vocabulary: str | None = None, window_tokens: int = WINDOW_TOKENS, pad_id: int | None = None) -> DataFrame:
    """df's texts as packed rows: pack_id, ids (row ids as bytes), id_bytes (2 or 4), n_tokens, cu_seqlens (0 and the end
    of each segment), positions (2 or 4 bytes each as ids; 0 where a segment begins, padding 0), doc_ids and starts (of
    each segment: its document, and where in the document's tokens it begins).

    Joined by document and start, the segments are all tokens of all documents. Null and empty texts have no tokens and no
    segment. Padding is pad_id, else the first id beyond the vocabulary. Repeated rows are each packed. The vocabulary
    file (else the one that the session's VOCABULARY_SETTING names, else VOCABULARY) is read on the driver and broadcast,
    its size being checked. A very long text is encoded whole, 4 bytes a token, and split into full rows. pack_id is unique,
    not gapless; it and the rows depend on how df is partitioned, the segments do not. Equal lengths keep their order.
    """
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary or spark.conf.get(VOCABULARY_SETTING, VOCABULARY), "rb") as file:
        raw = file.read(_MOST_VOCABULARY_BYTES + 1)
    if len(raw) > _MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    pad = encoding(raw).n_vocab if pad_id is None else pad_id
    id_kind = np.dtype("<u2") if max(pad, encoding(raw).n_vocab, row) < 1 << 16 else np.dtype("<u4")
    shipped = spark.sparkContext.broadcast(raw)
    steps = np.arange(row, dtype=id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shipped.value).encode_to_numpy
        task, made = TaskContext.get().partitionId(), 0
        segments: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            bins = best_fit_decreasing([len(s[2]) for s in segments], row)
            out: list[list] = [[] for _ in range(8)]
            for members in bins:
                parts = [segments[i] for i in members]
                ends = np.cumsum([0] + [len(p[2]) for p in parts])
                ids, at = np.full(row, pad, id_kind), np.zeros(row, id_kind)
                for (_, _, tokens), a in zip(parts, ends.tolist(), strict=False):
                    ids[a:a + len(tokens)] = tokens
                    at[a:a + len(tokens)] = steps[:len(tokens)]
                for column, value in zip(out, ((task << 33) + made, ids.tobytes(), id_kind.itemsize, int(ends[-1]), ends.tolist(), at.tobytes(), [p[0] for p in parts], [p[1] for p in parts]), strict=True):
                    column.append(value)
                made += 1
            segments.clear()
            held = 0
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["pack_id", "ids", "id_bytes", "n_tokens", "cu_seqlens", "positions", "doc_ids", "starts"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    tokens = encode(text, disallowed_special=()).astype(id_kind)
                    for start in range(0, len(tokens), row):
                        segments.append((doc, start, tokens[start:start + row]))
                        held += len(segments[-1][2])
                        if held >= window_tokens:
                            yield flush()
        if segments:
            yield flush()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "pack_id long, ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>")
