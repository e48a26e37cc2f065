"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks; a chunk's hash is its bytes read as digits in two bases modulo 2**31 - 1. Two neighbouring
hashes combine as hash(xy) = hash(x) * base**len(y) + hash(y), so a huge document needs no sequential pass: chunk hashes
are computed side by side and folded as a tree. Rows with equal fingerprint and length are then compared chunk by chunk:
in a folding aggregate, min and max of each chunk over the group must be the same bytes. No group is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.textnp import ASCII_LOWER, blocks
from flowlens.session import files_for, materialize, ship

_P = np.uint64((1 << 31) - 1)
#: The two bases of the fingerprint.
_BASES = (1_103_515_245, 1_664_525_013)


def _chunk_powers(chunk: int) -> np.ndarray:
    """base ** (chunk - 1) .. base ** 0 for both bases, as floats: each is below 2**31."""
    out = np.empty((chunk, 2))
    for j, base in enumerate(_BASES):
        x = 1
        for i in range(chunk - 1, -1, -1):
            out[i, j] = x
            x = x * base % int(_P)
    return out


def fold(hashes: np.ndarray, shifts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Combines each row's chunk hashes, as a tree. hashes, shifts: (chunks, 2), rows one after the other; counts: chunks of each row, at least 1."""
    while len(hashes) > len(counts):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = np.arange(len(hashes)) - np.repeat(first, counts)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(counts, counts)))
        hashes[left] = (hashes[left] * shifts[left + 1] + hashes[left + 1]) % _P
        shifts[left] = shifts[left] * shifts[left + 1] % _P
        keep = place % 2 == 0
        hashes, shifts, counts = hashes[keep], shifts[keep], (counts + 1) // 2
    return hashes


def _chunk_hashes(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash and the size of each chunk of a block's rows, one row after the other, and the chunks of each row."""
    chunk = len(table)
    length = np.diff(at)
    counts = np.maximum(1, -(-length // chunk))
    first = np.concatenate([[0], np.cumsum(counts)])
    size = np.full(first[-1], chunk)
    size[first[1:] - 1] = length - (counts - 1) * chunk
    grid = np.zeros((len(size), chunk), np.uint8)  # a short chunk stands at the right: leading zeros add nothing
    inside = np.arange(len(data)) - np.repeat(at[:-1], length)
    row = np.repeat(first[:-1], length) + inside // chunk
    grid[row, chunk - size[row] + inside % chunk] = data
    hashes = np.empty((len(size), 2), np.uint64)
    for i in range(0, len(size), 2048):  # sums stay below 2**53, where floats are exact
        hashes[i:i + 2048] = (grid[i:i + 2048].astype(np.float64) @ table).astype(np.uint64) % _P
    return hashes, size, counts


def fingerprint_block(data: np.ndarray, at: np.ndarray, table: np.ndarray, most: int = 4 << 20) -> np.ndarray:
    """The 62-bit fingerprint of each row of a block of bytes; table: _chunk_powers(chunk). A row of more than `most` bytes
    is to be a block of its own; its chunks are hashed slice by slice."""
    chunk = len(table)
    step = max(1, most // chunk) * chunk
    if len(at) == 2 and len(data) > step:
        parts = [_chunk_hashes(x, np.array([0, len(x)]), table) for x in (data[i:i + step] for i in range(0, len(data), step))]
        hashes, size, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = counts.sum(keepdims=True)
    else:
        hashes, size, counts = _chunk_hashes(data, at, table)
    shift_of = np.vstack([table[::-1], [[pow(b, chunk, int(_P)) for b in _BASES]]]).astype(np.uint64)
    hashes = fold(hashes, shift_of[size], counts)
    return ((hashes[:, 0] << np.uint64(31)) | hashes[:, 1]).astype(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1024) -> DataFrame:
    """One row for each row of df: id, fp (62 bits), n_bytes, text_sha256, all of the text with A-Z lower-cased.

    A null text counts as empty (fingerprint 0, length 0). Only the two named columns are read; others may have any name.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _chunk_powers(chunk)
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                data = ASCII_LOWER[data]
                raw = memoryview(data)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(fingerprint_block(data, at, table)), pa.array(np.diff(at)), pa.array(sha, pa.string())],
                    ["id", "fp", "n_bytes", "text_sha256"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long, n_bytes long, text_sha256 string")


def _chunks(df: DataFrame, size: int, most: int = 4 << 20) -> DataFrame:
    """(id, fp, n_bytes, text) to a row for each chunk of the normalised text, about `most` bytes at a time."""
    names = ["fp", "n_bytes", "chunk_no", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                cuts = [(i, n, a + n * size, min(b, a + n * size + size)) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) for n in range(max(1, -(-(b - a) // size)))]
                each = max(1, most // size)
                if len(data) <= most:
                    each = len(cuts)
                for k in range(0, len(cuts), each):
                    part = cuts[k:k + each]
                    source = pa.array([c[0] for c in part], pa.int64())
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(source), rows.column(1).take(source), pa.array([c[1] for c in part], pa.int64()), pa.array([ASCII_LOWER[data[c[2]:c[3]]].tobytes() for c in part], pa.binary())], names)

    return df.select("fp", "n_bytes", "text").mapInArrow(run, "fp long, n_bytes long, chunk_no long, chunk binary")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1024, compare_chunk: int = 65536, fingerprint=fingerprints) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z.

    Returns a row for each row of df, dropped ones too: id, keep_id (largest id of the group), group_size, kept,
    text_sha256. Null and empty texts are one group. Rows repeated with one id each count in group_size, and all rows
    of the largest id are kept. A very long text is hashed slice by slice. An empty table gives an empty result. Groups that share a fingerprint but differ in
    some chunk (a collision) are told apart by the digest of the whole text. fingerprint: replaceable, for tests.
    """
    prints = materialize(fingerprint(df, id_col, text_col, chunk))
    files = files_for(prints.count())
    # both sides of a join on a fingerprint are tables, so that a hot one can be split
    groups = materialize(prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("size")).filter("size > 1").drop("size"), files, gather=True)
    members = prints.join(groups, ["fp", "n_bytes"]).select("id", "fp", "n_bytes")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the ids are the small side: hashed, so that the texts stream by and are never sorted
    suspects = texts.join(members.dropDuplicates(["id"]).hint("shuffle_hash"), "id")
    unequal = materialize(
        _chunks(suspects, compare_chunk).groupBy("fp", "n_bytes", "chunk_no")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .filter("least != most").select("fp", "n_bytes").distinct(),
        files, gather=True)
    split = prints.withColumn("part", F.lit(""))
    if not unequal.isEmpty():
        split = prints.join(unequal.withColumn("collides", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("part", F.when(F.col("collides"), F.col("text_sha256")).otherwise(F.lit("")))
        split = materialize(split.drop("collides"))
    keep = split.groupBy("fp", "n_bytes", "part").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    shared = materialize(keep.filter("group_size > 1"), files, gather=True)
    return split.join(shared, ["fp", "n_bytes", "part"], "left").select(
        "id",
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_id", "id") == F.col("id")).alias("kept"),
        "text_sha256",
    )
