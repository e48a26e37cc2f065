"""Substring dedup by seed and extend.

Seeds: every run of `length` words has one anchor, the least hash of its k-grams (winnowing). So two documents that
share a run share its anchor, and documents are joined on anchors. Extend: an anchor's neighbourhood is the anchor extended
to both sides as far as the runs reach that it stands for. Occurrences with one neighbourhood extend fully to both sides;
they are a class, and only the least document of a class is compared further. Where an anchor has several classes, their
extents differ somewhere, and the runs of each class's least document are matched one by one. What is left are the maximal
repeats over the threshold; every word of one, but in the first document that has it, is removed.

Classes and runs are matched by 128 bits of hash, not word by word, in aggregates that fold before they shuffle: copies in
any number cost a row for each task. Joins leave hot anchors where they are. Only documents that share an anchor have
their text moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.textnp import blocks, mix, sliding, word_hashes, word_spans
from flowlens.session import files_for, materialize, ship

LENGTH, GRAM = 50, 16
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            _tables[i] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, base, np.uint64)]))
    return _tables[0][:n], _tables[1][:n]


class Stretches:
    """Hashes of any stretch of a block's words, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: np.ndarray):
        forward, self.back = _powers(len(words) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * forward[:-1], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + mix((end - start).astype(np.uint64)))


def anchors(words: np.ndarray, first: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each anchor of a block: its row, its hash, its neighbourhood's hash, first and last run it stands for (word numbers in the row)."""
    span = length - gram + 1
    none = np.zeros(0, np.int64)
    counts = np.diff(first)
    if len(words) < length or counts.max(initial=0) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = sliding(words, gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the first
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:width - span], least[span - width:])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - length + 1, 0))
    offset = np.concatenate([[0], np.cumsum(np.maximum(counts - length + 1, 0))])
    run = np.arange(len(row)) - offset[row] + first[row]
    at = anchor[run]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    low, high, row, at = run[new], run[np.append(new[1:], len(run)) - 1], row[new], at[new]
    around = mix(Stretches(words).hash(low, high + length) + mix((at - low).astype(np.uint64)))
    return row, grams[at], around, low - first[row], high - first[row]


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _seeds(df: DataFrame, length: int, gram: int) -> DataFrame:
    """For each row (id, text): n_words, the digest of all its words, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                starts, ends, first = word_spans(data, at)
                row, h, around, low, high = anchors(word_hashes(data, starts, ends), first, length, gram)
                raw = data.tobytes()
                sha = [_digest(b" ".join(raw[a:b].split())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                inner = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array((low << 6) | (high - low))], ["h", "n", "pos"])
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(sha), found], ["id", "n_words", "sha", "anchors"])

    return df.mapInArrow(run, "id long, n_words long, sha string, anchors array<struct<h: long, n: long, pos: long>>")


def _runs(touched: DataFrame, length: int) -> DataFrame:
    """Every run that the probes of (id, text, probes) stand for: h, w (together the run's identity), id, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                starts, ends, first = word_spans(data, at)
                stretches = Stretches(word_hashes(data, starts, ends))
                lists = rows.column(rows.schema.get_field_index("probes"))
                counts = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                h, pos = flat.field("h").to_numpy(), flat.field("pos").to_numpy()
                row = np.repeat(np.arange(rows.num_rows), counts)
                low, extra = pos >> 6, (pos & 63) + 1
                start = np.repeat(low, extra) + np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra)
                where = start + np.repeat(first[row], extra)
                w = stretches.hash(where, where + length)
                ids = rows.column(0).to_numpy(zero_copy_only=False)[np.repeat(row, extra)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, extra)), pa.array(w.view(np.int64)), pa.array(ids), pa.array(start)], ["h", "w", "id", "start"])

    return touched.select("id", "text", "probes").filter("size(probes) > 0").mapInArrow(run, "h long, w long, id long, start long")


def _removed(touched: DataFrame, length: int) -> DataFrame:
    """(id, text, full, single) without the words of its repeats: id, n_removed, spans (first and end word of each), kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                out: list[list] = [[], [], [], []]
                for doc, text, full, single in zip(*(rows.column(c).to_pylist() for c in range(4)), strict=True):
                    words = (text or "").encode().split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    full, single = np.array(full or [], np.int64), np.array(single or [], np.int64)
                    np.add.at(edge, full >> 6, 1)
                    np.add.at(edge, (full >> 6) + (full & 63) + length, -1)
                    np.add.at(edge, single, 1)
                    np.add.at(edge, single + length, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    for column, value in zip(out, (doc, int(gone.sum()), turn.reshape(-1, 2).tolist(), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int64()))), pa.array(out[3], pa.string())], ["id", "n_removed", "spans", "kept_text"])

    return touched.select("id", "text", "full", "single").mapInArrow(run, "id long, n_removed long, spans array<array<long>>, kept_text string")


def joined(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """left with the columns of right, a table with one row for each key: `seen` is how many of left's rows have it.

    A key of more than a 2,000th of left's rows would be one task's: there are fewer than 2,000 of those, so they are
    broadcast, and left's rows stay where they are. The others meet by a shuffle.
    """
    most = max(1000, rows // 2000)
    hot, cold = right.filter(F.col("seen") > most).drop("seen"), right.filter(F.col("seen") <= most).drop("seen")
    far = left.join(F.broadcast(hot), keys)
    near = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return far.unionByName(near)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The maximal repeats of at least `length` words that also start in a document with a smaller id.

    Returns the documents that have some: id, n_removed, spans (first and end word), kept_text (the other words, joined
    by one space); and all rows: id, n_words, sha (digest of all words joined by one space). Null and empty texts have
    no words. Ids are to be unique; identical rows repeated are one document, an id with different texts is not provided
    for, and a null id takes no part. A very long text is one row of a task. Columns of df other than the two named are
    not read. An empty table gives empty results.
    """
    if not gram < length <= gram + 63:
        raise ValueError("length must be over gram, by 63 at most")
    ship(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seeds = materialize(_seeds(base, length, gram))
    total = seeds.agg(F.count("*").alias("rows"), F.sum(F.size("anchors")).alias("anchors")).first()
    rows, files = total["anchors"] or 0, files_for(8 * total["rows"])  # a document has some tens of anchors, of which a part is shared
    seed = seeds.filter("id is not null").select("id", F.inline("anchors"))
    found = seed.groupBy("h").agg(F.count("*").alias("seen"), F.min("id").alias("lo"), F.max("id").alias("hi"), (F.min("n") != F.max("n")).alias("several"))
    shared = materialize(found.filter("lo < hi").select("h", "seen", "several"), files, gather=True)
    seed = materialize(joined(seed, shared, ["h"], rows), files, gather=True)
    classes = materialize(seed.groupBy("h", "n").agg(F.count("*").alias("seen"), F.min("id").alias("least")), files, gather=True)
    found = joined(seed, classes, ["h", "n"], rows).filter("id > least or several")
    full = F.when(F.col("id") > F.col("least"), F.col("pos"))
    probe = F.when(F.col("id") == F.col("least"), F.struct("h", "pos"))
    by_doc = found.groupBy("id").agg(F.collect_set(full).alias("full"), F.collect_set(probe).alias("probes"))
    touched = materialize(base.join(by_doc, "id"))
    runs = materialize(_runs(touched, length))
    first = runs.groupBy("h", "w").agg(F.count("*").alias("seen"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h", "w", "seen", "lo")
    single = joined(runs, materialize(first), ["h", "w"], runs.count()).filter("id > lo").groupBy("id").agg(F.collect_set("start").alias("single"))
    texts = touched.join(single, "id", "left").filter("size(full) > 0 or single is not null")
    return _removed(texts, length).dropDuplicates(["id"]), seeds.select("id", "n_words", "sha")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each row of df: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    cut, every = repeats(df, id_col, text_col, length, gram)
    cut = cut.select("id", "n_removed", F.sha2("kept_text", 256).alias("kept"))
    return every.join(cut, "id", "left").select("id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
