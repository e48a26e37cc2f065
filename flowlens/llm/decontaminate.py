"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most e edits has, of any e + 1 pieces it is cut into, at least one that occurs
unchanged. So the pieces of all items are found at once by an automaton, and around each hit the item is verified by
Myers' bit-parallel edit distance, with the ends of the text free.

The benchmark is cut into blocks of bounded size, and each is broadcast on its own. With several, each block is a scan of its
own over the texts, one after the other: a worker builds a block's automaton once for all the tasks that it runs of it, and
has one at a time. What several scans read again is little beside what searching costs. Verifying costs a step for each
character around a hit, of integers as long as the item.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import materialize, ship

#: Edits allowed: this share of an item's characters; pieces are then about 15 characters long.
ERROR_RATE = 0.06


def normalise(text: str) -> str:
    """Lower case, white space as one space."""
    return " ".join(text.lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that make up the item, of nearly equal length: offset and text."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(cuts[i], item[cuts[i]:cuts[i + 1]]) for i in range(n) if cuts[i + 1] > cuts[i]]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The least edit distance of the item to any stretch of text, and the end of the first such stretch. Bit i of the
    vectors holds the difference of rows i and i + 1 of the matrix; the integers are as long as the item."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for j, c in enumerate(text):
        match = eq.get(c, 0)
        carry = (((match & plus) + plus) ^ plus) | match
        up = minus | (full & ~(carry | plus))
        down = plus & carry
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        match |= minus
        plus = down | (full & ~(match | up))
        minus = up & match
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Items as an automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text or "")
            if not text:
                continue
            errors = budget(len(text), rate)
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, errors, masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, end, budget) for each item in the text; the nearest occurrence, the first of equals."""
        text = normalise(text)
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, at) in self.automaton.iter(text):
            for number, offset in at:
                starts.setdefault(number, set()).add(last + 1 - size - offset)
        out = []
        for number, found in starts.items():
            item_id, item, errors, eq = self.items[number]
            best, end, low, high = errors + 1, 0, None, None
            for start in [*sorted(found), None]:  # windows that overlap are verified as one
                if low is not None and (start is None or start - errors > high):
                    distance, stop = myers(eq, len(item), text[low:high])
                    if distance < best:
                        best, end = distance, low + stop
                    low = None
                if start is not None:
                    a, b = max(0, start - errors), min(len(text), start + len(item) + errors)
                    low, high = (a, b) if low is None else (low, max(high, b))
                if best == 0:
                    break
            if best <= errors:
                out.append((item_id, best, end, errors))
        return sorted(out)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = 8_000_000) -> Iterator[list[tuple[int, str]]]:
    """The benchmark as blocks of at most block_chars characters (an item may be longer, alone), one held at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null").orderBy("i").toLocalIterator():
        if block and held + len(row["t"]) > block_chars:
            yield block
            block, held = [], 0
        block.append((row["i"], row["t"]))
        held += len(row["t"])
    if block:
        yield block


def ship_items(spark: SparkSession, blocks: Iterable[list[tuple[int, str]]]) -> list[Broadcast]:
    """The blocks as broadcasts; the driver keeps each as a file, and one in memory."""
    return [spark.sparkContext.broadcast(block) for block in blocks]


_latest: list = [None, None, None]


def _matcher(block: Broadcast, rate: float) -> Matcher:
    """The automaton of a block; a worker keeps the one it used last."""
    if _latest[0] is not block or _latest[2] != rate:
        _latest[:] = block, Matcher(block.value, rate), rate
    return _latest[1]


def find_items(df: DataFrame, items: list[Broadcast], id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """A row for each row of df and item that occurs in it: id, item_id, distance, end_pos (in the normalised text), budget.
    Of several occurrences the nearest counts, of equally near ones the first. Null and empty texts, and empty items, match
    nothing; a very long text is searched whole. A repeated row is reported each time."""
    ship(df.sparkSession)
    kinds, shape = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], "id long, item_id long, distance int, end_pos int, budget int"

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def scan(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, rate)
            for batch in batches:
                found = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for hit in matcher.find(text)]
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "item_id", "distance", "end_pos", "budget"])

        return texts.mapInArrow(run, shape)

    if not items:
        return df.sparkSession.createDataFrame([], shape)
    return functools.reduce(DataFrame.unionByName, [scan(block) for block in items])


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = 8_000_000) -> DataFrame:
    """All rows of df against all benchmark items, in one pass over df (see find_items)."""
    return find_items(df, ship_items(df.sparkSession, item_blocks(benchmark, block_chars=block_chars)), id_col, text_col, rate)


def without_items(df: DataFrame, items: list[Broadcast], text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of df whose text has none of the items, with all columns. One block is a filter in passing. With several, the digests
    of the texts that any of them hits are gathered in a table, and rows of such a text go."""
    ship(df.sparkSession)
    place = df.columns.index(text_col)

    def clean(block: Broadcast, wanted: bool, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, rate)
            for batch in batches:
                yield batch.filter(pa.array([bool(text and matcher.find(text)) != wanted for text in batch.column(at).to_pylist()], pa.bool_()))

        return run

    if not items:
        return df
    if len(items) == 1:
        return df.mapInArrow(clean(items[0], True, place), df.schema)
    texts = df.select(F.col(text_col).alias("text"))
    hit = functools.reduce(DataFrame.unionByName, [texts.mapInArrow(clean(block, False, 0), texts.schema).select(F.sha2("text", 256).alias("__hit")) for block in items])
    hits = materialize(hit.distinct())
    return df.join(hits, F.sha2(df[text_col], 256) == hits["__hit"], "left_anti")


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, block_chars: int = 8_000_000) -> DataFrame:
    """df without the rows that have a benchmark item in their text; a row is judged by its own text, so there is no join.
    Rows with null or empty texts stay, as does everything where the benchmark is empty."""
    return without_items(df, ship_items(df.sparkSession, item_blocks(benchmark, block_chars=block_chars)), text_col, rate)
