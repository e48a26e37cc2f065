"""Word pieces with their places: what a token model reads, from a vocabulary that is given."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.session import ship

#: The sign of a piece inside a word, the names of special tokens, and limits of the model.
INSIDE, UNKNOWN, FIRST, LAST = "##", "[UNK]", "[CLS]", "[SEP]"
MAX_TOKENS, MAX_WORD = 512, 100
#: Bytes that a vocabulary may have to be sent to every task.
MOST_BYTES = 64 << 20

_WORD = re.compile(r"\w+|[^\w\s]")
_END = ""


class Pieces:
    """A vocabulary as two tries, of pieces that begin a word and of those inside one; a word becomes the longest pieces from its
    start on, or [UNK] as a whole where some place has none."""

    def __init__(self, vocabulary: dict[str, int], lower: bool):
        self.ids, self.lower = vocabulary, lower
        self.tries: tuple[dict, dict] = ({}, {})
        for piece, number in vocabulary.items():
            inside = piece.startswith(INSIDE)
            at = self.tries[inside]
            for c in piece[len(INSIDE) if inside else 0:]:
                at = at.setdefault(c, {})
            at[_END] = number
        self.word = functools.lru_cache(1 << 16)(self._word)

    def _word(self, word: str) -> tuple[tuple[int, int, int], ...]:
        """The pieces of a word: id, start and end in it."""
        shown, places = word, list(range(len(word) + 1))
        if self.lower:  # lower case, without accents; each character knows where it came from
            chars = [(c, i) for i, x in enumerate(word) for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn"]
            shown, places = "".join(c for c, _ in chars), [i for _, i in chars] + [len(word)]
        unknown = ((self.ids[UNKNOWN], 0, len(word)),)
        if not shown or len(shown) > MAX_WORD:
            return unknown
        out, start = [], 0
        while start < len(shown):
            at, best, end = self.tries[start > 0], None, start
            for i in range(start, len(shown)):
                at = at.get(shown[i])
                if at is None:
                    break
                if _END in at:
                    best, end = at[_END], i + 1
            if best is None:
                return unknown
            out.append((best, places[start], places[end] if end == len(shown) else max(places[end], places[end - 1] + 1)))
            start = end
        return tuple(out)

    def of(self, text: str) -> list[tuple[int, int, int]]:
        """The pieces of a text: id, start and end in code points. Words are runs of letters and digits; a mark is a word."""
        return [(number, m.start() + a, m.start() + b) for m in _WORD.finditer(text) for number, a, b in self.word(m[0])]


def vocabulary_of(table: DataFrame) -> dict[str, int]:
    """A vocabulary from a table of (piece, id), counted before it is fetched."""
    size = table.agg(F.sum(F.octet_length("piece") + 8)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the vocabulary has {size} bytes, over {MOST_BYTES}")
    return {r["piece"]: r["id"] for r in table.select("piece", "id").collect()}


def with_tokens(rows: DataFrame, text: str, vocabulary: dict[str, int], keep: list[str], max_tokens: int = MAX_TOKENS, overlap: int = 64, lower: bool = True) -> DataFrame:
    """A row for each window of each text: the columns of keep, window (from 0), ids and offsets (array of (start, end)).

    A window begins with [CLS], ends with [SEP] (both with the offsets 0, 0) and has max_tokens at most; a longer text goes on in
    the next window, which repeats the last `overlap` pieces, so no text is cut off and a name on a border is whole in one of
    them. A null or empty text has one window without pieces. The vocabulary must have [UNK], [CLS] and [SEP].
    """
    if missing := {UNKNOWN, FIRST, LAST} - vocabulary.keys():
        raise ValueError(f"the vocabulary lacks {sorted(missing)}")
    room = max_tokens - 2
    if not 0 <= overlap < room:
        raise ValueError("overlap must be less than the pieces of a window")
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    base = rows.select(*keep, F.col(text).alias("__text"))
    kinds = dict(base.dtypes)
    offset = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value, lower)
        first, last = shared.value[FIRST], shared.value[LAST]
        for batch in batches:
            where, windows, ids, offsets = [], [], [], []
            for row, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found, at, window = pieces.of(value or ""), 0, 0
                while True:
                    part = found[at:at + room]
                    where.append(row)
                    windows.append(window)
                    ids.append([first, *(p[0] for p in part), last])
                    offsets.append([{"start": 0, "end": 0}, *({"start": p[1], "end": p[2]} for p in part), {"start": 0, "end": 0}])
                    if at + room >= len(found):
                        break
                    at, window = at + room - overlap, window + 1
            kept = batch.select(keep).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(windows, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, offset)], [*keep, "window", "ids", "offsets"])

    return base.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", window int, ids array<int>, offsets array<struct<start: int, end: int>>")
