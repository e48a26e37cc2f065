"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound from the vectors of its
letters, each permuted (rotated) by its place and multiplied together. A text is the bundle (sum) of its n-grams, a
language the bundle of its texts, and a text is compared with each language by cosine. Memory is bounded: n-grams are
bound a few thousand at a time, and a very long text goes through in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from flowlens.llm.textnp import blocks
from flowlens.session import ship

DIM = 1024
ORDER = 3
UNDETERMINED = "und"
_SPAN = 0x40000  # no letters are beyond these planes
_CACHED = 0x3000  # the vectors of letters below this are kept, others made anew for each block
SLICE = 1 << 20
_lower: np.ndarray | None = None
_letters: dict[tuple[int, int], np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point to its lower-cased letter, 0 for what is no letter."""
    global _lower
    if _lower is None:
        _lower = np.zeros(0x110000, np.uint32)
        for i in range(_SPAN):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                _lower[i] = ord(low) if len(low) == 1 and ord(low) < _SPAN else i
    return _lower


def _letter_vector(code: int, dim: int) -> np.ndarray:
    found = _letters.get((code, dim))
    if found is None:
        found = 2 * np.random.Generator(np.random.PCG64([20240611, code])).integers(0, 2, dim, dtype=np.int8) - 1
        if code < _CACHED:
            _letters[code, dim] = found
    return found


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trigrams of a block of texts: number of the row and of the trigram for each, and the trigrams' letters (n, 3).

    A run of what is no letter is one boundary (0); a text begins and ends with one.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    letters = np.insert(_letter_table()[codes], np.minimum(heads[at[:-1]], len(codes)), 0)
    edge = np.zeros(len(letters) + 1, bool)
    edge[heads[at[:-1]] + np.arange(len(at) - 1)] = True
    edge[-1] = True
    letters = np.append(letters, np.uint32(0))
    keep = edge | (letters != 0)
    keep[1:] |= letters[:-1] != 0
    letters, row, edge = letters[keep], (np.cumsum(edge) - 1)[keep], edge[keep]
    if len(letters) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)
    inside = (row[1:-1] == row[:-2]) & ((letters[:-2] != 0) | (letters[1:-1] != 0))
    inside &= (letters[1:-1] != 0) | ~edge[2:]  # a text that ends with a boundary has it once
    column, grams = _numbered(letters, inside)
    return row[:-2][inside], column, grams


def _numbered(letters: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a sequence that begin where `inside` says: the number of each, and the letters of each number."""
    present = np.flatnonzero(np.bincount(letters))
    rank = np.zeros(int(present[-1]) + 1, np.int64)
    rank[present] = np.arange(len(present))
    place, n = rank[letters], len(present)
    key = ((place[:-2] * n + place[1:-1]) * n + place[2:])[inside]
    if n**ORDER <= 1 << 22:
        used = np.flatnonzero(np.bincount(key, minlength=1))
        number = np.zeros(n**ORDER, np.int64)
        number[used] = np.arange(len(used))
        column = number[key]
    else:
        used, column = np.unique(key, return_inverse=True)
    return column, present[np.stack([used // (n * n), used // n % n, used % n], 1)].astype(np.uint32)


def _slices(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trigrams of one long text, as `ngrams` gives them, slice by slice. The last two letters go on into the next."""
    carry = np.zeros(1, np.uint32)
    first = 0
    while first < len(data):
        last = min(first + SLICE, len(data))
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        codes = np.frombuffer(data[first:last].tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([carry, _letter_table()[codes]])
        if last == len(data) and letters[-1]:
            letters = np.append(letters, np.uint32(0))
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0
        keep[:len(carry)] = True
        letters = letters[keep]
        if len(letters) >= ORDER and letters.any():
            column, grams = _numbered(letters, np.ones(len(letters) - 2, bool))
            yield np.zeros(len(column), np.int64), column, grams
        carry, first = letters[-2:], last


def parts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trigrams of a block of texts, in parts of bounded size."""
    if len(at) == 2 and len(data) > SLICE:
        yield from _slices(data)
    else:
        yield ngrams(data, at)


def bind(grams: np.ndarray, dim: int) -> np.ndarray:
    """The vector of each n-gram: its letters' vectors, rotated by their places, multiplied."""
    codes, where = np.unique(grams, return_inverse=True)
    where = where.reshape(grams.shape)
    base = np.stack([_letter_vector(int(c), dim) for c in codes]) if len(codes) else np.zeros((0, dim), np.int8)
    out = np.ones((len(grams), dim), np.int8)
    for place in range(ORDER):
        out *= np.roll(base, ORDER - 1 - place, axis=1)[where[:, place]]
    return out.astype(np.float32)


def bundle(out: np.ndarray, row: np.ndarray, column: np.ndarray, grams: np.ndarray, most_grams: int = 2048, most_rows: int = 256) -> None:
    """Adds to each row of out the vectors of its trigrams."""
    rows, dim = out.shape
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, len(grams), most_grams):
        high = min(low + most_grams, len(grams))
        a, b = np.searchsorted(column, [low, high])
        vectors, width = bind(grams[low:high], dim).astype(out.dtype), high - low
        for top in range(0, rows, most_rows):
            n = min(most_rows, rows - top)
            mine = (row[a:b] >= top) & (row[a:b] < top + n) if rows > most_rows else slice(None)
            counts = np.bincount((row[a:b][mine] - top) * width + column[a:b][mine] - low, minlength=n * width).reshape(n, width)
            out[top:top + n] += counts.astype(out.dtype) @ vectors


def text_vectors(data: np.ndarray, at: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bundle of each text of a block; zero for a text without letters."""
    out = np.zeros((len(at) - 1, dim), np.float32)
    for row, column, grams in parts(data, at):
        bundle(out, row, column, grams)
    return out


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, most_languages: int = 1000) -> dict[str, np.ndarray]:
    """A prototype of each language from every row of df with a text and a language.

    Each task bundles what it reads to one vector a language; only sums, most_languages * dim numbers at most, reach the
    driver. More languages than that are refused. Rows with null text or language teach nothing, nor do texts without letters.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                langs, number = np.unique(np.array(rows.column(1).to_pylist(), object).astype(str), return_inverse=True)
                here = np.zeros((len(langs), dim))
                for row, column, grams in parts(data, at):
                    bundle(here, number[row], column, grams)
                for lang, v in zip(langs.tolist(), here, strict=True):
                    if v.any():
                        sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    found = rows.mapInArrow(run, "lang string, vector array<double>")
    sums = found.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sorted(found, key=lambda r: r["lang"])}


def _predicted(df: DataFrame, prototypes: dict[str, np.ndarray], keep: list[Column], text_col: str) -> DataFrame:
    """kept (a struct of the columns of `keep`), lang_pred and score of every row."""
    ship(df.sparkSession)
    names = sorted(prototypes)
    dim = len(prototypes[names[0]]) if names else DIM
    matrix = np.stack([prototypes[k] / max(1e-9, np.linalg.norm(prototypes[k])) for k in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array([*names, UNDETERMINED])
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                vectors = text_vectors(data, at, dim)
                norm = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ matrix.T / np.maximum(norm, 1e-9)[:, None]
                known = (norm > 0) & bool(names)
                best = cosine.argmax(1) if names else np.zeros(len(norm), int)
                score = np.where(known, np.clip(cosine[np.arange(len(norm)), best] if names else 0.0, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), labels.take(pa.array(np.where(known, best, len(names)))), pa.array(score.astype(np.float64))], ["kept", "lang_pred", "score"])

    base = df.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    kept = base.schema["kept"].dataType
    return base.mapInArrow(run, StructType().add("kept", kept).add("lang_pred", "string").add("score", "double"))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns of `keep`, lang_pred and score (the cosine, 0 to 1) of every row of df.

    A null text and one without letters get `und` and 0, as does every row where nothing was learned. Ties go to the
    language that sorts first. A very long text is bundled slice by slice, whole.
    """
    return _predicted(df, prototypes, keep, text_col).select("kept.*", "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """The documents that nothing may be learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out. A null doc_id counts as not held out."""
    out = F.coalesce(held_out(), F.lit(False))
    prototypes = learn(docs.filter(~out))
    return predict(docs, prototypes, [F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out")])


def _length_class(text: str) -> Column:
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def score_floors(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang", share: float = 0.5) -> dict[int, float]:
    """For each class of text length (a power of two): `share` of the least score that a rightly predicted text of that class
    has. Taken from every row that has a language. A class without any takes the floor of the next shorter one, else 0."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    found = _predicted(rows, prototypes, [F.col(lang_col).cast("string").alias("lang"), _length_class(text_col).alias("length")], text_col).filter("lang_pred = kept.lang")
    least = {r["length"]: r["least"] for r in found.groupBy("kept.length").agg(F.min("score").alias("least")).collect()}  # at most a row for each power of two
    floors, last = {}, 0.0
    for n in range(32):
        last = share * least[n] if n in least else last
        floors[n] = last
    return floors


def identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language can't be told, with all columns; a null language is filled with the predicted
    one. Rejected are a null text, one without letters, and one that is far from every language: its score is below half of
    what any rightly predicted text of like length has (see score_floors). Learned from the rows of docs that have a
    language; where there are none, every row is rejected."""
    prototypes = learn(docs, text_col, lang_col)
    floors = score_floors(docs, prototypes, text_col, lang_col)
    floor = F.element_at(F.array(*[F.lit(floors[n]) for n in range(32)]), F.least(F.col("kept.length"), F.lit(31)) + 1)
    keep = [F.struct(*docs.columns).alias("row"), _length_class(text_col).alias("length")]
    known = _predicted(docs, prototypes, keep, text_col).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= floor))
    row = F.col("kept.row")
    return known.select(*[F.coalesce(row[c], F.col("lang_pred")).alias(c) if c == lang_col else row[c].alias(c) for c in docs.columns])
