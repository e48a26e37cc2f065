"""Regions of an LSH forest whose depth adapts to how crowded they are.

A tree is an order of signature values; a region is what shares a prefix of it. A region of at most `most` documents is a
leaf, and all its pairs are compared; a more crowded one is split by further values, down to the deepest prefix, where
what is still crowded is compared block by block. Only documents of different components are compared, by sketches.

A pair of similarity s is in one region of depth d with probability s ** d. So a tree covers a document by
-log(1 - s ** d), d being the depth of its leaf; further trees, of fresh permutations, are grown for the documents whose
cover is still short. Thus deep regions cost trees, not links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.textnp import blocks, fixed_width, mix, shingle_sets
from flowlens.session import materialize, ship

TREES = 32
DEPTHS = (4, 5, 6, 8, 10, 12)
#: A leaf has at most so many documents; its pairs are compared by their sketches, in memory.
MOST = 1024
#: Bits of a sketch: HASHES orders of a set, of each the least value in every one of BINS bins.
HASHES, BINS = 48, 128
BITS = HASHES * BINS
#: The sketches' estimate may be this much off the threshold: over 5 standard deviations at a similarity of 0.75.
MARGIN = 0.045
#: A document is covered when a pair at the threshold is missed with probability exp(-COVER) = 6e-6.
COVER = 12.0


#: No leaf's number.
NOWHERE = np.int64(-(1 << 63))


def permutations(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n permutations of 32-bit numbers: x to x * factor + term."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factor, term = (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    return factor | np.uint32(1), term


def least_values(shingles: np.ndarray, factor: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The least value of a set under each permutation of 32-bit numbers."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        least = np.minimum(least, (low[i:i + 1024, None] * factor + term).min(0))
    return least


_SKETCH_FACTOR, _ = permutations(20240701, HASHES)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of the least value of each bin, then for each bin whether it has any: 2 * BITS bits as bytes."""
    low = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    bits, used = np.zeros(BITS, bool), np.zeros(BITS, bool)
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1 << 16):
        for k, values in enumerate(np.sort(low[i:i + (1 << 16)] * _SKETCH_FACTOR[:, None], axis=1)):
            bins = values >> np.uint32(25)
            first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
            at = k * BINS + bins[first].astype(np.int64)
            least[at] = np.minimum(least[at], values[first])
            used[at] = True
    bits[used] = (mix(least[used].astype(np.uint64)) & np.uint64(1)).astype(bool)
    return np.packbits(np.concatenate([bits, used]))


def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimated similarity of rows of sketches, as words of 64 bits."""
    half = BITS // 64
    both = x[:, half:] & y[:, half:]
    agree = np.bitwise_count(~(x[:, :half] ^ y[:, :half]) & both).sum(1, dtype=np.int64)
    either = np.bitwise_count(x[:, half:] | y[:, half:]).sum(1, dtype=np.int64)
    return (2 * agree - np.bitwise_count(both).sum(1, dtype=np.int64)) / np.maximum(either, 1)


def sketched(texts: DataFrame) -> DataFrame:
    """id, n (size of the shingle set), sketch and set (sorted 64-bit hashes) of each of texts (id, text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                sets = shingle_sets(data, at)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(map(len, sets), pa.int64()), fixed_width(np.stack([sketch(s) for s in sets])), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "sketch", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, sketch binary, set binary")


def resembling(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches are nearly similar enough, with `agree`, the estimate in thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                likeness = similar(x, y)
                good = pa.array(likeness >= num / den - MARGIN)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array((likeness * 1000).astype(np.int32)).filter(good)], ["a", "b", "agree"])

    left = sets.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, agree int")


def tree_rows(texts: DataFrame, number: int) -> DataFrame:
    """Each of texts (id, text) in each tree of the forest of that number: id, and the hash of its prefix of each depth."""
    ship(texts.sparkSession)
    names = [f"h{d}" for d in DEPTHS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, term = permutations(20240702 + number, TREES * DEPTHS[-1])
        seed = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(TREES * number + 1))
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                least = np.stack([least_values(s, factor, term) for s in shingle_sets(data, at)]).reshape(rows.num_rows, TREES, -1).astype(np.uint64)
                key, found = np.broadcast_to(seed, least.shape[:2]), []
                for d in range(DEPTHS[-1]):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, :, d])
                    if d + 1 in DEPTHS:
                        found.append(pa.array(key.reshape(-1).view(np.int64)))
                ids = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *found], ["id", *names])

    return texts.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def regions(rows: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The leaves of rows (id, c, h of each depth): id, c, leaf, role; and a row (id, depth) for each tree and depth at which
    a document's region was still crowded and was split.

    A region with one component has nothing to compare, at whatever depth. role: 0 is compared with all of its leaf, 1
    with 2 only. In the deepest regions that are still crowded, the most frequent component (2) is compared with the
    others (1), and these with one another, block by block.
    """
    leaves, opened, left = [], [], rows
    for depth in DEPTHS:
        key = f"h{depth}"
        mixed = materialize(left.groupBy(key).agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("mixed").drop("mixed"))
        placed = materialize(left.join(mixed, key))
        crowded = F.col("n") > most
        leaves.append(placed.filter(~crowded).select("id", "c", F.col(key).alias("leaf"), F.lit(0).alias("role")))
        left = materialize(placed.filter(crowded).drop("n"))
        if left.isEmpty():
            break
        if depth != DEPTHS[-1]:
            opened.append(left.select("id", F.lit(depth).alias("depth")))
    else:
        leaves += _block_pairs(left.select("id", "c", F.col(key).alias("h")), most // 2)
    return _union(leaves), _union(opened or [left.select("id", F.lit(0).alias("depth"))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block_pairs(rows: DataFrame, size: int) -> list[DataFrame]:
    """rows (id, c, h) of crowded regions h, dealt to leaves of about 2 * size: a block of what is not of the most frequent
    component, and a block of all."""
    by_part = rows.groupBy("h", "c").agg(F.count("*").alias("k"))
    stats = by_part.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.sum("k").alias("n"), F.max("k").alias("most"))
    stats = materialize(stats.select("h", "major", F.ceil((F.col("n") - F.col("most")) / size).alias("few_blocks"), F.ceil(F.col("n") / size).alias("all_blocks")))
    rows = rows.join(stats, "h")

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    few = rows.filter("c != major").select("id", "c", "h", block("few_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(1).alias("role"))
    many = rows.select("id", "c", "h", every("few_blocks").alias("i"), block("all_blocks").alias("j"), F.lit(2).alias("role"))
    return [x.select("id", "c", F.xxhash64("h", "i", "j").alias("leaf"), "role") for x in (few, many)]


def spanning(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges x, y between nodes 0..n-1 those of a forest of greatest weight, as their numbers, and the tree of each node:
    in each round every tree takes its heaviest edge to another."""
    tree, taken = np.arange(n), []
    left = np.argsort(weight, kind="stable")
    while True:
        a, b = tree[x[left]], tree[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return np.concatenate([np.zeros(0, np.int64), *taken]), tree
        best = np.full(n, -1)
        for end in (a, b):  # the last one written is the heaviest; of equal ones, both ends see the same
            later = np.full(n, -1)
            later[end] = np.arange(len(left))
            best = np.maximum(best, later)
        pick = np.unique(best[best >= 0])
        taken.append(left[pick])
        a, b = a[pick], b[pick]
        label = np.arange(n)
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        tree = label[tree]


def compared(leaves: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates of the leaves: a < b of different components whose sketches are nearly similar enough, with `agree`.

    A pair that shares several leaves is looked at in the one of least number. Where sketches leave no doubt, a forest of such pairs that spans them is enough; pairs in doubt are given unless both lie
    in one tree of it. So a group that is still in many components costs a pair for each document, not all pairs.
    """
    threshold = num / den

    def pairs(leaf: np.ndarray, role: np.ndarray, ids: np.ndarray, c: np.ndarray, n: np.ndarray, bits: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]])))
        found = []
        for lag in range(1, int(sizes.max(initial=1))):
            x = np.flatnonzero((leaf[lag:] == leaf[:-lag]) & (c[lag:] != c[:-lag]))
            y = x + lag
            fit = ((role[x] == 0) | (role[x] != role[y])) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
            x, y = x[fit], y[fit]
            likeness = similar(bits[x], bits[y])
            good = likeness >= threshold - MARGIN
            x, y, likeness = x[good], y[good], likeness[good]
            met = np.zeros(len(x), bool)  # in another leaf, of a lesser number
            for tree in range(before.shape[1]):
                one = before[x, tree]
                met |= (one != NOWHERE) & (one < leaf[x]) & (before[y] == one[:, None]).any(1)
            found.append((x[~met], y[~met], likeness[~met]))
        if not found:
            return
        x, y, likeness = (np.concatenate(f) for f in zip(*found, strict=True))
        names, node = np.unique(c, return_inverse=True)
        sure = np.flatnonzero(likeness >= threshold + MARGIN)
        taken, tree = spanning(node[x[sure]], node[y[sure]], likeness[sure], len(names))
        doubt = likeness < threshold + MARGIN
        doubt[doubt] = tree[node[x[doubt]]] != tree[node[y[doubt]]]
        keep = np.concatenate([sure[taken], np.flatnonzero(doubt)])
        if len(keep):
            x, y = ids[x[keep]], ids[y[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array((likeness[keep] * 1000).astype(np.int32))], ["a", "b", "agree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            got.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            others = batch.column(6)
            inside = np.diff(others.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), inside)
            wide = np.full((batch.num_rows, TREES), NOWHERE)
            wide[row, np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside)] = others.flatten().to_numpy()
            got.append(wide)
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last leaf may go on
            if cut:
                yield from pairs(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from pairs(*held)

    own = leaves.filter("role = 0").groupBy("id").agg(F.collect_set("leaf").alias("leaves"))  # one for each tree at most
    known = sets.select("id", "n", "sketch").join(own, "id", "left")
    rows = leaves.join(known, "id").select("leaf", "role", "id", "c", "n", "sketch", F.coalesce("leaves", F.array().cast("array<bigint>")).alias("leaves"))
    return rows.repartition("leaf").sortWithinPartitions("leaf", "role", "id").mapInArrow(run, "a long, b long, agree int").distinct()


def short_of_cover(opened: DataFrame, before: DataFrame | None, similarity: float) -> DataFrame:
    """The documents that need more trees: id and cover so far. opened: (id, depth) as `regions` gives it; each such row costs
    the difference to the next depth. A document without any is covered by one forest."""
    weight = [-math.log(1 - similarity**d) for d in DEPTHS]
    loss = F.coalesce(*[F.when(F.col("depth") == d, F.lit(weight[i] - weight[i + 1])) for i, d in enumerate(DEPTHS[:-1])])
    now = opened.groupBy("id").agg((F.lit(TREES * weight[0]) - F.sum(loss)).alias("cover"))
    if before is not None:
        now = now.join(before.withColumnRenamed("cover", "had"), "id", "left").select("id", (F.col("cover") + F.coalesce("had", F.lit(0.0))).alias("cover"))
    return now.filter(F.col("cover") < COVER)
