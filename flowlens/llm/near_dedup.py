"""Near-duplicate documents by an LSH forest over MinHash signatures.

Equal shingle sets are one class, and one document stands for it. Each tree of the forest is an order: the documents
sorted by their signature, read from another place. In a sorted order, the neighbours of a document are those with which
it shares the longest prefix, so it takes its nearest neighbours as candidates, if they share a least depth, and the
least id of the region of that depth. The orders are range-partitioned by signature and id, so a region of any size is
spread out.

Candidates whose signatures and sketches agree too little are dropped, the rest are verified on full shingle sets: first
those that most trees name, for each document, then those that would still join two components.

In a region of more documents than neighbours reach, most pairs are no candidates yet. Where the members of such a
crowded region are still in several components, they go through forests of adaptive depth (`forest`): crowded regions are
split by further signature values until all pairs of a leaf can be compared, and documents whose leaves are deep get more
trees.

With 32 trees and least depth 4, a pair of similarity 0.75 shares no tree with probability (1 - 0.75**4)**32 = 5e-6; deeper
forests are grown until they reach about the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from flowlens.llm import forest
from flowlens.llm.components import connected_components
from flowlens.llm.forest import least_values, permutations
from flowlens.llm.textnp import blocks, fixed_width, mix, shingle_sets
from flowlens.session import files_for, materialize, ship

TREES, LEAST_DEPTH, MOST_DEPTH = 32, 4, 12
VALUES = TREES * LEAST_DEPTH
NEIGHBOURS = 2
#: A candidate's estimated similarity may be this much below the threshold: over 5 standard deviations of 128 values.
MARGIN = 0.22

_FACTOR, _TERM = permutations(20240613, VALUES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the least value of the set under each of VALUES permutations."""
    return least_values(shingles, _FACTOR, _TERM).astype(np.uint16)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, a 128-bit key of the shingle set, and its signature, for every row of df."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in blocks(batch, "text"):
                sets = shingle_sets(data, at)
                keys = [((int(s.sum()) - (1 << 63)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x51ED2701)))) - (1 << 63)) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(map(len, sets), pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                    ["id", "n_shingles", "set_a", "set_b", "sig"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, sig binary")


def tree_rows(reps: DataFrame) -> DataFrame:
    """Each document (id, sig) in each tree: id and key, the tree's number and the signature from the tree's place on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                rows = batch.slice(i, 2048)
                sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, VALUES).astype(">u2")
                ids = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), TREES)
                key = np.empty((len(sig), TREES, 1 + 2 * MOST_DEPTH), np.uint8)
                for tree in range(TREES):
                    key[:, tree, 0] = tree
                    key[:, tree, 1:] = np.ascontiguousarray(sig[:, (tree * LEAST_DEPTH + np.arange(MOST_DEPTH)) % VALUES]).view(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(ids), fixed_width(key.reshape(len(ids), -1))], ["id", "key"])

    return reps.select("id", "sig").mapInArrow(run, "id long, key binary")


#: What a row of `neighbours` is: a candidate pair, a member of a crowded region, or what leads a part of a region.
PAIR, MEMBER, LEAD = 0, 1, 2


def neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of a forest, a < b, with the number n of trees that name them (a pair may come twice); and each member a of a region b (a hash of its prefix) in which not every
    pair may be a candidate: it has more than NEIGHBOURS + 1 members, or lies at the edge of a range partition.

    A region of any size may lie in several partitions; the least id of each part is a candidate with the least of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, prefix = 1 + 2 * MOST_DEPTH, 1 + 2 * LEAST_DEPTH
        ids, keys = np.zeros(0, np.int64), np.zeros((0, width), np.uint8)
        leader, held = None, 0  # of the region that the last batch ended in: its least id, its members so far
        named = at_head = False  # whether these were given as crowded; whether it is the partition's first region
        last = 0

        def rows_of(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(ids)
            ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)])
            keys = np.concatenate([keys, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)])
            found, members = [], []
            for lag in range(1, NEIGHBOURS + 1):
                here = np.arange(max(old, lag), len(ids))
                here = here[(keys[here, :prefix] == keys[here - lag, :prefix]).all(1)]
                x, y = ids[here], ids[here - lag]
                found.append((np.minimum(x, y), np.maximum(x, y)))
            heads = keys[old:, :prefix]
            edge = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(1)]))
            least = np.minimum.reduceat(ids[old:], edge)
            size = np.diff(np.append(edge, len(heads)))
            region = mix(np.ascontiguousarray(heads[edge, 1:]).view(np.uint64)[:, 0] + mix(heads[edge, 0].astype(np.uint64))).view(np.int64)
            total, crowds = size.copy(), np.zeros(len(size), bool)
            crowds[0] = leader is None
            if leader is not None and (keys[old - 1, :prefix] == heads[0]).all():
                found.append((np.array([min(leader, least[0])]), np.array([max(leader, least[0])])))
                least[0] = min(leader, least[0])
                total[0] += held
                crowds[0] = named
                if not named and total[0] > NEIGHBOURS + 1:
                    members.append((ids[old - held:old], np.repeat(region[:1], held)))
            elif leader is not None and at_head:
                yield rows_of(np.array([leader]), np.array([last]), LEAD)
            at_head = leader is None or at_head
            if len(size) > 1 and at_head:
                yield rows_of(least[:1], region[:1], LEAD)
                at_head = False
            crowds |= total > NEIGHBOURS + 1
            leader, held, named, last = least[-1], total[-1], crowds[-1], region[-1]
            crowd = np.repeat(crowds, size)
            members.append((ids[old:][crowd], np.repeat(region, size)[crowd]))
            least = np.repeat(least, size)
            found.append((np.minimum(least, ids[old:]), np.maximum(least, ids[old:])))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            yield rows_of(a[a != b], b[a != b], PAIR)
            yield rows_of(*(np.concatenate(c) for c in zip(*members, strict=True)), MEMBER)
            ids, keys = ids[-NEIGHBOURS - 1:], keys[-NEIGHBOURS - 1:]
        if leader is not None:
            yield rows_of(np.array([leader]), np.array([last]), LEAD)
            if not named:
                yield rows_of(ids[-held:], np.repeat(last, held), MEMBER)

    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = materialize(ordered.mapInArrow(run, "a long, b long, kind int").groupBy("a", "b", "kind").agg(F.count("*").alias("n")))
    leads = found.filter(F.col("kind") == LEAD).select("a", "b")
    least = leads.groupBy("b").agg(F.min("a").alias("least"))  # two rows for each range partition at most
    joined = leads.join(least, "b").filter("a != least").select(F.col("least").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("n"))
    return found.filter(F.col("kind") == PAIR).select("a", "b", "n").unionByName(joined), found.filter(F.col("kind") == MEMBER).select("a", "b")


def estimated(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs with `agree`, the signature values in which they agree, where these and the sizes of both sets allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, VALUES) for i in (2, 3))
            agree = (x == y).sum(1)
            good = pa.array(agree >= (num / den - MARGIN) * VALUES)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(agree.astype(np.int32)).filter(good)], ["a", "b", "agree"])

    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("n"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("m"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").filter(den * F.least("n", "m") >= num * F.greatest("n", "m"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, agree int")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, each: int = 2000) -> DataFrame:
    """The pairs (a, b) of a table whose sets have den * intersection >= num * union, compared in full. Both sets go with a
    pair; as they differ little in size, a pair costs no more than its lesser set does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                together = np.sort(np.concatenate([x, y]))
                both = int((together[1:] == together[:-1]).sum())
                linked.append(both > 0 and den * both >= num * (len(together) - both))
            good = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    dealt = pairs.select("a", "b").repartition(files_for(pairs.count(), each))  # the sets may be few, and broadcast
    return dealt.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def undecided(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """The members (a) of crowded regions (b) whose documents are in several components, as id."""
    placed = materialize(regions.join(parts.withColumnRenamed("node", "a"), "a", "left").select("a", "b", F.coalesce("component", "a").alias("component")))
    mixed = materialize(placed.groupBy("b").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("b"))
    return placed.join(mixed, "b", "left_semi").select(F.col("a").alias("id")).distinct()


#: Ids up to this number are broadcast to the texts: some tens of MB at most.
FEW_IDS = 400_000


def texts_of(every: DataFrame, ids: DataFrame, files: int) -> DataFrame:
    """The texts (id, text) of ids (id, each once). The ids are hashed, so that the texts stream by; a repeated row stays
    repeated, which does no harm to sets."""
    ids = materialize(ids, files, gather=True)
    small = F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("shuffle_hash")
    return every.join(small, "id")


def best_of(pairs: DataFrame, by: str, best: int) -> DataFrame:
    """The pairs (a, b) that are among the best of one of their ends."""
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc(by), "a", "b"))
    return pairs.withColumn("end", F.explode(F.array("a", "b"))).withColumn("rank", rank).filter(F.col("rank") <= best).select("a", "b").distinct()


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    where = parts.select(F.col("node").alias("a"), F.col("component").alias("x"))
    also = parts.select(F.col("node").alias("b"), F.col("component").alias("y"))
    return pairs.select("a", "b").join(where, "a", "left").join(also, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def settle(pairs: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int, best: int, files: int) -> tuple[DataFrame, DataFrame]:
    """The links with those of the candidates pairs (a, b, agree) added, and the components they make: first each
    document's best candidates are verified, then all that would still join two components."""
    first = materialize(best_of(pairs, "agree", best), files, gather=True)
    links = materialize(links.unionByName(verified(first, sets, num, den)))
    parts = connected_components(links)
    rest = materialize(apart(pairs.join(first, ["a", "b"], "left_anti"), parts), files, gather=True)
    more = materialize(verified(rest, sets, num, den))
    if more.isEmpty():
        return links, parts
    links = links.unionByName(more)
    return links, materialize(connected_components(links), files)


def link_crowded(crowd: DataFrame, links: DataFrame, parts: DataFrame, tested: DataFrame, num: int, den: int, best: int, files: int, most: int = forest.MOST) -> DataFrame:
    """The components with the links of the crowd (id, text) added, by forests of adaptive depth (see `forest`): one after
    the other, each for the documents whose cover is short, until none is. Pairs of `tested` are not tried again."""
    sets = materialize(forest.sketched(crowd))
    number, texts, cover = 0, crowd, None
    while True:
        rows = forest.tree_rows(texts, number).join(parts.withColumnRenamed("node", "id"), "id", "left")
        rows = materialize(rows.withColumn("c", F.coalesce("component", "id")).drop("component"))
        leaves, opened = forest.regions(rows, most)
        pairs = materialize(forest.compared(leaves, sets, num, den).join(tested, ["a", "b"], "left_anti"), files, gather=True)
        if not pairs.isEmpty():
            links, parts = settle(pairs, links, sets, num, den, best, files)
            tested = tested.unionByName(pairs.select("a", "b"))
        cover = materialize(forest.short_of_cover(opened, cover, num / den), files, gather=True)
        if cover.isEmpty():
            return parts
        texts = materialize(crowd.join(cover.select("id"), "id", "left_semi"))
        number += 1


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100, best: int = 2, leaf: int = forest.MOST) -> DataFrame:
    """Components of documents linked by den * intersection >= num * union of their distinct 5-word shingles (A-Z lower-cased).

    Returns a row for each row of df: id, n_shingles, component_id (least id reachable), kept (id = component_id). A null
    text, and one without words, has no shingles, is linked with nothing and is its own component. Rows repeated with one
    id are one document; an id with different texts is not provided for. A very long text is one row of a task. Ties of
    candidates go to the smaller ids. leaf: documents of a region that are all compared. An empty table gives an empty result. Only the two named columns are read.
    """
    sigs = materialize(signatures(df, id_col, text_col))
    files = files_for(sigs.count())
    # documents with equal sets are linked; the least stands for all of them
    classes = materialize(sigs.filter("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("size")), files)
    reps = sigs.filter("n_shingles > 0").join(classes.select(F.col("rep").alias("id"), "n_shingles", "set_a", "set_b"), ["id", "n_shingles", "set_a", "set_b"], "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "sig")
    reps = materialize(reps, 4 * files)
    near, crowded = neighbours(tree_rows(reps))
    near = materialize(near)
    every = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sets_of(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if known is not None:
            ends = ends.join(known.select("id"), "id", "left_anti")
        return materialize(forest.sketched(texts_of(every, ends, files)))

    # most of a group is one component after this; what is left to estimate are pairs between components
    first = materialize(best_of(near, "n", best), files, gather=True)
    pairs = materialize(estimated(first, reps, num, den), files, gather=True)
    sets = sets_of(pairs)
    links = materialize(verified(materialize(forest.resembling(pairs, sets, num, den), files, gather=True), sets, num, den))
    parts = connected_components(links)
    rest = materialize(estimated(apart(near.join(first, ["a", "b"], "left_anti"), parts), reps, num, den))
    if not rest.isEmpty():
        sets = sets.unionByName(sets_of(rest, sets))
        rest = materialize(forest.resembling(rest, sets, num, den))
        links, parts = settle(rest, links, sets, num, den, best, files)
    left = materialize(undecided(crowded, parts), files, gather=True)
    if not left.isEmpty():
        crowd = materialize(texts_of(every, left, files))
        parts = link_crowded(crowd, links, parts, near.select("a", "b"), num, den, best, files, leaf)
    found = classes.join(parts, F.col("rep") == F.col("node"), "left").select("n_shingles", "set_a", "set_b", F.coalesce("component", "rep").alias("component_id"), "size", "rep")
    # a class of one row whose component is itself needs no row here
    found = found.filter("size > 1 or component_id != rep").select("n_shingles", "set_a", "set_b", "component_id")
    out = sigs.select("id", "n_shingles", "set_a", "set_b").join(found, ["n_shingles", "set_a", "set_b"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near duplicates, with all columns; a null id takes no part, and its row stays."""
    named = df.filter(F.col(id_col).isNotNull())
    kept = near_duplicates(named, id_col, text_col).filter("kept").select(F.col("id").alias("__id")).distinct()
    # the ids are hashed and the rows stream by; only where an id is repeated are its rows sorted to keep one
    chosen = named.join(kept.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__id"), "left_semi")
    again = materialize(named.groupBy(F.col(id_col).alias("__again")).count().filter("count > 1").select("__again"))
    if not again.isEmpty():
        same = F.col(id_col) == F.col("__again")
        chosen = chosen.join(again, same, "left_anti").unionByName(chosen.join(again, same, "left_semi").dropDuplicates([id_col]))
    return chosen.unionByName(df.filter(F.col(id_col).isNull()))
