"""The prefix trie of conversations: what they share from their first turn on, and what a cache of shared prefixes would save.

A turn is known by the digest of its role and text, so texts are not moved: a conversation becomes a path, 16 bytes a turn, with
the lengths of its texts. Equal paths are counted first. Paths are then dealt by the digest of their first turn, and each
bucket builds its tries of pointers (dictionaries from digest to node) in one applyInPandas call.

A first turn that many conversations share would make one bucket too large. Such a group is not built as it is: its least and
its greatest path give the prefix that all of it shares, whose nodes come from the group's sums; the rest is dealt again by
the next turn, and so on. What a bucket holds is bounded, whatever a first turn holds. The sums of a group come up from the
groups below it, level by level, in joins of tables with a row for each group.

A conversation itself, 24 bytes a turn, is one row. The digest of the ids that end at a node is a SHA-256 over all of them in
order, which can only be made from first to last: ids stream through in order, none are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.session import materialize, ship

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns that the paths of one first turn (or of one next turn below it) may have in a bucket, and turns of a bucket.
GROUP_TURNS, BUCKET_TURNS = 4096, 16384
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, WIDTH)


def turns(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id and its turns in order, array of (some, turn, digest, size). Null turns come first, turns
    of one number in the order of their digests; a null role or text is empty; rows without a conv_id belong to none."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("some"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 100, spread: int = 6) -> DataFrame:
    """conv_id, path and sizes of each conversation c as rebuilt: the first h turns of conversation c - c % family (none if there
    is none), then its own turns after its first h; h is the CRC-32 of c in decimal, modulo spread."""
    own = turns(conversations).select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))
    base = F.col("conv_id") - F.col("conv_id") % family
    own = materialize(own.withColumns({"base": base, "h": (F.crc32(F.col("conv_id").cast("string")) % spread).cast("int")}))
    heads = own.filter("conv_id = base").select(F.col("base").alias("b"), F.slice("turns", 1, spread - 1).alias("head"))
    joined = own.join(heads, F.col("base") == F.col("b"), "left")
    kept = F.concat(F.slice(F.coalesce("head", F.array().cast("array<struct<digest: binary, size: bigint>>")), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    path = F.unhex(F.array_join(F.transform("kept", lambda t: F.hex(t["digest"])), ""))
    return joined.select("conv_id", kept.alias("kept")).select("conv_id", path.alias("path"), F.transform("kept", lambda t: t["size"]).alias("sizes"))


def _ends(paths: DataFrame) -> DataFrame:
    """key (digest of a path) and the SHA-256 of the ids of its conversations, in numeric order, as decimals joined by commas."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, made = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if state is not None:
                        keys.append(now)
                        made.append(state.digest())
                    now, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.digest()], pa.binary())], names=["key", "ends"])

    ordered = paths.select(_digest("path").alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.mapInArrow(run, "key binary, ends binary")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """A row for each distinct path: path, sizes, n (its conversations), conv_id (the least of them), ends."""
    counted = paths.groupBy("path", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return counted.withColumn("key", _digest("path")).join(_ends(paths), "key").drop("key")


def _first(depth: Column) -> Column:
    """A path's first turns."""
    return F.substring(F.col("path"), F.lit(1), (depth * WIDTH).cast("int"))


def _shared(low: Column, high: Column) -> Column:
    """How many turns two paths share from the start."""
    least = F.least(F.octet_length(low), F.octet_length(high)) / WIDTH
    differ = F.filter(F.sequence(F.lit(0), least.cast("int")), lambda i: (i == least) | (F.substring(low, i * WIDTH + 1, F.lit(WIDTH)) != F.substring(high, i * WIDTH + 1, F.lit(WIDTH))))
    return F.get(differ, F.lit(0))


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's tries. rows: group (of the trie), up (the group above), up_conv (its least id), top (depth of the
    trie's own root), path, sizes, n, conv_id, ends. Returns NODE and group, up: null but for the roots of the tries."""
    roots: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    above, depth, size, n, conv, ends, marks = [], [], [], [], [], [], []

    def node(parent: int, at: int, length: int, mark) -> int:
        children.append({})
        for column, value in ((above, parent), (depth, at), (size, length), (n, 0), (conv, None), (ends, None), (marks, mark)):
            column.append(value)
        return len(above) - 1

    for group, up, up_conv, top, path, sizes, count, least, end in zip(*(rows[c] for c in ("group", "up", "up_conv", "top", "path", "sizes", "n", "conv_id", "ends")), strict=True):
        at, top = roots.get(group), int(top)
        if at is None:
            at = roots[group] = node(-1, top, int(sizes[top - 1]), (group, up, int(up_conv)))
        for turn in range(top, len(sizes) + 1):
            if turn > top:
                digest = path[WIDTH * (turn - 1):WIDTH * turn]
                below = children[at].get(digest)
                if below is None:
                    below = children[at][digest] = node(at, turn, int(sizes[turn - 1]), None)
                at = below
            n[at] += int(count)
            conv[at] = int(least) if conv[at] is None else min(conv[at], int(least))
        ends[at] = end
    leaves, saved = [0] * len(above), [0] * len(above)
    for i in range(len(above) - 1, -1, -1):  # postorder: a node is made after the one above it
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * size[i]
        if above[i] >= 0:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    parents = [marks[i][2] if a < 0 else conv[a] for i, a in enumerate(above)]
    out = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved})
    return out.assign(ends=pd.Series(ends, dtype=object), group=pd.Series([m and m[0] for m in marks], dtype=object), up=pd.Series([m and m[1] for m in marks], dtype=object))


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes that all paths of a group share: from its own root, at depth top, to the last one, at depth bottom."""
    for batch in batches:
        for r in batch.itertuples():
            top, bottom, n = int(r.top), int(r.bottom), int(r.n)
            own = (n - 1) * np.asarray(r.sizes[top - 1:bottom], np.int64)
            saved = own[::-1].cumsum()[::-1] + int(r.below_saved)
            k = bottom - top + 1
            one = [1] * (k - 1)
            yield pd.DataFrame({
                "conv_id": [int(r.conv_id)] * k, "depth": range(top, bottom + 1), "parent_conv_id": [int(r.up_conv)] + [int(r.conv_id)] * (k - 1), "n_convs": [n] * k,
                "n_children": one + [int(r.below)], "n_leaves": [int(r.below_leaves)] * k, "saved_tokens": saved,
                "ends": pd.Series([None] * (k - 1) + [r.ends], dtype=object)})


def trie(paths: DataFrame, group_turns: int = GROUP_TURNS, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path, sizes), as NODE; ends is null where no conversation ends."""
    spark = paths.sparkSession
    ship(spark)
    seqs = materialize(distinct_paths(paths))
    whole = seqs.agg(F.min("conv_id"), F.sum("n"), F.sum(F.size("sizes")), F.max(F.when(F.size("sizes") == 0, F.col("ends")))).first()
    if whole[0] is None:
        return spark.createDataFrame([], NODE)
    least, total, all_turns, root_ends = whole
    root = b""
    rows = seqs.filter(F.size("sizes") > 0).select(
        _digest(_first(F.lit(1))).alias("group"), F.lit(root).alias("up"), F.lit(least).cast("long").alias("up_conv"), F.lit(1).alias("top"), "path", "sizes", "n", "conv_id", "ends")
    small, large = [], []
    while True:
        sums = rows.groupBy("group").agg(
            F.sum(F.size("sizes") - F.col("top") + 1).alias("turns"), F.min(F.struct("path", "sizes")).alias("low"), F.max("path").alias("high"),
            F.sum("n").alias("group_n"), F.min("conv_id").alias("group_conv"), F.min("up").alias("group_up"), F.min("up_conv").alias("group_up_conv"), F.min("top").alias("group_top"))
        over = sums.filter(F.col("turns") > group_turns).withColumn("bottom", _shared(F.col("low.path"), F.col("high")))
        over = materialize(over.select(
            "group", F.col("group_up").alias("up"), F.col("group_up_conv").alias("up_conv"), F.col("group_top").alias("top"), "bottom", F.slice("low.sizes", F.lit(1), F.col("bottom")).alias("sizes"),
            F.col("group_n").alias("n"), F.col("group_conv").alias("conv_id")))
        if over.isEmpty():
            small.append(rows)
            break
        sides = over.select("group", F.col("bottom").alias("__bottom"), F.col("conv_id").alias("__conv"))
        marked = rows.join(sides, "group", "left")
        small.append(marked.filter("__bottom is null").select(*rows.columns))
        split = materialize(marked.filter("__bottom is not null"))
        ended = split.filter(F.size("sizes") == F.col("__bottom")).select("group", "ends")
        large.append(over.join(ended, "group", "left"))
        rows = split.filter(F.size("sizes") > F.col("__bottom")).select(
            _digest(_first(F.col("__bottom") + 1)).alias("next"), F.col("group").alias("up"), F.col("__conv").alias("up_conv"), (F.col("__bottom") + 1).cast("int").alias("top"), "path", "sizes", "n", "conv_id", "ends").withColumnRenamed("next", "group")
    dealt = small[0]
    for more in small[1:]:
        dealt = dealt.unionByName(more)
    buckets = max(1, -(-all_turns // bucket_turns))
    made = dealt.withColumn("bucket", F.pmod(F.hash("group"), F.lit(buckets))).groupBy("bucket").applyInPandas(build, NODE + ", group binary, up binary")
    nodes = materialize(made)
    tops = nodes.filter("group is not null").select("up", "n_leaves", "saved_tokens")
    found = [nodes.select(*_COLUMNS)]
    for level in reversed(large):
        below = tops.groupBy(F.col("up").alias("group")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
        level = level.join(below, "group", "left").withColumns({
            "below": F.coalesce("below", F.lit(0)), "below_leaves": F.coalesce("below_leaves", F.lit(1)), "below_saved": F.coalesce("below_saved", F.lit(0))})
        level = materialize(level)
        found.append(level.mapInPandas(_chain, NODE))
        own = F.aggregate(F.slice("sizes", F.col("top"), F.col("bottom") - F.col("top") + 1), F.lit(0).cast("long"), lambda acc, x: acc + x) * (F.col("n") - 1)
        tops = tops.unionByName(level.select("up", F.col("below_leaves").alias("n_leaves"), (F.col("below_saved") + own).alias("saved_tokens")))
    first = tops.filter(F.col("up") == F.lit(root)).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    found.append(first.select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(None if root_ends is None else bytes(root_ends)).cast("binary").alias("ends")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def conversation_trie(conversations: DataFrame, family: int = 100, spread: int = 6, group_turns: int = GROUP_TURNS, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Rows without a conv_id are left out, a table without conversations has no nodes, and a repeated row is a turn of its own.
    Only conv_id, turn, role and text are read, so no other column can clash.
    """
    nodes = trie(rebuilt(conversations.select("conv_id", "turn", "role", "text"), family, spread), group_turns, bucket_turns)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select(*_COLUMNS[:-1], F.coalesce(F.lower(F.hex("ends")), F.lit(none)).alias("ends_sha256"))
