"""K-d tree partitioning: recursive splits at distributed weighted medians along the widest metadata dimension.

The tree is a table: a node is the range of shards that it becomes, so neither the number of leaves nor the histograms
pass through the driver. Each level is found for all its nodes together: one aggregate for the extents, then histograms
(node, bucket) -> bytes that close in on the weighted median; the first spans just the node's own extent, so one or two
are enough. Texts are never moved.

Rows of one group (equal texts, say) stay together: they have the group's least metadata and one tie-break. A group of
more than a share of a leaf would make leaves uneven, and may be a third of all rows; it is dealt to pieces below that
share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from flowlens.session import materialize

_STEP = 11  # bits that one histogram resolves
#: A cut may be this share of a leaf off the weighted median, where no row lies nearer.
TOLERANCE = 1 / 512
#: A group of more than this share of a leaf's bytes is dealt to several pieces.
GROUP_SHARE = 1 / 8


def _dimension(value: Column, tie: Column, low: Column, high: Column) -> Column:
    """The value scaled to 31 bits, then the tie-break; null sorts first."""
    span = F.greatest(high - low, F.lit(1e-300))
    scaled = F.coalesce(F.floor((value - low).cast("double") / span * F.lit(2.0**31 - 2)).cast("long") + 1, F.lit(0).cast("long"))
    return F.shiftleft(scaled, 31).bitwiseOR(tie)


def _key(keys: list[str]) -> Column:
    """The key of the dimension that a row's node is split along."""
    return F.coalesce(*[F.when(F.col("__dim") == i, F.col(k)) for i, k in enumerate(keys)])


def _medians(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """For each open node of rows: __start, __dim, and __low, the key below which the bytes of its first half of shards lie."""
    wide = [F.shiftright(F.max(k), 31) - F.shiftright(F.min(k), 31) for k in keys]  # keys are scaled to the whole table's extent
    extents = rows.groupBy("__start", "__shards").agg(F.sum("__size").alias("bytes"), F.array(*wide).alias("wide"), F.array(*[F.min(k) for k in keys]).alias("lows"), F.array(*[F.max(k) for k in keys]).alias("highs"))
    first = F.array_position("wide", F.array_max("wide")).cast("int")
    low, high = F.element_at("lows", first), F.element_at("highs", first)
    bits = F.length(F.bin(high - low)).cast("int")  # the cut lies in [low, low + 2**bits)
    state = materialize(extents.select(
        "__start", (first - 1).alias("__dim"), low.alias("__low"), F.greatest(bits - _STEP, F.lit(0)).alias("__width"), F.lit(0.0).alias("__below"),
        (F.col("bytes") * F.expr("__shards div 2") / F.col("__shards")).alias("__goal"), F.lit(False).alias("__done")), 1)
    while not (open_ := state.filter("not __done")).isEmpty():
        placed = rows.join(open_.select("__start", "__dim", "__low", "__width"), "__start")
        offset = _key(keys) - F.col("__low")
        bucket = F.expr("shiftright(__offset, __width)")
        counted = placed.withColumn("__offset", offset).withColumn("__bucket", bucket).filter(F.col("__bucket").between(0, (1 << _STEP) - 1)).groupBy("__start", "__bucket").agg(F.sum("__size").cast("double").alias("n"))
        running = counted.withColumn("sum", F.sum("n").over(Window.partitionBy("__start").orderBy("__bucket")))  # 2**_STEP rows at most
        over = F.col("__below") + F.col("sum") > F.col("__goal")
        hit = running.join(open_.select("__start", "__below", "__goal"), "__start").groupBy("__start").agg(
            F.min(F.when(over, F.struct("__bucket", "n", (F.col("sum") - F.col("n")).alias("before")))).alias("hit"), F.max("__bucket").alias("last"))
        moved = open_.join(hit, "__start", "left")
        # no bucket reaches over the goal: the cut is behind the last
        bucket = F.coalesce("hit.__bucket", F.col("last") + 1, F.lit(0))
        below, n = F.col("__below") + F.coalesce("hit.before", F.lit(0.0)), F.coalesce("hit.n", F.lit(0.0))
        done = F.col("hit").isNull() | (n <= tolerance) | (F.col("__width") == 0)
        # what is left in the bucket hardly matters: cut on its nearer side
        behind = F.when(done & (n > 0) & (below + n / 2 < F.col("__goal")), 1).otherwise(0)
        moved = moved.select(
            "__start", "__dim", (F.col("__low") + F.expr("shiftleft(1L, __width)") * (bucket + behind)).alias("__low"),
            F.greatest(F.col("__width") - _STEP, F.lit(0)).alias("__width"), below.alias("__below"), "__goal", done.alias("__done"))
        state = materialize(state.filter("__done").unionByName(moved), 1)
    return state.select("__start", "__dim", "__low")


def kd_shards(df: DataFrame, size: Column, dims: dict[str, Column], row_id: str, shards: int | None = 16, target_bytes: int | None = None, group: Column | None = None, slot_rows: int = 50_000) -> DataFrame:
    """Deals df's rows into shards of nearly equal bytes; adds `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    size: bytes of a row, at least 1. dims: numeric metadata columns, null allowed (sorts first). shards or target_bytes
    (then as many shards as the total needs) says when to stop. The widest dimension of a node is the one whose extent,
    as a share of the whole table's extent, is largest; ties go to the first named. group: rows that agree in it are kept
    together, up to GROUP_SHARE of a leaf's bytes; null is no group. Equal values are told apart by a hash of the group,
    else of row_id, so one value may hold all rows and still be split. Identical rows have identical keys and can't be
    told apart; they stay together. An empty table gives an empty result. Columns of df named __* would clash and are refused.
    """
    if clash := [c for c in df.columns if c.startswith("__") or c in ("shard", "slot")]:
        raise ValueError(f"columns {clash} clash with the operator's own")
    names = [f"__d{i}" for i in range(len(dims))]
    rows = df.withColumns({"__size": size, "__group": F.lit(None).cast("string") if group is None else group.cast("string")} | {n: c.cast("double") for n, c in zip(names, dims.values(), strict=True)})
    rows = materialize(rows)
    whole = rows.agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"), *[f(n).alias(f"{n}_{s}") for n in names for s, f in (("lo", F.min), ("hi", F.max))]).first()
    total = int(whole["bytes"] or 0)
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 128 << 20)))
    tie = F.xxhash64(F.col(row_id))
    if group is not None:
        most = max(1.0, total / shards * GROUP_SHARE)
        shared = rows.filter("__group is not null").groupBy("__group").agg(F.count("*").alias("__n"), F.ceil(F.sum("__size") / most).alias("__pieces"), *[F.min(n).alias(f"{n}_of") for n in names])
        shared = materialize(shared.filter("__n > 1").drop("__n"))
        rows = rows.join(shared, "__group", "left")
        tie = F.when(F.col("__pieces").isNull(), tie).otherwise(F.xxhash64(F.lit(1), "__group", F.pmod(tie, F.col("__pieces"))))
        rows = rows.withColumns({n: F.when(F.col("__pieces").isNull(), F.col(n)).otherwise(F.col(f"{n}_of")) for n in names})
    keys = [f"{n}_key" for n in names]
    tie = F.pmod(tie, F.lit(1 << 31))
    lo_hi = [(float(whole[f"{n}_lo"] or 0), float(whole[f"{n}_hi"] or 0)) for n in names]
    keyed = rows.select(*df.columns, "__size", *[_dimension(F.col(n), tie, F.lit(lo), F.lit(hi)).alias(k) for k, n, (lo, hi) in zip(keys, names, lo_hi, strict=True)])
    keyed = materialize(keyed.withColumns({"__start": F.lit(0).cast("long"), "__shards": F.lit(shards).cast("long")}))
    for _ in range((shards - 1).bit_length()):
        cuts = _medians(keyed.filter("__shards > 1"), keys, total / shards * TOLERANCE)
        half = F.expr("__shards div 2")
        right = F.coalesce(_key(keys) >= F.col("__low"), F.lit(False))
        placed = keyed.join(cuts, "__start", "left")
        split = F.col("__low").isNotNull()
        keyed = materialize(placed.select(
            *df.columns, "__size", *keys, F.when(split & right, F.col("__start") + half).otherwise(F.col("__start")).alias("__start"),
            F.when(~split, F.col("__shards")).when(right, F.col("__shards") - half).otherwise(half).alias("__shards")))
    placed = keyed.select(*df.columns, F.col("__start").cast("int").alias("shard"))
    # slots: rows are counted by (shard, bucket of the id's hash), and numbered inside a bucket; no task sees a whole shard
    n_buckets = max(1, -(-int(whole["n"]) // shards // slot_rows))
    placed = placed.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(7), F.col(row_id)), F.lit(n_buckets)))
    counted = placed.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = counted.select("shard", "__bucket", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(row_id))
    out = placed.withColumn("__in", inside).join(before, ["shard", "__bucket"])
    return out.select(*df.columns, "shard", (F.col("__before") + F.col("__in") - 1).cast("long").alias("slot"))


def document_shards(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """`documents` in shards by law `bytes`: doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    Dimensions: size, doc_id, and hashes of the text, of lang and of source. Equal texts are one group. A null text has size
    1 and the checksum of no bytes, 0; it counts as an empty one. A very long text may make its shard larger than others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
        F.pmod(F.hash("lang"), F.lit(1009)).alias("lang_no"),
        F.pmod(F.hash("source"), F.lit(1009)).alias("source_no"),
    )
    dims = {"size": F.log2("size"), "doc_id": F.col("doc_id"), "text": F.col("text_crc32"), "lang": F.col("lang_no"), "source": F.col("source_no")}
    out = kd_shards(base, F.col("size"), dims, "doc_id", shards, target_bytes, F.col("digest"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
