"""Temperature mixing of sources: p ** alpha, with alpha bisected to meet a repetition limit or a target entropy.

The largest source is read once; a smaller one is repeated (p_max / p) ** (1 - alpha) times. So nothing is dropped, and
the budgets of all sources stand in the proportion of the normalised weights. Budgets are realised as permutations in
blocks: every epoch of a source is a fresh permutation, its running token count is cut at the source's share of a block,
and block b of the mix is block b of every source. A source's rows are numbered in hash buckets, so no task needs a whole
source. The sources' totals are a table; what reaches the driver are sums over it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window

from flowlens.session import materialize

#: Fixed value: what separates two tokens where tokens are counted as words.
WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bisect(fits: Callable[[float], bool], steps: int = 60) -> float:
    """The least exponent in [0, 1] that fits, where all above it fit too; 1 if none does."""
    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def entropies(totals: DataFrame, alphas: list[float]) -> list[float]:
    """The entropy, in bits, of the weights share ** alpha of totals (total), for each alpha: one pass."""
    have = totals.filter("total > 0")
    whole = have.agg(F.sum("total").alias("s")).first()["s"]
    share = F.col("total") / F.lit(float(whole))
    sums = have.agg(*[F.sum(F.pow(share, F.lit(a))).alias(f"w{i}") for i, a in enumerate(alphas)], *[F.sum(F.pow(share, F.lit(a)) * F.log2(share)).alias(f"l{i}") for i, a in enumerate(alphas)]).first()
    return [math.log2(sums[f"w{i}"]) - a * sums[f"l{i}"] / sums[f"w{i}"] for i, a in enumerate(alphas)]


def entropy_alpha(totals: DataFrame, target: float, points: int = 32, rounds: int = 10) -> float:
    """The exponent in [0, 1] whose weights have the target entropy. One that no exponent has is refused."""
    most, least = entropies(totals, [0.0, 1.0])
    if not least - 1e-9 <= target <= most + 1e-9:
        raise ValueError(f"the entropy must lie between {least} (the sources as they are) and {most} (all alike)")
    low, high = 0.0, 1.0
    for _ in range(rounds):  # the entropy falls as alpha grows
        grid = [low + (high - low) * i / points for i in range(points + 1)]
        above = sum(h > target for h in entropies(totals, grid))
        low, high = grid[max(0, above - 1)], grid[min(points, max(1, above))]
    return high


def mix_plan(totals: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 1 << 18, bucket_rows: int = 2_000) -> DataFrame:
    """For each source of totals (source, total, n): its budget in tokens, its share of a block, its epochs, and the buckets
    that its rows are numbered in. Repeats are kept in thousandths. A target entropy goes before max_repeats; one of them
    must be given. Sources without tokens play no part."""
    if target_entropy is None and (max_repeats is None or max_repeats < 1):
        raise ValueError("give a target entropy, or a limit of repeats of at least 1")
    ends = totals.filter("total > 0").agg(F.max("total").alias("largest"), F.min("total").alias("least")).first()
    largest = ends["largest"] or 0
    if not largest:
        alpha = 1.0
    elif target_entropy is not None:
        alpha = entropy_alpha(totals, target_entropy)
    else:
        alpha = bisect(lambda a: (largest / ends["least"]) ** (1 - a) <= max_repeats)
    repeats = F.greatest(F.lit(1000), F.round(1000 * F.pow(F.lit(float(largest)) / F.col("total"), F.lit(1 - alpha))).cast("long"))
    budget = F.when(F.col("total") == 0, F.lit(0)).otherwise(F.call_function("div", F.col("total") * repeats, F.lit(1000).cast("long"))).cast("long")
    plan = materialize(totals.withColumns({"alpha": F.lit(alpha), "budget": budget}), 1)
    whole = max(1, plan.agg(F.sum("budget").alias("s")).first()["s"] or 0)
    part = F.expr(f"cast(cast(budget as decimal(38, 0)) * {block_tokens} div {whole} as bigint)")
    return plan.withColumns({
        "share": F.greatest(F.lit(1).cast("long"), part), "epochs": F.when(F.col("total") > 0, F.ceil(F.col("budget") / F.col("total"))).otherwise(F.lit(1)).cast("long"),
        "buckets": F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("long")})


def mix_sources(df: DataFrame, tokens: Column, key: str, source: str = "source", max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 1 << 18, seed: int = 11, bucket_rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """The mix as rows (key, source, n_tokens, epoch, block, position), and the plan, a row for each source.

    tokens: token count of a row; a null counts as 0. Null source is a source of its own. Rows of 0 tokens come once, in
    epoch 0. A repeated row (same key) gets the same place, twice. `position` orders a block: by the hash of the row. A very
    long text lies in the block where it begins. An empty table gives an empty mix.
    """
    rows = materialize(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens")))
    totals = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n")), 1)
    plan = materialize(mix_plan(totals, max_repeats, target_entropy, block_tokens, bucket_rows), 1)
    same = F.col("r.source").eqNullSafe(F.col("i.source"))
    # a few thousand rows are broadcast; an unknown number of sources is joined by shuffle
    each = rows.alias("r").join(F.broadcast(plan.alias("i")) if plan.count() <= 10_000 else plan.alias("i"), same).select("r.*", "total", "budget", "share", "buckets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    each = each.filter("epoch = 0 or n_tokens > 0").withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("key").cast("string"))))
    # the bucket is the leading part of the place, so buckets follow one another in the order of the permutation
    each = each.withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32)).cast("long"))
    sums = each.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"), (F.sum("t").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("t")).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "epoch", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = each.withColumn("inside", inside).join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b")))
    # tokens of the source's mix before this row; the last epoch ends where the budget does
    placed = placed.withColumn("before", F.col("epoch") * F.col("total") + F.col("ahead") + F.col("inside")).filter("epoch = 0 or before < budget")
    return placed.select("key", "source", "n_tokens", "epoch", F.expr("before div share").alias("block"), F.col("place").alias("position")), plan


def document_mix(docs: DataFrame, **params) -> DataFrame:
    """The mix of `documents` by source, in words: doc_id, source, n_tokens, epoch, block, position."""
    return mix_sources(docs, word_tokens(F.col("text")), "doc_id", **params)[0].withColumnRenamed("key", "doc_id")


def realised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs as the mix has them, repeated where it repeats them, with all columns. A block of the mix lies in
    one partition, in the order of its permutation. Ids are to be unique; a row with a null id has no place and stays once."""
    named = docs.filter(F.col(id_col).isNotNull())
    mix = mix_sources(named, word_tokens(F.col(text_col)), id_col, **params)[0]
    mix = mix.select(F.col("key"), F.struct("block", "position", "epoch").alias("place")).dropDuplicates(["key", "place"])
    rows = named.select(F.struct(*docs.columns).alias("row")).join(mix, F.col(f"row.`{id_col}`") == F.col("key"))
    rows = rows.repartition("place.block").sortWithinPartitions("place")
    placed = rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return placed.unionByName(docs.filter(F.col(id_col).isNull()))
