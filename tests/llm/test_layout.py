"""Sharding, mixing, packing and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import decontaminate, mixing, packing, sharding
from tests.llm.test_dedup import components_of, shingles

SF = "/root/testdata/sf0.001"


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.document_shards(docs).collect()
    assert len(rows) == docs.count() == len({r["doc_id"] for r in rows})
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    leaf = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= max(2 * max(r["size"] for r in rows), 0.1 * leaf)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    group, where = Counter(), defaultdict(set)
    for r in rows:
        group[texts[r["doc_id"]]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(t) > 1 for t in where.values()) == 0 or max(group.values()) > leaf * sharding.GROUP_SHARE
    assert all(len(where[t]) == 1 for t, n in group.items() if n <= leaf * sharding.GROUP_SHARE)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_against_a_plain_tree(spark):
    """Cuts of a small table, found by sorting."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 50), rng.random() * 10, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, b long, x double, y double")
    out = {r["id"]: r["shard"] for r in sharding.kd_shards(df, F.col("b"), {"x": F.col("x"), "y": F.col("y")}, "id", 6, slot_rows=20).collect()}
    span = [(min(r[d] for r in rows), max(r[d] for r in rows)) for d in (2, 3)]

    def split(part, shards):
        if len(shards) == 1:
            return {r[0]: shards[0] for r in part}
        wide = [(max(r[d] for r in part) - min(r[d] for r in part)) / (span[d - 2][1] - span[d - 2][0]) for d in (2, 3)]
        part = sorted(part, key=lambda r: r[2 + wide.index(max(wide))])
        half = len(shards) // 2
        goal, below, cut = sum(r[1] for r in part) * half / len(shards), 0, 0
        while cut < len(part) and below + part[cut][1] <= goal:
            below += part[cut][1]
            cut += 1
        if cut < len(part) and below + part[cut][1] / 2 < goal:
            cut += 1
        return split(part[:cut], shards[:half]) | split(part[cut:], shards[half:])

    want = split(rows, list(range(6)))
    assert sum(out[i] != want[i] for i in want) <= 6  # a row at a cut may fall on either side


def test_shards_of_hard_tables(spark):
    same = spark.createDataFrame([(i, "x" * 10, None, "s") for i in range(4000)], "doc_id long, text string, lang string, source string")
    assert max(Counter(r["shard"] for r in sharding.document_shards(same).collect()).values()) <= 1.15 * 250
    long = spark.createDataFrame([(i, "x" * (1 if i else 500_000) + str(i), "a", "s") for i in range(40)], same.schema)
    assert len({r["shard"] for r in sharding.document_shards(long, 4).collect() if r["doc_id"] == 0}) == 1
    assert len({r["shard"] for r in sharding.document_shards(same, None, 1100).collect()}) >= 38
    empty = sharding.document_shards(same.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "a", None)], same.schema)
    assert sorted(r["size"] for r in sharding.document_shards(odd).collect()) == [1, 1]
    with pytest.raises(ValueError):
        sharding.kd_shards(same.withColumn("shard", F.lit(1)), F.lit(1), {"a": F.col("doc_id")}, "doc_id")
    assert {r["shard"] for r in sharding.kd_shards(same, F.lit(10), {"a": F.col("doc_id")}, "doc_id", None, 5000).collect()} == set(range(8))


def test_exponents(spark):
    tokens = [1000, 100, 10, 0]
    totals = spark.createDataFrame([(f"s{i}", t, 1) for i, t in enumerate(tokens)], "source string, total long, n long")
    assert abs(100 ** (1 - mixing.bisect(lambda a: 100 ** (1 - a) <= 4)) - 4) < 1e-6 and mixing.bisect(lambda a: True) == 0
    plan = {r["source"]: r for r in mixing.mix_plan(totals, max_repeats=4).collect()}
    assert [plan[f"s{i}"]["budget"] for i in range(4)] == [1000, 200, 40, 0]
    e = mixing.entropy_alpha(totals, 1.0)
    w = np.array([t**e for t in tokens if t]) / sum(t**e for t in tokens if t)
    assert abs(-(w * np.log2(w)).sum() - 1.0) < 1e-6
    for wrong in ({"target_entropy": 1.7}, {"target_entropy": 0.1}, {"max_repeats": None}, {"max_repeats": 0.5}):
        with pytest.raises(ValueError):
            mixing.mix_plan(totals, **wrong)
    assert mixing.mix_plan(totals.filter("total = 0")).first()["budget"] == 0


def test_mix_follows_the_budgets(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None]), "w " * rng.randint(0, 30)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix, plan = mixing.mix_sources(df, mixing.word_tokens(F.col("text")), "doc_id", max_repeats=3.0, block_tokens=500, bucket_rows=50)
    got = mix.collect()
    count = {i: len(t.split()) for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    total = Counter()
    for i, n in count.items():
        total[source[i]] += n
    assert {r["key"] for r in got} == set(count)  # nothing is dropped
    by = defaultdict(list)
    for r in got:
        assert r["n_tokens"] == count[r["key"]] and r["source"] == source[r["key"]]
        by[r["source"], r["epoch"]].append(r)
    plan = {r["source"]: r for r in plan.collect()}
    for s, budget in ((s, r["budget"]) for s, r in plan.items()):
        assert budget <= 3.01 * total[s] and budget >= total[s]
        before = 0
        for epoch in range(-(-budget // total[s])):
            part = sorted(by[s, epoch], key=lambda r: r["position"])
            assert len({r["key"] for r in part}) == len(part)
            for r in part:
                assert r["block"] == before // plan[s]["share"] and (epoch == 0 or before < budget)
                before += r["n_tokens"]
        assert before >= budget
    mixed = mixing.realised(df, block_tokens=500)
    assert mixed.columns == df.columns and {r["doc_id"] for r in mixed.collect()} == set(count)
    assert mixing.realised(df.limit(0)).count() == 0
    odd = df.limit(3).withColumns({"key": F.lit("k"), "place": F.lit(1), "doc_id": F.when(F.col("doc_id") > 0, F.col("doc_id"))})
    assert mixing.realised(odd).columns == odd.columns and mixing.realised(odd).count() >= 3


def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(8)
    for _ in range(50):
        size = rng.choice([7, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [f for f in free if f >= lengths[i]]
            if fits:
                free[free.index(min(fits))] -= lengths[i]
            else:
                free.append(size - lengths[i])
        rows = packing.best_fit_decreasing(lengths, size)
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(free)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


def unpacked(rows):
    """Document to its tokens, from packed rows; checks the rows on the way."""
    parts = defaultdict(dict)
    for r in rows:
        kind = f"<u{r['id_bytes']}"
        ids, at = np.frombuffer(r["ids"], kind), np.frombuffer(r["positions"], kind)
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and len(cu) == len(r["doc_ids"]) + 1 == len(r["starts"]) + 1
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            assert at[a:b].tolist() == list(range(b - a)) and start not in parts[doc]
            parts[doc][start] = ids[a:b].tolist()
        assert not at[cu[-1]:].any() and len(ids) == len(at)
    out = {}
    for doc, by_start in parts.items():
        out[doc] = []
        for start in sorted(by_start):
            assert start == len(out[doc])
            out[doc] += by_start[start]
    return out


@pytest.mark.parametrize("row,window", [(64, 1000), (2048, 4 << 20)])
def test_packing_round_trip(spark, row, window):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> é日\0")], docs.schema))
    rows = packing.pack_documents(docs, row=row, window_tokens=window).collect()
    with open(packing.VOCABULARY, "rb") as f:
        tokenizer = packing.encoding(f.read())
    got = unpacked(rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    assert {d: tokenizer.decode(ids) for d, ids in got.items()} == texts and len({r["pack_id"] for r in rows}) == len(rows)
    used = sum(r["n_tokens"] for r in rows)
    assert used >= 0.9 * row * len(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = [r for r in docs if any(c.isalpha() for c in r["text"] or "")]
    sets = [shingles(r["text"]) for r in known]
    links = [(i, j) for i in range(len(known)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    least = {}
    for r, c in zip(known, components_of(len(known), links), strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    kept = [r for r in known if r["doc_id"] in set(least.values())]
    matcher = decontaminate.Matcher(bench)
    clean = {r["doc_id"]: r["text"] for r in kept if not matcher.find(r["text"])}
    rows = corpus_pipeline.run(spark, SF).collect()
    counted = Counter()
    tokens = defaultdict(set)
    for r in rows:
        ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            counted[doc, start] += 1
            tokens[doc].add((start, tuple(ids[a:b].tolist())))
    with open(packing.VOCABULARY, "rb") as f:
        tokenizer = packing.encoding(f.read())
    assert {d: tokenizer.decode([t for _, part in sorted(parts) for t in part]) for d, parts in tokens.items()} == clean
    assert max(counted.values()) <= 3


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
