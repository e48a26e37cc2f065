"""Exact, near and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import components, exact_dedup, forest, near_dedup, substring_dedup
from flowlens.llm.textnp import buffers, word_spans

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long"


def table(spark, texts):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in texts], SHAPE)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 260))) for _ in range(60)]
    for i in range(40):  # near copies of various distance
        parts = texts[i % 12].split()
        for _ in range(rng.randint(0, 6)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    shared = " ".join(rng.choices(words, k=70))
    texts += [" ".join(rng.choices(words, k=30)) + " " + shared + "\n" + " ".join(rng.choices(words, k=20)) for _ in range(6)]
    texts += [texts[0].upper(), texts[1], None, "", "   ", None, "one two", "One TWO", "é x   y", texts[5] * 3]
    return list(enumerate(texts))


def lower(t):
    return (t or "").encode().lower()


def test_words_split_as_stated():
    import pyarrow as pa

    texts = ["a b\tc\x0bd\x0ce\r\nf", "", None, " x\x1cy z", "q"]
    data, at = buffers(pa.array(texts))
    starts, ends, first = word_spans(data, at)
    got = [[data[starts[i]:ends[i]].tobytes() for i in range(a, b)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]


def test_exact_groups(spark):
    docs = corpus()
    out = {r["id"]: r for r in exact_dedup.exact_groups(table(spark, docs)).collect()}
    groups = {}
    for i, t in docs:
        groups.setdefault(lower(t), []).append(i)
    assert len(out) == len(docs)
    for i, t in docs:
        g = groups[lower(t)]
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"], out[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t)).hexdigest())


def test_exact_groups_survive_collisions(spark):
    docs = corpus()

    def colliding(*args):
        return exact_dedup.fingerprints(*args).withColumns({"fp": F.lit(1).cast("long"), "n_bytes": F.lit(1).cast("long")})

    want = exact_dedup.exact_groups(table(spark, docs)).collect()
    got = exact_dedup.exact_groups(table(spark, docs), fingerprint=colliding).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    prints = []
    for chunk in (1, 7, 256, 1024, 8192):
        t = exact_dedup._chunk_powers(chunk)
        prints.append(exact_dedup.fingerprint_block(data, np.array([0, 0, 3, 1500, 5000]), t).tolist())
    assert all(p == prints[0] for p in prints)
    plain = []
    for base in exact_dedup._BASES:
        h = 0
        for byte in data[1500:].tolist():
            h = (h * base + byte) % ((1 << 31) - 1)
        plain.append(h)
    assert prints[0][3] == plain[0] << 31 | plain[1] and prints[0][0] == 0


def components_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = lower(t).split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    docs = corpus()
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components_of(len(docs), links)
    out = {r["id"]: r for r in near_dedup.near_duplicates(table(spark, docs)).collect()}
    assert [(out[i]["component_id"], out[i]["n_shingles"], out[i]["kept"]) for i, _ in docs] == [(want[i], len(sets[i]), want[i] == i) for i, _ in docs]
    kept = near_dedup.representatives(table(spark, docs + docs[:5]))
    assert kept.columns == table(spark, docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def family(n, least=5000):
    """n pages of one template, 0.70 to 0.74 alike; two by two they share a line more and are just over 0.75."""
    rng = random.Random(8)

    def words(k):
        return [f"w{rng.randrange(1 << 40)}" for _ in range(k)]

    template, docs = words(250), []
    for i in range(n):
        if i % 2 == 0:
            line = words(12)
        docs.append((least + i, " ".join(template + line + words(33))))
    return docs


def test_every_pair_of_a_crowded_region(spark):
    docs = family(600)
    sets = [shingles(t) for _, t in docs]
    alike = [[len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(0, 40) if j != i] for i in range(40)]
    assert all(sum(x >= 0.75 for x in row) == 1 and min(row) >= 0.70 for row in alike)
    rng = random.Random(2)
    rng.shuffle(docs)
    out = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, docs)).collect()}
    assert out == {i: i - i % 2 for i, _ in docs}


def slotted(n, planted):
    """n pages of one template with 80 slots of two variants, about 0.63 alike, and copies of some with 16 slots changed."""
    rng = random.Random(4)
    template = [f"t{i}x{rng.randrange(1 << 30)}" for i in range(900)]
    slots = rng.sample(range(0, 900, 11), 80)
    choices = [[rng.randrange(2) for _ in slots] for _ in range(n)]
    origin = {}
    for j in range(planted):
        origin[n + j] = rng.randrange(n)
        choices.append([c ^ (k in changed) for changed in [set(rng.sample(range(80), 16))] for k, c in enumerate(choices[origin[n + j]])])
    docs = []
    for i, choice in enumerate(choices):
        words = list(template)
        for at, c in zip(slots, choice, strict=True):
            words[at] = f"{'ab'[c]}{at}"
        docs.append((i, " ".join(words)))
    rng.shuffle(docs)
    return docs, origin


@pytest.mark.parametrize("leaf", [1024, 64])
def test_links_of_a_family_with_few_variants(spark, leaf):
    docs, _ = slotted(380, 60)
    sets = {i: shingles(t) for i, t in docs}
    links = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components_of(len(docs), links)
    out = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, docs), leaf=leaf).collect()}
    assert sum(out[i] == out[j] for i, j in links) >= 0.98 * len(links) and all(want[i] == want[c] for i, c in out.items())


def test_regions_adapt_and_blocks_meet(spark):
    """Every two rows of different components that share a prefix of the least depth share a leaf, unless deeper values part them."""
    rng = random.Random(1)
    rows = [(i, i % 3 if i < 40 else 0, 7, *[7 if i < 70 else rng.randrange(2) + d for d in forest.DEPTHS[1:]]) for i in range(100)]
    shape = "id long, c long, " + ", ".join(f"h{d} long" for d in forest.DEPTHS)
    leaves, opened = forest.regions(spark.createDataFrame(rows, shape), most=12)
    inside = {}
    for r in leaves.collect():
        inside.setdefault(r["leaf"], []).append((r["id"], r["role"]))
    assert max(map(len, inside.values())) <= 70
    depths = [(r["id"], r["depth"]) for r in opened.collect()]
    assert {i for i, d in depths if d == 4} == set(range(100)) and {i for i, d in depths if d == 10} == set(range(70)) and forest.DEPTHS[-1] not in {d for _, d in depths}
    cover = {r["id"]: r["cover"] for r in forest.short_of_cover(opened, None, 0.75).collect()}
    assert set(cover) <= set(range(100)) and cover[0] < forest.COVER
    met = {frozenset((x, y)) for m in inside.values() for x, a in m for y, b in m if x != y and (a == 0 or a != b)}
    part = {r[0]: r[1] for r in rows}
    assert all(frozenset((x, y)) in met for x in range(70) for y in range(x) if part[x] != part[y])


def test_spanning_forests():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (5, 3), (60, 40), (60, 400)):
        x, y, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 5, m) / 5
        taken, tree = forest.spanning(x, y, w, n)
        want = components_of(n, list(zip(x.tolist(), y.tolist(), strict=True)))
        assert len({(a, b) for a, b in zip(tree.tolist(), want, strict=True)}) == len(set(want)) == len(set(tree.tolist()))
        assert components_of(n, [(int(x[i]), int(y[i])) for i in taken]) == want and len(taken) == n - len(set(want))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for n, share in ((3, 1.0), (40, 0.75), (900, 0.63), (900, 0.75), (20_000, 0.9)):
        both = int(round(2 * n * share / (1 + share)))
        common, x, y = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (both, n - both, n - both))
        words = [forest.sketch(np.sort(np.concatenate([common, z]))).view(np.uint64)[None] for z in (x, y)]
        assert abs(forest.similar(*words)[0] - both / (2 * n - both)) < forest.MARGIN


def test_a_hub_whose_copies_are_apart_from_one_another(spark):
    """Every copy is linked with the original only; all are one component."""
    rng = random.Random(5)
    original = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(original))]
    for i in range(1, 150):
        words = list(original)
        for at in rng.sample(range(200), 5):
            words[at] = f"x{rng.random()}"
        docs.append((i, " ".join(words)))
    out = near_dedup.near_duplicates(table(spark, docs)).collect()
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components_of(len(docs), links)
    assert {r["id"]: r["component_id"] for r in out} == dict(enumerate(want))


def test_components_of_a_path_a_star_and_a_ring(spark):
    rng = random.Random(9)
    names = rng.sample(range(1000), 120)
    links = [(names[i], names[i + 1]) for i in range(49)] + [(names[60], names[i]) for i in range(61, 90)] + [(names[i], names[90 + (i - 89) % 30]) for i in range(90, 120)] + [(5000, 5000)]
    want = components_of(5001, links)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: want[x] for pair in links for x in pair if x != 5000}


@pytest.mark.parametrize("length,gram", [(50, 16), (12, 5)])
def test_substring_dedup(spark, length, gram):
    docs = corpus()
    words = [(t or "").encode().split() for _, t in docs]
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s:s + length]), i)
    want = {}
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < i:
                gone |= set(range(s, s + length))
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    out = substring_dedup.deduplicated(table(spark, docs), length=length, gram=gram).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == want
    assert sum(x[1] for x in want.values()) > 0
    cut, _ = substring_dedup.repeats(table(spark, docs), length=length, gram=gram)
    for r in cut.collect():
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"] and all(b - a >= length for a, b in r["spans"])


def test_empty_tables_and_null_ids(spark):
    none = table(spark, [])
    assert exact_dedup.exact_groups(none).count() == near_dedup.near_duplicates(none).count() == substring_dedup.deduplicated(none).count() == 0
    odd = table(spark, [(None, "a b c d e f"), (None, None), (3, "a b c d e f")])
    assert exact_dedup.exact_groups(odd).count() == near_dedup.near_duplicates(odd).count() == substring_dedup.deduplicated(odd).count() == 3
    assert near_dedup.representatives(odd).count() == 3


@pytest.mark.parametrize("batch", ["1", "500"])
def test_a_region_over_several_partitions(spark, batch):
    width = 2 * near_dedup.MOST_DEPTH
    rows = [(10 * t + i, bytearray([t] + [7] * (2 * near_dedup.LEAST_DEPTH)).ljust(width, b"\0") + bytearray([i])) for t, n in ((0, 3), (1, 6), (2, 5)) for i in range(n)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found, crowded = (x.collect() for x in near_dedup.neighbours(spark.createDataFrame(rows, "id long, key binary")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    pairs = {(r["a"], r["b"]) for r in found}
    regions = {}
    for r in crowded:
        regions.setdefault(r["b"], set()).add(r["a"])
    parent = components_of(max(i for i, _ in rows) + 1, pairs)
    assert len({parent[i] for i, _ in rows}) == 3  # the parts of a region are candidates by their least ids
    for x, _ in rows:
        for y, _ in rows:
            if x < y and x // 10 == y // 10:
                assert (x, y) in pairs or any({x, y} <= m for m in regions.values())
    assert all(len({x // 10 for x in m}) == 1 for m in regions.values())
