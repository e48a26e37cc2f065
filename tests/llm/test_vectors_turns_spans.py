"""Clustering, the prefix trie and personal data against plain Python, with the odd cases of each."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from flowlens.llm import clustering, personal, prefix_trie, queries

INT64 = 1 << 63


def lloyd(rows, k=8, rounds=10, dims=64):
    """Rows (vec_id, vector) clustered in Python's integers."""
    kept = [(i, [int(x) * 1024 if abs(x) > 1e300 else math.floor(x * 1024) for x in map(float, v)]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    own = [sum(d for _, d, j in out if j == c) for c in range(len(centroids))]
    fits = lambda x: x if x < INT64 else None
    return sorted(((i, j, fits(d), fits(own[j]), fits(sum(own)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in out), key=str)


def clustered(df):
    return sorted(map(tuple, clustering.cluster(df).collect()), key=str)


def vectors(seed):
    random.seed(seed)
    one = lambda s: [random.gauss(0, s) for _ in range(64)]
    odd = [(None, one(1)), (None, one(1)), (3, one(1)), (4, None), (5, [1.0] * 63), (6, [float("nan")] * 64), (7, [float("inf")] + [0.0] * 63), (8, [None] + [1.0] * 63), (9, [-0.0] * 64)]
    return [(i, one(1.0)) for i in range(40)] + [(i, one(1e6)) for i in range(40, 60)], odd, [(i, one(1e9)) for i in range(60, 70)] + [(70, one(1e305))]


def test_clusters_with_odd_vectors(spark):
    plain, odd, far = vectors(3)
    shape = "vec_id long, embedding array<double>, cluster string, distance int"
    for rows in (plain, plain + odd, plain + odd + far + plain[:5]):
        assert clustered(spark.createDataFrame([(*r, "x", 1) for r in rows], shape)) == lloyd(rows)
    few = spark.createDataFrame([(*r, "x", 1) for r in plain[:3]], shape)
    assert clustered(few) == lloyd(plain[:3]) and clustered(few.filter("false")) == []
    assert clustering.cluster(few.filter("false")).columns == clustering.cluster(few).columns


def test_distances_at_the_bounds_of_float64_and_int64():
    rng = np.random.default_rng(5)
    for top in (1 << 20, 1 << 23, 1 << 24, 1 << 27, 1 << 28, 1 << 40, 1 << 61):
        x = rng.integers(-top, top, (40, 64))
        c = [[int(v) for v in row] for row in rng.integers(-top, top, (5, 64))]
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, other, strict=True)) for other in c] for row in x]
        assert clustering.distances(x, c).tolist() == want
    ties = np.zeros((3, 64), np.int64)
    assert clustering.assigned(ties, [[1] * 64, [-1] * 64, [1] * 64])[0].tolist() == [0, 0, 0]


def test_blocks_keep_every_vector(spark):
    rows = [(i, [float(i)] * 64) for i in range(clustering.BLOCK_ROWS + 700)]
    blocks = clustering.as_blocks(clustering.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), "vec_id", "embedding", 64), 64, 1024).collect()
    assert sorted(b["n"] for b in blocks) == [700, clustering.BLOCK_ROWS] and sorted(i for b in blocks for i in b["ids"]) == list(range(len(rows)))


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie(rows):
    """The nodes of rows (conv_id, turn, role, text), from the sets of members of each prefix."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], (r, x)))
    turns = {c: [t[-1] for t in sorted(v, key=lambda t: t[:-1])] for c, v in turns.items()}
    members, whole, below, leaves, saved = {}, {}, {}, {}, {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below.get(p, []))
    ends = {p: ",".join(str(c) for c in sorted(m) if whole[c] == p) for p, m in members.items()}
    return sorted(map(str, ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())))


def nodes(df, **bounds):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in prefix_trie.conversation_trie(df, **bounds).collect())


def test_trie_with_shared_turns_copies_and_long_conversations(spark):
    random.seed(1)
    rows = [(c, random.choice([None, t, t, t]), random.choice(["user", None]), random.choice(["a", "b", "ü😀", None])) for c in [*range(-30, 600, 3), 7000] for t in range(random.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(None, 1, "user", "x"), rows[0], rows[0]]
    rows += [(2000 + i, j, "s", f"same {j}") for i in range(60) for j in range(30)]  # equal conversations
    rows += [(3000 + i, j, "s", f"same {j}" if j < 28 else f"d{i}") for i in range(50) for j in range(31)]  # a long common beginning
    rows += [(900_000, j, "u", str(j)) for j in range(300)]  # one alone is larger than a group may be
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    want = trie(rows)
    for most in (10, 60, 4096):
        assert nodes(df, group_turns=most, bucket_turns=100) == want


def test_trie_without_turns(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert nodes(spark.createDataFrame([], shape)) == [] and nodes(spark.createDataFrame([(None, 1, "u", "x")], shape)) == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)  # its only turn is replaced by none
    assert nodes(spark.createDataFrame([(turnless, 1, "u", "x")], shape)) == trie([(turnless, 1, "u", "x")])
    long = [(100, 0, "u", "y" * 3_000_000), (100, 1, None, "z"), (107, 0, "u", "q")]
    assert nodes(spark.createDataFrame(long, shape)) == trie(long)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    """The base spans by the contract's own patterns."""
    found = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), no, m.end()))
    return [f"{list(PATTERNS)[no]}:{a}:{b}" for a, no, b in sorted(found)]


def personal_rows(spark, texts, **columns):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", *columns.values())
    return {r["doc_id"]: r for r in personal.document_personal_data(df).collect()}


def test_base_spans_of_random_texts(spark):
    random.seed(5)
    texts = ["".join(random.choices("ab1.2-@+_ (0)%é\n5 ", k=200)) for _ in range(2000)]
    got = personal_rows(spark, texts, clash="'x' AS spans", other="'y' AS __text")
    wants = [base_spans(t) for t in texts]
    assert sum(map(bool, wants)) > 100
    for i, want in enumerate(wants):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(f"{k}:") for w in want) for k in PATTERNS]
        assert set(want) <= set(got[i]["spans"].split(","))


def test_added_spans_and_scores(spark):
    texts = [
        None, "", "nothing here",
        "IBAN DE89370400440532013000, bad DE89370400440532013001, GB82 WEST 1234 5698 7654 32 and XX89370400440532013000",
        "my SSN is 123-45-6789", "code 123-45-6789", "SSN 000-45-6789", "call 415-555-1234 today", "part 415-555-1234", "call +1 415-555-1234",
        "an example mail a@b.co", "by mail: a@b.co", "at a@b.co",
    ]
    got = personal_rows(spark, texts)
    shown = {i: dict(zip(r["spans"].split(","), r["scores"].split(","), strict=True)) if r["spans"] else {} for i, r in got.items()}
    assert shown[0] == shown[1] == shown[2] == {}
    assert list(shown[3]) == ["iban:5:27", "iban:57:84"] and shown[3]["iban:5:27"] == "90"
    assert shown[4] == {"ssn:10:21": "60"} and shown[5] == {} and shown[6] == {}
    assert shown[7] == {"tel:5:17": "60"} and shown[8] == {} and list(shown[9]) == ["phone:5:20"]
    assert [shown[i] for i in (10, 11, 12)] == [{"email:16:22": "70"}, {"email:9:15": "100"}, {"email:3:9": "70"}]


def test_very_long_texts_with_very_many_spans(spark):
    texts = ["a" * 1_000_000 + " 1" * 1000 + " a@b.c" * 3000 + "1.2.3.4 " * 3000, "a@b" + ".c" * 20_000 + " " + "1." * 50_000 + "7" * 300_000]
    got = personal_rows(spark, texts)
    for i, text in enumerate(texts):
        # the plain patterns would go over a run from each of its places: it is no part of any span, so another stands for it
        short = text.replace("a" * 1_000_000, "é" * 1_000_000).replace("7" * 300_000, "7" * 3_000)
        want = base_spans(short)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_no_python_on_the_main_path(spark):
    plan = queries.op13_personal_data(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
