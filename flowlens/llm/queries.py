"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import clustering, decontaminate, exact_dedup, html_text, language, licenses, mixing, near_dedup, packing, personal, prefix_trie, sharding, substring_dedup
from flowlens.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("sentence_ids", "rules", "licences")])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.document_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_near_dedup, op3_exact_dedup, op4_license_scan, op5_substring_dedup, op6_packing, op7_language_id, op8_html_extraction, op9_kd_sharding, op10_temperature_mix, op11_centroid_clustering, op12_prefix_trie, op13_personal_data)}


def _clustering_sql(rounds: int = 10) -> str:
    """Lloyd's rounds written out one after the other, in integers; components in rows (i, pos, x), distances summed over them."""
    near = "SELECT i, j, d FROM (SELECT i, j, sum((x - c) * (x - c)) AS d FROM v JOIN c{r} USING (pos) GROUP BY i, j) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1"
    parts = ["""k AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
v AS MATERIALIZED (SELECT i, pos, floor(1024 * e[pos])::HUGEINT AS x FROM k, (SELECT unnest(range(1, 65)) AS pos)),
f AS (SELECT i, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS j FROM k),
c0 AS MATERIALIZED (SELECT j, pos, x AS c FROM v JOIN f USING (i) WHERE j < 8)"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT j, pos, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (i) GROUP BY j, pos)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN s{r} USING (j, pos))")
    return "WITH " + ",\n".join(parts) + f""",
h AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN k USING (i) JOIN h USING (j)"""


#: SQL of op13: a kind's pattern, whether a match x holds, the words that speak for it, what may not touch it, its score; as the contract
#: writes the base kinds, without what the Java patterns need to stay linear.
_LUHN = "list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 0 THEN substr({d}, i, 1)::BIGINT ELSE (2 * substr({d}, i, 1)::BIGINT) // 10 + (2 * substr({d}, i, 1)::BIGINT) % 10 END)) % 10 = 0"
_D = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_BARE = "replace(x.m, ' ', '')"
_PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 70, "mail|contact|write to|reach"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS BIGINT), 0) > 255)) = 0", 60, "address|host|server|client|login|logged|from"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({_D}) BETWEEN 14 AND 19 THEN {_LUHN.format(d=_D)} ELSE false END", 60, "card|visa|master|amex|credit|debit|payment|paid"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_D}) BETWEEN 10 AND 15", 60, "phone|tel|call|fax|mobile|cell|ring"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
     "NOT regexp_matches(right(x.b, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(x.a, 1), '[A-Za-z0-9]') AND coalesce(map_extract(" + f"MAP {personal.IBAN_LENGTHS}" + f", left({_BARE}, 2))[1], 0) = len({_BARE}) "
     f"AND list_reduce(list_concat([0::BIGINT], list_transform(string_split(substr({_BARE}, 5) || left({_BARE}, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda acc, n: (acc * CASE WHEN n < 10 THEN 10 ELSE 100 END + n) % 97) = 1", 60, "iban|account|bank|transfer"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(x.m, '^(?:000|666|9)|-00-|0000$') AND NOT regexp_matches(right(x.b, 1), '[A-Za-z0-9-]') AND NOT regexp_matches(left(x.a, 1), '[A-Za-z0-9-]')", 30, "ssn|social security|tax id|taxpayer"),
    ("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"NOT regexp_matches(right(x.b, 6), '(?:[A-Za-z0-9+.-]|\+[0-9]{1,3}[\x20.(]{1,2})$') AND NOT regexp_matches(left(x.a, 1), '[0-9-]')", 30, "phone|tel|call|fax|mobile|cell|ring"),
)


def _personal_sql() -> str:
    """Spans from the matches of a pattern and the stretches between them, a row for each match, places by a running sum."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = []
    for no, (kind, pattern, valid, score, words) in enumerate(_PERSONAL):
        near = f"{lower.format('right(x.b, 40)')} || ' | ' || {lower.format('left(x.a, 20)')}"
        points = f"greatest(0, least(100, {score} + CASE WHEN regexp_matches({near}, '{words}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches({near}, '{personal.AGAINST}') THEN 30 ELSE 0 END))"
        keep = valid if no < 4 else f"({valid}) AND {points} >= 50"
        parts.append(f"""SELECT r, {no} AS no, '{kind}' AS kind, e - len(x.m) AS s, e, {points} AS score FROM (
  SELECT r, x, (sum(len(x.b) + len(x.m)) OVER (PARTITION BY r ORDER BY x.i))::BIGINT AS e FROM (
    SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'i': i, 'm': m[i], 'b': g[i], 'a': g[i + 1]}})) AS x FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)))
WHERE {keep}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
l AS (SELECT r, {", ".join(f"count(*) FILTER (no = {i}) AS n_{k}" for i, k in enumerate(("email", "ip", "card", "phone")))},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) FILTER (no < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans,
  string_agg(score::VARCHAR, ',' ORDER BY s, no, e) AS scores FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN l USING (r)"""


ORACLES: dict[str, str] = {
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sym s ON s.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op4_license_scan": licenses.oracle_sql(),
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
runs AS (
  SELECT doc_id, s, sha256(array_to_string(words[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50)),
firsts AS (SELECT h, min(doc_id) AS lo FROM runs GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM runs JOIN firsts USING (h) WHERE doc_id > lo),
lists AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: l IS NULL OR NOT list_contains(l, x[2])), lambda x: x[1]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)""",
    "op10_temperature_mix": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total FROM d GROUP BY source),
m AS (SELECT max(total) AS largest, min(total) FILTER (total > 0) AS least FROM t),
b(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(CASE WHEN CAST(largest AS DOUBLE) / least <= 2.0 THEN 0 ELSE 1 END AS DOUBLE) FROM m
  UNION ALL SELECT i + 1, CASE WHEN pow(CAST(largest AS DOUBLE) / least, 1 - (lo + hi) / 2) <= 2.0 THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN pow(CAST(largest AS DOUBLE) / least, 1 - (lo + hi) / 2) <= 2.0 THEN (lo + hi) / 2 ELSE hi END FROM b, m WHERE i < 60),
alpha AS (SELECT hi AS alpha FROM b WHERE i = 60),
w AS (SELECT source, total, CASE WHEN total = 0 THEN 0 ELSE total * greatest(1000, CAST(round(1000 * pow(CAST(largest AS DOUBLE) / total, 1 - alpha)) AS BIGINT)) // 1000 END AS budget FROM t, m, alpha),
p AS (SELECT source, total, budget, greatest(1, budget * 262144 // greatest(1, CAST(sum(budget) OVER () AS BIGINT))) AS share, CASE WHEN total = 0 THEN 1 ELSE (budget + total - 1) // total END AS epochs FROM w),
e AS (SELECT d.doc_id, d.source, d.n_tokens, p.total, p.budget, p.share, unnest(range(0, p.epochs)) AS epoch FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, md5('11:' || epoch || ':' || doc_id) AS position FROM e WHERE epoch = 0 OR n_tokens > 0),
q AS (SELECT *, epoch * total + CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_tokens AS ahead FROM o)
SELECT doc_id, source, n_tokens, epoch, ahead // share AS block, position FROM q WHERE epoch = 0 OR ahead < budget""",
    "op11_centroid_clustering": _clustering_sql(),
    "op12_prefix_trie": r"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id AS c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)) AS turns FROM r GROUP BY conv_id),
h AS (
  SELECT c, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295::BIGINT) % 6 AS h FROM o, crc),
p AS (SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS path FROM h LEFT JOIN o b ON b.c = h.c - h.c % 100),
m AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
n AS (
  SELECT path[1:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT a.path, a.depth, count(*) AS n_children FROM n a JOIN n b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[n.depth].text) END AS saved FROM n LEFT JOIN k USING (path, depth)),
s AS (SELECT a.path, a.depth, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens FROM w a JOIN w b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN s USING (path, depth) LEFT JOIN n u ON u.depth = w.depth - 1 AND u.path = w.path[1:w.depth - 1]""",
    "op13_personal_data": _personal_sql(),
}
