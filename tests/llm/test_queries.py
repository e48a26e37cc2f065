"""The queries of the subpackage that have SQL, against DuckDB; the others as whole results."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, html_text, queries
from tests import test_queries as plain
from tests.test_queries import SF, compare

db = plain.db


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, db, name):
    compare(spark, db, queries.QUERIES[name], queries.ORACLES[name])


def edits(item, text):
    """The least edit distance of the item to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_op1_on_a_fixture_against_the_plain_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 700").limit(25)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) between 40 and 400").orderBy("item_id").limit(8)
    planted = items.limit(4).select((F.col("item_id") + 100_000).alias("doc_id"), F.concat(F.lit("xx "), F.substring("text", 1, 20), F.lit("zz"), F.expr("substring(text, 21)"), F.lit(" yy")).alias("text"))
    docs = docs.select("doc_id", "text").unionByName(planted).unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    want = {}
    for d in docs.collect():
        text = decontaminate.normalise(d["text"] or "")
        for i in items.collect():
            item = decontaminate.normalise(i["text"])
            least = edits(item, text) if text else len(item)
            if least <= decontaminate.budget(len(item)):
                want[d["doc_id"], i["item_id"]] = least
    assert got == want and got


def test_op9_digests_and_groups(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_kd_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {r["law"] for r in rows} == {"bytes"} and len(rows) == len(docs)


def test_op8_whole_result(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op8_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == html_text.main_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_long_texts_in_the_hashing_operators(spark):
    from flowlens.llm import exact_dedup, near_dedup, substring_dedup

    long = "".join(hashlib.md5(str(i).encode()).hexdigest() + " " for i in range(160_000))  # over 5 MB, so over a slice
    table = spark.createDataFrame([(1, long, "x"), (2, long.upper(), "y"), (3, long[:-40] + " end", "z"), (4, None, "w")], "doc_id long, text string, component_id string")
    exact = {r["id"]: r["keep_id"] for r in exact_dedup.exact_groups(table).collect()}
    assert exact == {1: 2, 2: 2, 3: 3, 4: 4}
    near = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(table).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4}
    cut = {r["id"]: r["n_removed"] for r in substring_dedup.deduplicated(table).collect()}
    assert cut[1] == 0 and cut[3] >= 159_000 and cut[4] == 0
