"""The stored word index against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.operators.graph import shared_path
from folioscope.operators.word_index import WordIndex


@pytest.fixture(scope="module")
def docs(spark):
    """Words of falling frequency, copies, a null and an empty text."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    made = [(k, f"f{k % 7}", " ".join(rng.choice(words[: rng.choice([3, 10, 60])]) for _ in range(rng.randint(1, 80)))) for k in range(600)]
    made += [(600 + k, "f1", "w1 w2 rare rare") for k in range(20)] + [(700, "f2", None), (701, "f2", "")]
    return spark.createDataFrame(made, "doc_id long, file_id string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w0 w1 rare"), (2, "w40 w41 w59"), (3, "unknown"), (4, None), (5, "W3 w3 w5")], "query_id int, text string")


def listed(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


def test_index_equals_scan(spark, docs, queries):
    path = shared_path(spark, "test-index")
    index = WordIndex(spark, path, stripe=16, buckets=4)
    assert listed(index.search(queries, 5)[0]) == []
    one, two = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    assert index.append(one, "one")
    assert listed(index.search(queries, 5)[0]) == listed(search.bm25(one, queries, "doc_id", "text", 5))
    assert index.append(two, "two") and not index.append(two, "two")
    again = WordIndex(spark, path)  # opened anew, with the layout it was made with
    assert (again.stripe, again.buckets) == (16, 4)
    for k in (5, 1000):
        assert listed(again.search(queries, k)[0]) == listed(search.bm25(docs, queries, "doc_id", "text", k))
    assert again.remove("f1") == docs.filter("file_id = 'f1'").count() and again.remove("f1") == 0
    left = docs.filter("file_id <> 'f1'")
    assert listed(index.search(queries, 10)[0]) == listed(search.bm25(left, queries, "doc_id", "text", 10))
    back = docs.filter("file_id = 'f1'")
    assert index.append(back, "back")
    assert listed(index.search(queries, 10)[0]) == listed(search.bm25(docs, queries, "doc_id", "text", 10))
    assert index.append(docs.limit(0), "none")
    assert listed(index.search(queries, 10)[0]) == listed(search.bm25(docs, queries, "doc_id", "text", 10))


def test_only_postings_of_query_words_are_read(spark, docs, queries):
    index = WordIndex(spark, shared_path(spark, "test-index"), buckets=8)
    index.append(docs, "all")
    rows = index.postings(spark.createDataFrame([("w1",), ("rare",)], "word string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "In(word" in plan.split("PushedFilters:")[1]
    assert sorted(r["word"] for r in rows.select("word").distinct().collect()) == ["rare", "w1"]


def test_bounds_leave_stripes_out(spark):
    """One stripe of short texts about the words outbids all long ones: most stripes are never opened."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("f").alias("file_id"), F.expr("CASE WHEN id < 40 THEN 'apple pear' ELSE concat('apple ', repeat('other ', 50 + CAST(id % 100 AS INT)), 'pear') END").alias("text"))
    q = spark.createDataFrame([(1, "apple pear")], "query_id int, text string")
    index = WordIndex(spark, shared_path(spark, "test-index"), stripe=64, buckets=2)
    index.append(d, "all")
    found, read = index.search(q, 10)
    assert listed(found) == listed(search.bm25(d, q, "doc_id", "text", 10))
    got = read.first()
    assert got["stripes"] >= 60 and got["scored"] <= 4
