"""Overlaps without a row for each token of a pair, and index batches without a pass for ranges of blocks."""

import math

from folioscope.operators import evidence
from folioscope.operators.graph import shared_path
from folioscope.operators.word_index import WordIndex


def test_overlap_of_few_is_that_of_the_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (3, "none")], "key long, token string")
    right = spark.createDataFrame([(10, "a"), (10, "b"), (10, "c"), (11, "b"), (12, "c"), (11, "b")], "key long, token string")
    idf = spark.createDataFrame([("a", 2.0), ("b", 0.5), ("c", 1.0)], "token string, idf double")
    got, want = ({(r.a, r.b): r.overlap for r in f(left, right, idf).collect()} for f in (evidence.idf_jaccard_of_few, evidence.idf_jaccard))
    assert got.keys() == want.keys() == {(1, 10), (2, 10), (1, 11), (2, 11)} and all(math.isclose(got[k], want[k]) for k in want)
    assert evidence.idf_jaccard_of_few(left.filter("false"), right, idf).count() == 0
    made = evidence.idf_jaccard_of_few(left, right, idf)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Join") == 2  # weights and numbers of tokens; the keys of the two sides don't meet in a join


def test_blocks_are_written_without_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "f", "alpha beta " * (i + 1)) for i in range(6)], "doc_id long, file_id string, text string")
    kind, seen = type(docs), []
    plain = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *c: seen.append(c) or plain(df, *c))
    index = WordIndex(spark, shared_path(spark, "test-index"), stripe=4, buckets=2)
    index.append(docs, "one")
    assert seen == [("length", "id")]
    asked = spark.createDataFrame([(1, "beta")], "query_id long, text string")
    assert index.search(asked, 6)[0].count() == 6
