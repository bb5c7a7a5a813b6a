"""What is shuffled, paired and sent to the driver follows the input."""

import pytest

from folioscope.operators import attribution, graph
from folioscope.plans import base

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_slots_are_about_as_many_as_edges(spark):
    edges = spark.createDataFrame([("hub", f"passage-{i:05d}", 1.0 + i % 3) for i in range(5000)], "src string, dst string, weight double")
    slots, degree = attribution.walk_slots(edges)
    rows = slots.filter("src = 'hub'").orderBy("lo", "slot").collect()
    assert 5000 < len(rows) < 5000 * 1.05 and degree.filter("node = 'hub'").first().degree == 5000
    parts = sorted({(r.lo, r.hi) for r in rows})
    assert parts[0][0] == 0 and abs(parts[-1][1] - 1) < 1e-9 and all(abs(a[1] - b[0]) < 1e-12 for a, b in zip(parts, parts[1:], strict=False))
    before = cached(spark)
    goal = spark.createDataFrame([("passage-00007",)], "node string")
    attribution.attribution_walks(edges, spark.createDataFrame([("hub",)], "node string"), goal, lambda c: ~c.startswith("passage-"), 20, 4).collect()
    assert cached(spark) == before


def test_mentions_shuffle_no_texts(spark):
    exchanges = [x for x in plan(base.mentions(spark, SF)).split("\n") if "first(text" in x]
    assert not exchanges
    m = base.mentions_of_total(spark, SF)
    assert m.groupBy("passage").agg({"n": "sum", "total": "max"}).filter("`sum(n)` <> `max(total)`").count() == 0


def test_pagerank_shuffles_scores_only(spark):
    """The last rounds read the shares where they were dealt out: one exchange a round, and none is left in memory."""
    before = cached(spark)
    edges = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 1.0), ("a", "q", 2.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([("a", 1.0), ("lone", 1.0)], "node string, mass double")
    text = plan(graph.pagerank(edges, reset, 0.5, 3))
    assert "share#" not in text and cached(spark) == before
    got = {r.node: r.score for r in graph.pagerank(edges, reset, 0.5, 1).collect()}
    assert got == pytest.approx({"a": 0.375, "lone": 0.375, "p": 1 / 12, "q": 1 / 6})
