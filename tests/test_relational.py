"""Relational operators against plain joins and loops."""

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import vectors
from folioscope.operators import graph, relational, search


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_outer", "right_outer", "full_outer", "outer"])
def test_salted_join_equals_the_plain_one(spark, how):
    """Hot, cold, null and unmatched keys on both sides, under every kind of join."""
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (None, 51), (9, 52)], "k long, a long")
    right = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (3, 3), (None, 4)] + [(4, 5 + i) for i in range(30)], "k long, b long")
    got, want = relational.salted_join(left, right, "k", how, salts=64), left.join(right, "k", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_salted_join_refuses_other_kinds(spark):
    df = spark.createDataFrame([(1, 1)], "k long, a long")
    with pytest.raises(ValueError):
        relational.salted_join(df, df, "k", "left_anti")


def test_dense_search_in_blocks_equals_one_block(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, v array<float>")
    probes = df.filter("id % 4 = 0")
    one = sorted(map(tuple, search.dense(df, probes, "id", "v", 3).collect()))
    monkeypatch.setattr(search, "PROBES", 4)
    blocks = search.dense(df, probes, "id", "v", 3)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") > 1
    assert sorted(map(tuple, blocks.collect())) == one


def test_seeds_spread_to_the_first_members(spark):
    """The cap is cut before seeds meet members; the best seed of a cluster decides."""
    cluster = spark.createDataFrame([(f"n{k:02d}", "c" if k < 20 else "d") for k in range(25)], "node string, cluster string")
    seeds = spark.createDataFrame([("n00", 1.0), ("n05", 0.5), ("n21", 0.8), ("x", 0.1)], "node string, sim double")
    got = {r.node: r.sim for r in graph.seed_spread(seeds, cluster, cap=3).collect()}
    want = {"n00": 1.0, "n05": 0.5, "n21": 0.8, "x": 0.1} | {n: 1 / 20**0.5 for n in ("n01", "n02", "n03")} | {n: 0.8 / 5**0.5 for n in ("n20", "n22", "n23")}
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_value_lists_of_surfaces(spark):
    cases = {"aud750": True, "ZAR3": True, "BISP5": False, "PHPS2": False, "usd1.5m": False, "Word-Wrap": True, "risk-free": False, "保" * 15: False, "保" * 16: True, "保" * 16 + "（A）": False}
    df = spark.createDataFrame(list(cases.items()), "s string, want boolean")
    assert all(r.got == r.want for r in df.select("s", "want", X.is_junk(F.col("s")).alias("got")).collect())
    s = lambda f, x: spark.createDataFrame([(x,)], "s string").select(f(F.col("s"))).first()[0]
    assert s(X.catalogue_parts, "A，B；；C") == ["A", "B", "C"] and s(X.is_composite, "A，B") and not s(X.is_composite, "ABC, Inc.")
    assert s(X.clean_surface, "a ${^{2}}$ &amp; b $") == "a & b" and s(X.canonical, "ＡＢ　Ｃ") == "ab c"


@pytest.mark.parametrize("values,cells", [(6_400_000, 4_000_000), (20, 30)])
def test_dense_search_by_matrices_is_exact(spark, monkeypatch, values, cells):
    """Equal to a plain sort: ties, copies, repeated ids, near scores, null and short vectors; products are no row's expression."""
    monkeypatch.setattr(search, "VALUES", values)
    monkeypatch.setattr(search, "CELLS", cells)
    made = [(i, [round(((i * 7919) % 101) / 101 - 0.5, 3), 1.0 / (i % 9 + 1), float(i % 2), 4e-7 * (i % 5)]) for i in range(300)]
    made += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(7, [0.25, 0.5, 1.0, 0.0]), (None, [9.0] * 4), (400, None), (401, [1.0, None, 1.0, 1.0]), (402, [3.0]), (403, [float("nan"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(made, "id long, v array<float>")
    probes = df.filter("id % 10 = 0 OR id > 399")
    got = search.dense(df, probes, "id", "v", 12)
    both = df.join(probes.select(F.col("id").alias("probe"), F.col("v").alias("q")), F.col("probe") != F.col("id"))
    want = both.select("probe", "id", F.round(vectors.dot(F.col("v"), F.col("q")), 6).alias("score"))
    want = want.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), F.asc("id")))).filter("rank <= 12")
    text = lambda rows: sorted(map(str, map(tuple, rows)))
    assert text(got.collect()) == text(want.collect())
    assert "zip_with" not in search.dense(df.filter("id < 360"), probes.filter("id < 360"), "id", "v", 12)._jdf.queryExecution().toString()
