"""Alias candidates cost their groups' size, and contraction sends nothing to the driver."""

import pytest

from folioscope.operators import alias, graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [1, 3])
def test_best_edits_are_those_of_all_pairs(spark, most):
    words = [f"wor{x}d" for x in "abcdefghijkl"] + [f"w{x}rd" for x in "aeiou"] + ["word", "wrd", "wo", "w", "x", "aab", "ab", "aa", "öab"]
    counted = spark.createDataFrame([(w, i * 7 % 5 + 1) for i, w in enumerate(words)], "node string, n long")
    got = {tuple(r) for r in alias.best_edits(counted, most).collect()}
    n = dict(counted.collect())
    shorter = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = lambda a, b: a != b and (a in shorter(b) or b in shorter(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)
    pairs = [(a, b) for a in n for b in n if near(a, b)]
    want = {(s, d) for s in n for d in sorted((d for a, d in pairs if a == s), key=lambda d: (-n[d], d))[:most]}
    assert got == want
    assert "Join" not in plan(alias.best_edits(counted, most))


def test_contraction_goes_past_the_driver(spark):
    edges = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 1.0)], "src string, dst string, weight double")
    made = graph.quotient(edges, spark.createDataFrame([("a", "a"), ("b", "a")], "node string, cluster string"))
    assert {tuple(r) for r in made.collect()} == {("a", "p", 2.0)} and "Broadcast" not in plan(made)
