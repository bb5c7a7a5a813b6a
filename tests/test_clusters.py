"""Stored alias clusters, canonical names and Leiden communities against plain Python."""

import random

import pytest

from folioscope.operators import alias, clusters
from folioscope.operators.graph import components, shared_path


def found(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_merging_batches_equals_a_full_run(spark):
    rng = random.Random(6)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(260)) if a != b]
    edges += [(f"n{k:03}", f"n{k + 1:03}") for k in range(400, 430)]
    store = clusters.ClusterStore(spark, shared_path(spark, "test-clusters"))
    assert store.labels().count() == 0
    seen = []
    for k, size in enumerate((40, 0, 150, len(edges))):
        batch = edges[len(seen) : len(seen) + size]
        df = spark.createDataFrame(batch + [(None, "n000"), ("n001", "n001")], "src string, dst string")
        assert store.merge(df, f"b{k}") and not store.merge(df, f"b{k}")
        seen += batch
        want = found(seen)
        assert dict(clusters.ClusterStore(spark, store.path).labels().collect()) == want
    full = spark.createDataFrame(edges, "src string, dst string")
    assert dict(components(full).select("node", "component").distinct().collect()) == want


def test_canonical_is_the_best_surface(spark):
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")], "node string, cluster string")
    names = spark.createDataFrame([("a", "Acme (Ltd", 9), ("b", "Acme", 2), ("c", "Acmo", 5)], "node string, surface string, n int")
    assert dict(clusters.canonical(labels, names).collect()) == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "d"}


def test_spelling_aliases_are_mutual_and_apart(spark):
    rows = [("p1", "acme", 3), ("p2", "acmes", 2), ("p3", "acne", 1), ("p1", "acne", 1), ("p4", "other", 4), ("p5", "othér", 1), ("p6", "x", 1), ("p7", "", 1)]
    m = spark.createDataFrame(rows, "passage string, surface string, n int")
    got = {tuple(r) for r in alias.spelling_aliases(m).collect()}
    assert got == {("acme", "acmes"), ("acmes", "acme"), ("other", "othér"), ("othér", "other")}


def quality(labels, edges, gamma):
    sizes = {}
    for c in labels.values():
        sizes[c] = sizes.get(c, 0) + 1
    return sum(w for a, b, w in edges if labels[a] == labels[b]) - gamma * sum(n * (n - 1) / 2 for n in sizes.values())


@pytest.fixture(scope="module")
def cliques():
    """Five cliques of six in a ring, joined by single edges, and a bridge node."""
    edges = []
    for c in range(5):
        edges += [(f"c{c}{i}", f"c{c}{j}", 1.0) for i in range(6) for j in range(i)]
        edges.append((f"c{c}0", f"c{(c + 1) % 5}1", 1.0))
    return edges + [("x", "c00", 1.0), ("x", "c30", 1.0)]


def test_leiden_finds_cliques_and_stays_connected(spark, cliques):
    df = spark.createDataFrame([*cliques, ("c00", "c00", 5.0), (None, "c00", 1.0)], "src string, dst string, weight double")
    got = dict(clusters.leiden(df, 0.4).select("node", "community").collect())
    for c in range(5):
        assert len({got[f"c{c}{i}"] for i in range(6)}) == 1
    assert len({got[f"c{c}0"] for c in range(5)}) == 5
    for own in set(got.values()):
        members = {x for x, c in got.items() if c == own}
        inside = [(a, b) for a, b, _ in cliques if a in members and b in members]
        assert len(members) == 1 or len(set(found(inside).values())) == 1 and set(found(inside)) == members
        assert own == min(members)
    assert clusters.leiden(df.limit(0), 0.4).count() == 0


def test_no_round_of_moves_lowers_the_quality(spark):
    rng = random.Random(7)
    edges = {}
    for _ in range(160):
        a, b = rng.randrange(40), rng.randrange(40)
        if a != b:
            edges[(f"n{min(a, b)}", f"n{max(a, b)}")] = rng.choice([0.5, 1.0, 2.0])
    flat = [(a, b, w) for (a, b), w in edges.items()]
    both = spark.createDataFrame(flat + [(b, a, w) for a, b, w in flat], "src string, dst string, weight double")
    names = sorted({x for e in edges for x in e})
    now = {x: x for x in names}
    gamma, value = 0.3, quality({x: x for x in names}, flat, 0.3)
    for _ in range(4):
        nodes = spark.createDataFrame([(x, 1, c) for x, c in now.items()], "node string, size long, comm string")
        moves = clusters._moves(nodes, both, gamma).collect()
        gain = sum(m["gain"] for m in moves)
        now.update({m["node"]: m["to"] for m in moves})
        after = quality(now, flat, gamma)
        assert after == pytest.approx(value + gain) and after >= value
        value = after
    labels = spark.createDataFrame(list(now.items()), "node string, comm string")
    assert clusters.quality(labels, spark.createDataFrame(flat, "src string, dst string, weight double"), gamma) == pytest.approx(value)
