"""The index of vectors and the admission of alias edges."""

import math
import random

import numpy as np
import pyarrow as pa

from folioscope.functions import text as X
from folioscope.functions import vectors
from folioscope.operators import alias, search, vector_graph, vector_index
from folioscope.plans import neighbours
from tests.test_text import column


def _points(n, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    return [(i, [x + r.gauss(0, 0.6) for x in centres[i % 9]]) for i in range(n)]


def test_index_recall(spark):
    """A third of all rows are alike, some lack an id or a vector; searches find what an exact scan finds."""
    rows = _points(1500) + [(10_000 + i, [1.0] * 12) for i in range(700)] + [(None, [1.0] * 12), (99_999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    index = vector_index.build(df, "id", "v", k=5)
    assert index.rows.count() == 2200 and 1 < index.n_cells and 1 <= index.read <= index.n_cells
    probes = df.filter("id % 100 = 0 AND id < 10000")
    unit = index.rows.select("id", "v")
    exact = search.dense(unit, unit.join(probes.select("id"), "id"), "id", "v", 5)
    found = vector_index.nearest(index, probes, 5)
    n, hits = vector_index.recall_of(found, exact, "id").first()
    assert n == 75 and hits >= 0.9 * n
    every = vector_index.nearest(index, probes, 5, read=index.n_cells)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_index_of_few_rows(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert vector_index.nearest(vector_index.build(df.limit(0), "id", "v"), df, 3).count() == 0
    assert vector_index.nearest(vector_index.build(df.limit(1), "id", "v"), df.filter("id = 1"), 3).count() == 0
    both = vector_index.build(df, "id", "v")
    assert [tuple(r) for r in vector_index.nearest(both, df.filter("id = 1"), 3, read=9).collect()] == [(1, 2, 0.0, 1)]


def test_alias_gates(spark):
    """Pairs fail one gate each: one-sided, too few rare words, one place, a list of names, beyond the most similar."""
    names = [(1, "apex care plan"), (2, "apex care"), (3, "zenith plan"), (4, "apex care plus"), (5, "apex、care"), (6, "care apex"), (7, None)]
    surfaces = spark.createDataFrame(names, "node long, surface string")
    pairs = spark.createDataFrame([(1, d, s) for d, s in ((2, 0.9), (3, 0.8), (4, 0.7), (5, 0.95), (6, 0.6), (7, 0.5))], "src long, dst long, score double")
    places = spark.createDataFrame([("p", 1), ("p", 4), ("q", 2), ("q", 3)], "place string, node long")
    got = alias.admitted(pairs, surfaces, places, 0.35)
    assert sorted((r.src, r.dst, r.weight) for r in got.collect()) == [(1, 2, 0.9), (1, 6, 0.6)]
    assert [(r.src, r.dst) for r in alias.admitted(pairs, surfaces, places, 0.35, most=1).collect()] == [(1, 2)]
    df = {"apex": 5, "care": 5, "plan": 2}
    w = {k: math.log(8 / (v + 0.5)) for k, v in df.items()}
    overlap = {r.dst: r.overlap for r in alias.word_overlap(pairs, surfaces).collect()}
    assert abs(overlap[2] - (w["apex"] + w["care"]) / sum(w.values())) < 1e-6 and overlap[7] == 0.0


def test_mutual_neighbours(spark):
    lists = [(1, 2, 0.9, 1), (1, 3, 0.8, 2), (1, 4, 0.3, 3), (2, 1, 0.9, 1), (3, 4, 0.85, 1), (4, 1, 0.3, 1)]
    found = spark.createDataFrame(lists, "probe long, id long, score double, rank long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    find = lambda probes: found.join(probes.select(probes["id"].alias("probe")), "probe")
    assert [tuple(r) for r in alias.mutual_neighbours(find, nodes, nodes.filter("id = 1"), "id", 0.2, 0.3).collect()] == [(1, 2, 0.9)]


def test_surface_tokens_of_runs(spark):
    assert column(spark, X.surface_tokens, "保 险法 a_1 B") == [["w:a_1", "w:b", "h:保", "h:险法"]]


def test_graph_recall_and_share(spark):
    """Several shards, a third of all rows alike, rows without id or vector: nine tenths are found, in less than a fifth of the comparisons."""
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(4000)] + [(10_000 + i, [1.0] * 24) for i in range(2000)] + [(None, [1.0] * 24), (99_999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    index = vector_graph.build(df, "id", "v", k=5, shard_bytes=2000 * 24 * 8)
    assert index.shards.count() == 3 and index.members.count() == 6000
    probes = df.filter("id % 100 = 0 AND id < 11000")
    unit = vector_graph.keyed(df, "id", "v").filter("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    exact = search.dense(unit, unit.join(probes.select("id"), "id"), "id", "v", 5)
    found = vector_graph.nearest(index, probes, 5)
    n, hits = vector_index.recall_of(found, exact, "id").first()
    assert n == 250 and hits >= 0.9 * n
    compared, of = vector_graph.compared_share(index, probes, 5).first()
    assert of == 50 * 4001 and compared < of / 5
    alike = [r.id for r in found.filter("probe = 10000").orderBy("rank").collect()]
    assert alike == [10_001, 10_002, 10_003, 10_004, 10_005]
    every = vector_graph.nearest(index, probes, 5, beam=4001)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_graph_of_few_rows(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "id long, v array<double>")
    for n, want in ((0, []), (1, []), (2, [(1, 2, 0.0, 1)]), (3, [(1, 3, 1.0, 1), (1, 2, 0.0, 2)])):
        index = vector_graph.build(df.filter(f"id <= {n}"), "id", "v")
        got = vector_graph.nearest(index, df.filter("id = 1"), 3).orderBy("rank")
        assert [tuple(r) for r in got.collect()] == want


def test_graph_reaches_all_nodes():
    """The tree's links survive the cut of crowded nodes, also where most points lie together."""
    points = np.random.default_rng(2).normal(size=(700, 6)) * np.r_[np.full(600, 0.01), np.ones(100)][:, None] + 1
    links = vector_graph.link(points, degree=3)
    reached, edge = {0}, [0]
    while edge:
        edge = sorted({int(x) for i in edge for x in links[i] if x >= 0} - reached)
        reached |= set(edge)
    assert len(reached) == 700


def test_unit_makes_the_norm_once(spark):
    """The norm stands once in the expression, outside the division of each number, so the cost is linear in the width."""
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = df.select("id", vectors.unit(df.v).alias("u"), vectors.norm(df.v).alias("n")).orderBy("id").collect()
    assert [(r.u, r.n) for r in got] == [([0.6, 0.8], 5.0), ([0.0, 0.0], 1.0), (None, None), ([], 1.0), ([None, None], None)]
    assert df.select(vectors.unit(df.v)).columns[0].count("aggregate(") == 1


def test_recall_and_share_of_one_walk(spark, monkeypatch):
    """The query walks for the beam once and for its probes once; recall and comparisons come of the same walks."""
    calls, walks = [], vector_graph.walks
    monkeypatch.setattr(vector_graph, "walks", lambda *a: (calls.append(a[3]), walks(*a))[1])
    assert tuple(neighbours.graph_recall(spark, "/root/testdata/sf0.001").first()) == (5, 50, True, True)
    assert len(calls) == 2


def test_every_shard_has_its_task(spark):
    """Nine shards are made by nine tasks, a file each, wherever hashes of their numbers would have put them."""
    df = spark.createDataFrame(_points(900), "id long, v array<double>")
    index = vector_graph.build(df, "id", "v", k=5, shard_bytes=100 * 12 * 8)
    assert index.shards.count() == 9 and len(index.shards.inputFiles()) == 9
    assert sorted(k for r in index.shards.collect() for k in r["keys"]) == sorted(r.key for r in index.members.collect())


def test_index_search_sends_probes_once(spark):
    """1,500 probes that read all of 39 cells: no table of a row for each probe and cell is sent to the tasks, nor are pairs scored one by one."""
    df = spark.createDataFrame([(str(i), v) for i, v in _points(1500) + [(2000 + i, [1.0] * 12) for i in range(40)]], "id string, v array<float>")
    index = vector_index.build(df, "id", "v", k=5)
    was = {c: spark.conf.get(c) for c in ("spark.sql.maxBroadcastTableSize", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = vector_index.nearest(index, df, 5, read=index.n_cells)
        got = sorted(map(tuple, found.collect()))
    finally:
        for c, value in was.items():
            spark.conf.set(c, value)
    unit = index.rows.select("id", "v")
    assert index.n_cells == 39 and got == sorted(map(tuple, search.dense(unit, unit, "id", "v", 5).collect()))
    assert "zip_with" not in found._jdf.queryExecution().toString().split("MapInArrow")[0]


def test_best_of_cells(monkeypatch):
    """Each probe meets its cells only, its own rows aside; of rows of one score the least ids stay, whatever the batches."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(300, 4)), 1)
    x[100:160] = x[100]
    ids, cell = [f"r{i % 290:03d}" for i in range(300)], r.integers(0, 11, 300).astype(np.int32)
    probes, reads = list(range(0, 300, 7)), r.random((43, 11)) < 0.6
    column = lambda v: pa.array(list(v), pa.list_(pa.float64()))
    asked = pa.table({"probe": [ids[i] for i in probes], "_q": column(x[probes]), "cells": [b.tobytes() for b in np.packbits(reads, axis=1)]})
    want = []
    for n, i in enumerate(probes):
        near = sorted((-round(float(sum(a * b for a, b in zip(x[j], x[i], strict=True))), 6), ids[j]) for j in range(300) if reads[n, cell[j]] and ids[j] != ids[i])
        want += [(ids[i], *row) for row in near[:5]]
    for rows, scores in ((300, 4_000_000), (40, 60), (1, 1)):
        monkeypatch.setattr(search, "CELLS", scores)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + rows]), column(x[a : a + rows]), pa.array(cell[a : a + rows])], names=["id", "v", "cell"]) for a in range(0, 300, rows)]
        out = pa.Table.from_batches(vector_index._best_of_cells(iter(batches), asked, 5)).to_pylist()
        assert len(out) < 43 * 20
        best = [sorted((-round(o["_s"], 6), o["id"]) for o in out if o["probe"] == p)[:5] for p in asked["probe"].to_pylist()]
        assert [(p, *row) for p, some in zip(asked["probe"].to_pylist(), best, strict=True) for row in some] == want


def test_recall_sends_probes_once(spark, tmp_path):
    """Each of 1,500 rows is a probe; the query holds no table of a row for each probe and cell."""
    v = np.random.default_rng(8).normal(size=(1500, 24))
    rows = [(100 * i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    was = {c: spark.conf.get(c) for c in ("spark.sql.maxBroadcastTableSize", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert tuple(neighbours.ann_recall(spark, str(tmp_path)).first()) == (1500, 15_000, True)
    finally:
        for c, value in was.items():
            spark.conf.set(c, value)
