"""Evidence operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import evidence as E
from folioscope.operators.dictionary import dictionary_join


def test_dictionary_hits(spark):
    docs = spark.createDataFrame([(1, "Apex plan, apexplan; APEX PLAN_x apex plan"), (2, None), (3, "万通保险公司")], "id int, text string")
    words = spark.createDataFrame([("Apex Plan",), ("通保险公",), ("abc",)], "surface string")
    assert {(r.id, r.surface): r.n for r in dictionary_join(docs, words, "id", "text").collect()} == {(1, "apex plan"): 2, (3, "通保险公"): 1}


def test_filters(spark):
    m = spark.createDataFrame([("The", "person", 0.5), ("the", "person", 0.99), ("apex", "concept", 0.4), ("zenith", "other", 0.2)], "surface string, label string, score double")
    stop = spark.createDataFrame([("the ",)], "word string")
    assert sorted(r.surface for r in E.admitted(m, stop).collect()) == ["apex", "the", "zenith"]
    assert sorted(r.surface for r in E.above_threshold(m, {"concept": 0.5}, 0.3).collect()) == ["The", "the"]


def test_overlay_and_split(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    alias = spark.createDataFrame([("b", "a", 0.9), ("a", "c", 0.8), ("c", "a", 0.7)], "src string, dst string, weight double")
    assert {frozenset((r.src, r.dst)) for r in E.overlay(edges, alias).collect()} == {frozenset("ac")}
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, part int")
    assert [(r.src, r.dst) for r in E.split_cluster(alias, parts).collect()] == [("b", "a")]


def test_alias_audit(spark):
    rows = [('{"cos_sim":0.9,"rerank":0.8,"accepted_by":"x"}',), ('{"cos_sim":0.7,"rerank":0.6,"accepted_by":"x"}',), ("bad",)]
    r = E.alias_audit(spark.createDataFrame(rows, "features_json string")).first()
    assert (r.n, r.least, round(r.mean, 3), r.by_acceptor) == (3, 0.7, 0.8, {"x": 2, "unknown": 1})


def test_risk_view(spark):
    active = spark.createDataFrame([("e-x", 0.6), ("e-noise", 0.3)], "id string, score double")
    passages = spark.createDataFrame([("p-1", 0.8)], "hash_id string, score double")
    edges = spark.createDataFrame([("e-x", "p-1", 0.5), ("e-noise", "e-x", 0.1)], "source string, target string, weight double")
    got = {(r.source, r.target): r.weight for r in E.risk_view(active, passages, edges).collect()}
    assert got == {("customer", "rf_e-x"): 1.0, ("rf_e-x", "p-1"): 0.5}


def test_sources_and_settings(spark):
    pool = spark.createDataFrame([("u", None, 1, "", "s"), ("v", "u", 2, "t", None), ("w", None, 3, None, None)], "url string, redirect string, seq int, title string, snippet string")
    got = {r.url: (r.title, r.snippet) for r in E.merge_sources(pool).collect()}
    assert got == {"u": ("t", "s"), "w": (None, None)}
    legend = spark.createDataFrame([(1, "u"), (2, "x")], "number int, url string")
    assert {r.number: r.title for r in E.numbered_legend(legend, E.merge_sources(pool)).collect()} == {1: "t", 2: "x"}
    d = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {r.key: r.value for r in E.settings(d, d.filter("key = 'a'").withColumn("value", F.lit("9"))).collect()} == {"a": "9", "b": "2"}
    with pytest.raises(ValueError):
        E.settings(d, spark.createDataFrame([("z", "1")], "key string, value string"))


def test_seed_search_and_units(spark):
    stored = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.43589]), ("c", [0.5, 0.86603]), ("d", [0.0, 1.0])], "node string, v array<double>")
    probe = spark.createDataFrame([(1, [1.0, 0.0])], "probe int, q array<double>")
    assert [r.node for r in E.seed_search(probe, stored).orderBy("rank").collect()] == ["a", "b"]
    t = spark.createDataFrame([("f", "s2"), ("f", "s1"), ("g", "s3")], "file_id string, section_id string")
    assert [r[0] for r in E.units(t, "section", t.filter("file_id = 'f'")).collect()] == ["s1", "s2"]
    with pytest.raises(ValueError):
        E.units(t, "word")


def test_text_helpers(spark):
    df = spark.createDataFrame([("alpha beta. gamma delta", '```json\n[{"pattern":"a","weight":9},{"weight":1},{"pattern":"b"}]\n```')], "t string, j string")
    r = df.select(X.shorten(F.col("t"), 14).alias("s"), X.weighted_patterns(F.col("j")).alias("w"), X.mention_offsets(F.col("t"), F.lit("A")).alias("o"), X.mention_offsets(F.col("t"), F.lit("zz")).alias("n")).first()
    assert r.s == "alpha beta." and [(x.pattern, x.weight) for x in r.w] == [("a", 1.0), ("b", 1.0)]
    assert [x.start for x in r.o] == [i for i, c in enumerate("alpha beta. gamma delta") if c == "a"] and [x.start for x in r.n] == [-1]
    bad = spark.createDataFrame([("not json",), (None,)], "j string").select(X.weighted_patterns(F.col("j")).alias("w")).collect()
    assert all(x.w == [] for x in bad)
    html = spark.createDataFrame([("<style>x</style><tr><td>a</td><td>b</td></tr>| c | d |\n|---|---|\nend[1]",)], "t string").select(X.plain_markup(F.col("t"))).first()[0]
    assert html == "a b\n c d \nend" or html.split() == ["a", "b", "c", "d", "end"]


def test_grep(spark):
    df = spark.createDataFrame([(1, "a\nHit\nb\nc\nhit"), (2, "none")], "id int, t string")
    assert [(r.line_no, r.hit) for r in E.grep(df, "id", "t", "hit", 1).orderBy("line_no").collect()] == [(1, False), (2, True), (3, False), (4, False), (5, True)]


def test_idf_overlap_counts_frequent_words(spark):
    import math

    from folioscope.operators import evidence
    from folioscope.plans.evidence import idf_overlap, surface_idf_overlap

    sf = "/root/testdata/sf0.001"
    token = lambda name, key: {r[key]: {t.token for t in evidence.tokens_of(spark.read.parquet(f"{sf}/{name}.parquet").filter(f"{key} = {r[key]}"), key, "text").collect()} for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key).orderBy(key).limit(2).collect()}
    d, q = token("documents", "doc_id"), token("benchmark", "item_id")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    idf = {r.token: math.log((n + 1) / (r["count"] + 0.5)) for r in evidence.tokens_of(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text").distinct().groupBy("token").count().collect()}
    got = {(r.a, r.b): r.overlap for r in idf_overlap(spark, sf).collect()}
    for i, x in q.items():
        for k, y in d.items():
            x, both = x & idf.keys(), x & y
            want = sum(map(idf.get, both)) / sum(map(idf.get, x | y)) if both else None
            assert got.get((i, k)) is None if want is None else abs(got[i, k] - want) < 1e-6
    assert len(got) > surface_idf_overlap(spark, sf).count()  # pairs that share frequent words only


CLUSTER = [("a1", "a"), ("a2", "a"), ("b1", "b")]


def test_cluster_views(spark):
    edges = spark.createDataFrame([("a1", "p", 0.5), ("a2", "p", 0.5), ("a1", "q", 0.7), ("b1", "q", 0.2)], "surface string, passage string, weight double")
    cluster = spark.createDataFrame(CLUSTER, "node string, cluster string")
    assert [(r.cluster, r.surface, r.weight) for r in E.cluster_top_surfaces(edges, cluster, 1).orderBy("cluster").collect()] == [("a", "a1", 1.2), ("b", "b1", 0.2)]
    best = E.cluster_top_passages(edges, cluster, 2, 1).orderBy("cluster", "rank").collect()
    assert [(r.cluster, r.passage, r.weight, r.members) for r in best] == [("a", "p", 1.0, ["a1"]), ("a", "q", 0.7, ["a1"]), ("b", "q", 0.2, ["b1"])]
    assert E.cluster_top_passages(edges.limit(0), cluster).count() == 0


def test_shared_sentences(spark):
    m = spark.createDataFrame([("s", "a1"), ("s", "b1"), ("s", "b1"), ("t", "a2"), ("t", "a1"), ("t", "x"), ("u", "b1"), ("u", "a2"), ("v", "x")], "sentence string, surface string")
    pairs = E.pair_sentences(m)
    assert {(r.surface_a, r.surface_b, r.sentence) for r in pairs.collect()} == {("a1", "b1", "s"), ("a1", "a2", "t"), ("a1", "x", "t"), ("a2", "x", "t"), ("a2", "b1", "u")}
    cluster = spark.createDataFrame(CLUSTER, "node string, cluster string")
    got = E.cluster_cooccurrences(pairs.groupBy("surface_a", "surface_b").agg(F.count("*").alias("n")), cluster)
    assert {(r.cluster, r.other): (r.n, r.rank) for r in got.collect()} == {("a", "b"): (2, 1), ("a", "x"): (2, 2), ("b", "a"): (2, 1), ("x", "a"): (2, 1)}


def test_sentence_neighbours(spark):
    m = spark.createDataFrame([("s", "a1"), ("s", "b1"), ("s", "x"), ("t", "a2"), ("t", "a1"), ("t", "b1"), ("u", "a2"), ("u", "y"), ("v", "z")], "sentence string, surface string")
    cluster = spark.createDataFrame(CLUSTER, "node string, cluster string")
    sim = spark.createDataFrame([(1, "s", 0.9), (1, "t", 0.5), (1, "u", 0.1), (1, "v", 1.0)], "query int, sentence string, sim double")
    got = E.sentence_neighbours(sim.select("query", F.lit("a").alias("tail")), m, cluster, sim, sentences=2).orderBy("rank").collect()
    assert [(r.cluster, r.surface, r.top, r.mean, r.support, r.via) for r in got] == [("x", "x", 0.9, 0.9, 1, ["s"]), ("b", "b1", 0.9, 0.7, 2, ["s", "t"])]


def test_prompt_blocks(spark):
    rows = [(1, 2, "g", 7, None), (1, 1, "f", 3, "text"), (1, None, "h", 4, "more")]
    r = E.prompt_blocks(spark.createDataFrame(rows, "query int, number int, file_id string, page_id int, text string")).first()
    assert r.legend == "  [^1] file_id=f page_number=3\n  [^2] file_id=g page_number=7"
    assert r.block == "----- [^1] Page file_id=f page_id=3 -----\ntext\n\n----- [^2] Page file_id=g page_id=7 -----\n\n\n----- Page file_id=h page_id=4 -----\nmore\n"


def test_seed_search_by_matrices(spark):
    """Names and numbers as ids, ties in order of the node, a probe's equal node stays; a short vector is compared to none."""
    stored = spark.createDataFrame([(f"n{i:03d}", [(i % 10) / 10.0, 0.5]) for i in range(200)] + [("short", [1.0])], "node string, v array<double>")
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "probe int, q array<double>")
    got = E.seed_search(probes, stored, k=3, floor=0.4, drop=0.3)
    assert sorted((r.probe, r.node, r.sim, r["rank"]) for r in got.collect()) == [(p, n, s, k) for p, ns, s in ((1, ("n009", "n019", "n029"), 0.9), (2, ("n000", "n001", "n002"), 0.5)) for k, n in enumerate(ns, 1)]
    assert "zip_with" not in E.seed_search(probes.filter("probe < 3"), stored.filter("node <> 'short'"), k=3)._jdf.queryExecution().toString()
