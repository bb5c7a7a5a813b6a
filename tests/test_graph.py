"""Graph operators on a small property graph."""

from folioscope.operators import corpus, graph, order, relational

EDGES = [("a1", "p1", 1.0), ("a2", "p1", 0.5), ("a1", "p2", 0.4), ("b1", "p2", 0.6), ("b2", "p2", 0.3), ("c1", "p3", 1.0), ("c2", "p3", 0.5), ("d1", "p4", 1.0)]
ALIAS = [("a1", "a2"), ("a1", "a3"), ("b1", "b2"), ("c1", "c2")]


def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight double")


def test_pagerank_keeps_its_mass(spark):
    reset = spark.createDataFrame([("a1", 2.0), ("d1", -1.0), ("lonely", 2.0)], "node string, mass double")
    got = {r.node: r.score for r in graph.pagerank(edges(spark), reset, 0.5, 8).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["p1"] > got["p2"] > 0 and got.get("p4", 0) == 0
    empty = reset.filter("mass < 0")
    assert graph.pagerank(edges(spark), empty, 0.5, 2).count() == 0


def test_components_and_quotient(spark):
    alias = spark.createDataFrame(ALIAS, "src string, dst string")
    c = graph.components(alias)
    got = {r.node: r.component for r in c.collect()}
    assert got == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "c1": "c1", "c2": "c1"}
    q = {(r.src, r.dst): round(r.weight, 6) for r in graph.quotient(edges(spark), c.withColumnRenamed("component", "cluster")).collect()}
    assert q[("a1", "p1")] == 1.5 and q[("b1", "p2")] == 0.9
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(path).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_surface_components_link_by_every_shared_surface(spark):
    from folioscope.plans import graphs

    sf = "/root/testdata/sf0.001"
    rows = [(r.surface, r.passage) for r in graphs.mentions(spark, sf).collect()]
    up = {p: p for _, p in rows}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    first = {}
    for s, p in rows:
        a, b = sorted((root(first.setdefault(s, p)), root(p)))
        up[b] = a
    size = {}
    for p in up:
        size[root(p)] = size.get(root(p), 0) + 1
    got = {r.node: r.component for r in graphs.surface_components(spark, sf).collect()}
    assert got == {p: root(p) for p in up if size[root(p)] > 1}
    assert len(got) > graphs.connected_components(spark, sf).count()  # surfaces of three and more passages link too


def test_pagerank_on_the_quotient_goes_back_to_members(spark):
    reset = spark.createDataFrame([("a1", 1.0), ("a2", 2.0), ("p3", 1.0), ("b1", -4.0)], "node string, mass double")
    c = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B")], "node string, cluster string")
    got = {r.node: r.score for r in graph.quotient_pagerank(edges(spark), c, reset, 0.5, 8).collect()}
    by_hand = spark.createDataFrame([("A", "p1", 1.5), ("A", "p2", 0.4), ("B", "p2", 0.9), ("c1", "p3", 1.0), ("c2", "p3", 0.5), ("d1", "p4", 1.0)], "src string, dst string, weight double")
    want = {r.node: r.score for r in graph.pagerank(by_hand, spark.createDataFrame([("A", 3.0), ("p3", 1.0)], "node string, mass double"), 0.5, 8).collect()}
    name = {"a1": "A", "a2": "A", "b1": "B", "b2": "B"}
    assert abs(sum(want.values()) - 1) < 1e-9 and {"a1", "a2", "b1", "b2", "p1", "p2", "p3", "c1", "c2"} == set(got)
    assert all(abs(x - want[name.get(n, n)]) < 1e-12 for n, x in got.items())


def test_neighbourhood_and_induced(spark):
    seeds = spark.createDataFrame([("a2",)], "node string")
    got = {r.node: r.hop for r in graph.neighbourhood(edges(spark), seeds, 3).collect()}
    assert got == {"a2": 0, "p1": 1, "a1": 2, "p2": 3}
    keep = spark.createDataFrame([("a1",), ("p1",), ("p2",)], "node string")
    assert {(r.src, r.dst) for r in graph.induced(edges(spark), keep).collect()} == {("a1", "p1"), ("a1", "p2")}


def test_collapse_chase_and_spread(spark):
    e = edges(spark).withColumnsRenamed({"src": "surface", "dst": "passage"})
    canon = spark.createDataFrame([("a1", "a1"), ("a2", "a1")], "node string, canonical string")
    out, hidden = graph.collapse(e, canon)
    assert {(r.surface, r.passage): r.weight for r in out.collect()}[("a1", "p1")] == 1.5
    assert hidden.first().members == ["a2"]
    chain = spark.createDataFrame([("x", "y"), ("y", "z")], "node string, canonical string")
    assert {r.node: r.root for r in graph.chase(chain).collect()} == {"x": "z", "y": "z"}
    cluster = spark.createDataFrame([(x, "k") for x in ("m1", "m2", "m3", "m4")], "node string, cluster string")
    seeds = spark.createDataFrame([("m1", 0.8)], "node string, sim double")
    assert {r.node: round(r.sim, 3) for r in graph.seed_spread(seeds, cluster).collect()} == {"m1": 0.8, "m2": 0.4, "m3": 0.4, "m4": 0.4}


def test_adjacency(spark):
    rows = [("A", 1, "a1"), ("A", 2, "s"), ("A", 3, "a3"), ("B", 1, "b1"), ("B", 2, "s"), ("B", 3, "b3"), ("C", 1, "c"), ("C", 2, "d"), ("C", 3, "d")]
    occ = spark.createDataFrame(rows, "file_id string, page long, passage string")
    got = {(r.passage_a, r.passage_b) for r in corpus.adjacent_passages(occ).collect()}
    assert got == {("a1", "s"), ("a3", "s"), ("b1", "s"), ("b3", "s"), ("c", "d")}
    spread = occ.selectExpr("file_id", "page * 7000 as page", "passage")
    n = order.neighbours(spread, "file_id", "page", ["passage"], block=10_000)
    assert {(r.file_id, r.page): r.next_passage for r in n.collect()}[("A", 7000)] == "s"


def test_removal_and_append(spark):
    occ = spark.createDataFrame([("A", 1, "x"), ("A", 2, "s"), ("B", 1, "s")], "file_id string, page long, passage string")
    gone = corpus.remove_file(occ, "A")
    assert [r.passage for r in gone["removed_passages"].collect()] == ["x"] and gone["occurrences"].count() == 1
    m = spark.createDataFrame([("x", "only"), ("x", "both"), ("s", "both")], "passage string, surface string")
    assert [r.surface for r in corpus.orphan_surfaces(m, gone["removed_passages"]).collect()] == ["only"]
    store = spark.createDataFrame([("s", 9)], "passage string, page long")
    batch = spark.createDataFrame([("s", 1), ("n", 5), ("n", 3)], "passage string, page long")
    assert [(r.passage, r.page) for r in corpus.append_new(store, batch, "passage").collect()] == [("n", 3)]


def test_salted_and_as_of(spark):
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0), (3, 0)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, w string")
    assert sorted(map(tuple, relational.salted_join(left, right, "k", hot_share=0.1).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    a = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k long, t long, n string")
    b = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 6, 60)], "k long, t long, w long")
    assert {r.n: r.w for r in relational.as_of(a, b, "k", "t", ["w"]).collect()} == {"x": 50, "y": None, "z": None}


def test_visible(spark):
    v = spark.createDataFrame([("a1", False), ("a2", True), ("p1", None)], "node string, hidden boolean")
    seen, kept = graph.visible(v, edges(spark))
    assert sorted(r.node for r in seen.collect()) == ["a1", "p1"] and not kept.filter("src = 'a2'").count() and kept.filter("src = 'a1'").count() == 2
