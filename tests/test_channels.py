"""Walk attribution against walks one by one, and seeds in stages."""

import hashlib

from folioscope.operators.attribution import attribution_walks
from folioscope.operators.fallback import staged_seeds
from tests.test_graph import EDGES, edges


def walked(rows, seeds, targets, walks, steps):
    """The same walks, one at a time."""
    near = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    out = {}
    for seed in seeds:
        for walk in range(1, walks + 1):
            at, entity = seed, None
            for k in range(1, steps + 1):
                if at in targets:
                    key = (at, entity or at)
                    out[key] = out.get(key, 0) + 1
                    break
                if k == steps or at not in near:
                    break
                u = int(hashlib.md5(f"{seed}:{walk}:{k}".encode()).hexdigest()[:13], 16) / 2**52
                total, run = sum(near[at].values()), 0.0
                for to in sorted(near[at], key=lambda x: (hashlib.md5(x.encode()).hexdigest()[:2], x)):
                    run += near[at][to]
                    if u < run / total:
                        break
                entity, at = (at if at[0] != "p" else entity), to
    return out


def test_walks_equal_walks_one_by_one(spark):
    rows = [*EDGES, ("hub", "p1", 0.1), *[("hub", f"x{k}", 0.01 + k % 7) for k in range(300)], ("hub", "a1", 0.5)]
    node = lambda names: spark.createDataFrame([(x,) for x in names], "node string")
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    seeds, targets = ["a1", "b1", "hub", "p4", "lonely"], ["p1", "p3", "p4", "x5"]
    got = attribution_walks(df, node([*seeds, "a1", None]), node([*targets, "p1"]), lambda c: ~c.startswith("p"), 300, 6)
    found = {(r.target, r.credited): r.n for r in got.collect()}
    assert found == walked(rows, seeds, targets, 300, 6)
    assert found[("p4", "p4")] == 300
    assert attribution_walks(df.limit(0), node(["a1"]), node(["p1"]), lambda c: ~c.startswith("p")).count() == 0


def test_every_passage_is_credited_to_entities(spark):
    node = lambda names: spark.createDataFrame([(x,) for x in names], "node string")
    got = attribution_walks(edges(spark), node(["a1", "b1"]), node(["p1", "p2"]), lambda c: ~c.startswith("p"), 1000).collect()
    assert {r.target for r in got} == {"p1", "p2"} and {r.credited for r in got} == {"a1", "b1"}
    n = {(r.target, r.credited): r.n for r in got}
    assert sum(n.values()) == 2000 and n[("p2", "b1")] == 1000 and abs(n[("p1", "a1")] / 1000 - 1 / 1.4) < 0.05


def test_seeds_in_stages(spark):
    asked = spark.createDataFrame([("q1", "About Apex and more"), ("q2", "the apex, the Apexes; apex zenith"), ("q3", "nothing"), ("q4", "nothing"), ("q5", None)], "q string, text string")
    names = spark.createDataFrame([("q1", "apex"), ("q2", "apexes"), ("q9", "apex")], "q string, surface string")
    known = spark.createDataFrame([("apex",), ("zenith",), (None,), ("apex",)], "surface string")
    probes = spark.createDataFrame([("q1", [1.0, 0.0]), ("q3", [1.0, 0.0]), ("q4", [0.0, 1.0])], "q string, vec array<double>")
    stored = spark.createDataFrame([("n1", [0.9, 0.1]), ("n2", [0.5, 0.3]), ("n3", [0.1, 0.2])], "node string, v array<double>")
    got = sorted((r.q, r.mode, r.node or "", r.score) for r in staged_seeds(asked, names, known, probes, stored).collect())
    assert got == [
        ("q1", "names", "apex", 1.0),
        ("q2", "dictionary", "apex", 1.0),
        ("q2", "dictionary", "zenith", 1.0),
        ("q3", "vectors", "n1", 0.9),
        ("q3", "vectors", "n2", 0.5),
        ("q4", "no_seeds", "", 0.0),
        ("q5", "no_seeds", "", 0.0),
    ]
    one = staged_seeds(asked, names, known, probes, stored, literal=1, k=1).collect()
    assert {(r.q, r.node) for r in one if r.node} == {("q1", "apex"), ("q2", "apex"), ("q3", "n1")}
