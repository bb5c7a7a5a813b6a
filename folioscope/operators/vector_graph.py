"""A proximity-graph index of vectors: a navigable small-world graph for each shard, searched by a greedy beam."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vectors
from folioscope.operators import search
from folioscope.operators.graph import shared_path, written
from folioscope.operators.order import top_per_group

#: Bytes of the vectors of one shard, about; a shard is one row of the index, so this bounds the memory of a task.
SHARD_BYTES = 4 << 20
#: Links that a node chooses; with those that choose it, it keeps twice as many, and its links of the spanning tree.
DEGREE = 12
#: Nodes of a shard that a search compares first, to begin at the nearest of them.
ENTRIES = 8
#: Beams that the tuning tries, as multiples of the neighbours wanted; the last one is taken if none reaches the recall.
BEAMS = (1, 1.5, 2, 3, 4, 6, 8, 12, 16, 32)
#: Rows whose exact neighbours set the beam.
TUNING_ROWS = 100
#: Probes walked side by side.
TOGETHER = 256

SHARDS = "shard int, keys array<string>, points binary, links binary, degree int"


@dataclass
class GraphIndex:
    """shards: a row a graph, over distinct vectors; members: (key, id), every row with the key of its vector, columns of one table in the shared folder."""

    shards: DataFrame
    members: DataFrame
    id_col: str
    vector_col: str
    beam: int = 32


def build(table: DataFrame, id_col: str, vector_col: str, k: int = 10, recall: float = 0.95, shard_bytes: int = SHARD_BYTES) -> GraphIndex:
    """An index of all rows, searched by inner product of their unit vectors.

    Vectors are dealt to shards by hash; equal ones are one node, however many rows have them. The beam is the least of
    BEAMS that finds a share recall of the k exact neighbours of TUNING_ROWS rows. Rows without id or vector are left
    out; repeated ids count once for each vector. Vectors must have one width; a vector without length is at 0 from all.
    """
    spark = table.sparkSession
    rows = written(keyed(table, id_col, vector_col).filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()), "graph-rows")
    shards_at = shared_path(spark, "graph-shards")
    points = written(rows.groupBy("key").agg(F.first(vector_col).alias("v")), "graph-points")
    n, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-n * 8 * (width or 1) // shard_bytes))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    # a task a shard, by its number: hashes of a few numbers would meet in one task
    dealt.repartitionById(shards, "shard").mapInPandas(_shard, SHARDS).write.parquet(shards_at)
    index = GraphIndex(spark.read.schema(SHARDS).parquet(shards_at), rows.select("key", id_col), id_col, vector_col)
    if n > 1:
        index.beam = _beam_for(index, points.withColumnRenamed("v", vector_col), k, recall)
    return index


def keyed(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(key, id, vector): unit vectors as doubles, and 128 bits of hash that equal ones share."""
    unit = table.select(id_col, vectors.unit(F.col(vector_col)).cast("array<double>").alias(vector_col))
    halves = [F.lpad(F.hex(F.xxhash64(*seed, vector_col)), 16, "0") for seed in ([], [F.lit(1)])]
    return unit.select(F.concat(*halves).alias("key"), id_col, vector_col)


def nearest(index: GraphIndex, probes: DataFrame, k: int, beam: int | None = None) -> DataFrame:
    """(probe, <id>, score, rank): the k rows of largest cosine that the walks find for each stated probe."""
    return nearest_of(index, walked(index, probes, k, beam), k)


def walked(index: GraphIndex, probes: DataFrame, k: int, beam: int | None = None) -> DataFrame:
    """The walks of all probes, a block of them at a time, written once: what they find and what they cost is read from there."""
    out = None
    for block in search.probe_blocks(probes, index.id_col):
        one = walks(index, block, k, [beam or index.beam])
        out = one if out is None else out.unionByName(one)
    return written(out, "graph-walks")


def nearest_of(index: GraphIndex, done: DataFrame, k: int) -> DataFrame:
    """(probe, <id>, score, rank): the k rows of largest cosine of walks that walked() has written."""
    i = index.id_col
    keys = top_per_group(done.filter("key IS NOT NULL").select("probe", "key", "score"), ["probe"], [F.desc("score"), F.asc("key")], k + 1).drop("rank")
    # rows of one vector are at one distance, so the k + 1 smallest ids of each are enough; they are cut before the shuffle
    wanted = index.members.join(keys.select("key").distinct(), "key", "left_semi").distinct()
    few = top_per_group(wanted, ["key"], [F.asc(i)], k + 1).drop("rank")
    both = keys.join(few, "key").filter(F.col("probe") != F.col(i)).select("probe", i, "score")
    return top_per_group(both, ["probe"], [F.desc("score"), F.asc(i)], k)


def walks(index: GraphIndex, probes: DataFrame, k: int, beams: list[int]) -> DataFrame:
    """(beam, probe, key, score, compared): the k + 1 best distinct vectors of each shard, the probe's own among them.

    compared is the number of vectors of the shard that the probe was compared with; every walk has one row more,
    without key, that alone carries it. The probes are one counted block, sent to all tasks; shards stay where they are.
    """
    unit = probes.select(F.col(index.id_col).alias("probe"), vectors.unit(F.col(index.vector_col)).cast("array<double>").alias("_q"))
    block = unit.filter("_q IS NOT NULL").agg(F.collect_list("probe").alias("probes"), F.collect_list("_q").alias("qs"))
    kind = dict(probes.dtypes)[index.id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                names = np.asarray(row.probes, dtype=object)
                if not len(names):
                    continue
                keys, q = np.asarray(row.keys, dtype=object), np.stack([np.asarray(x, dtype=np.float64) for x in row.qs])
                points = np.frombuffer(row.points, dtype=np.float64).reshape(len(keys), -1)
                links = np.frombuffer(row.links, dtype=np.int32).reshape(len(keys), row.degree)
                for beam in beams:
                    for at in range(0, len(q), TOGETHER):
                        best, scores, compared = walk(points, links, q[at : at + TOGETHER], max(beam, k + 1))
                        best, scores = best[:, : k + 1], scores[:, : k + 1]
                        own = names[at : at + TOGETHER]
                        y, x = np.nonzero(best >= 0)
                        yield pd.DataFrame({"beam": beam, "probe": own[y], "key": keys[best[y, x]], "score": np.round(scores[y, x], 6), "compared": 0})
                        yield pd.DataFrame({"beam": beam, "probe": own, "key": None, "score": 0.0, "compared": compared})

    return index.shards.crossJoin(F.broadcast(block)).mapInPandas(run, f"beam int, probe {kind}, key string, score double, compared long")


def compared_share(index: GraphIndex, probes: DataFrame, k: int) -> DataFrame:
    """One row (compared, of): vectors that the probes' walks were compared with, and those of a full scan."""
    return share_of(index, walked(index, probes, k))


def share_of(index: GraphIndex, done: DataFrame) -> DataFrame:
    """compared_share of walks that walked() has written."""
    n = index.shards.agg(F.sum(F.size("keys")).alias("n"))
    cost = done.filter("key IS NULL").agg(F.sum("compared").alias("compared"), F.countDistinct("probe").alias("probes"))
    return cost.crossJoin(n).select("compared", (F.col("probes") * F.col("n")).alias("of"))


def link(points: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """(n, width) of neighbours, -1 where there is none: the graph of one shard, whose nodes lie in random order.

    A node chooses among its nearest those that no chosen one is nearer to than itself, and is joined both ways. It is
    also joined to the nearest of all nodes before it: these links are a tree, so the first node reaches all, and those
    of early nodes are long. Of links beyond twice the degree the nearest stay, and the tree's.
    """
    n = len(points)
    chosen, parent = np.full((n, degree), -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        near = points[rows] @ points.T
        near[np.arange(len(rows)), rows] = -np.inf
        earlier = np.where(np.arange(n)[None, :] < rows[:, None], near, -np.inf)
        parent[rows] = np.where(rows > 0, earlier.argmax(1), -1)
        m = min(4 * degree, n - 1)
        if m < 1:
            continue
        wide = np.argpartition(-near, m - 1, axis=1)[:, :m]
        wide = np.take_along_axis(wide, np.argsort(-np.take_along_axis(near, wide, 1), axis=1, kind="stable"), 1)
        count = np.zeros(len(rows), dtype=np.int32)
        for c in wide.T:
            own, mine = near[np.arange(len(rows)), c], chosen[rows]
            rival = np.einsum("rd,rmd->rm", points[c], points[mine])
            free = (count < degree) & ~((rival > own[:, None]) & (mine >= 0)).any(1)
            chosen[rows[free], count[free]] = c[free]
            count += free
    a, b = np.repeat(np.arange(n), degree), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    child = np.arange(1, n)
    tree = np.stack([np.r_[child, parent[1:]], np.r_[parent[1:], child]])
    pairs = np.unique(np.c_[np.stack([np.r_[a, b], np.r_[b, a]]), tree].T.astype(np.int64), axis=0)
    on_tree = np.isin(pairs[:, 0] * n + pairs[:, 1], tree[0].astype(np.int64) * n + tree[1])
    order = np.lexsort((-np.einsum("nd,nd->n", points[pairs[:, 0]], points[pairs[:, 1]]), pairs[:, 0]))
    pairs, on_tree = pairs[order], on_tree[order]
    place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    pairs = pairs[(place < 2 * degree) | on_tree]
    place = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    links = np.full((n, int(place.max(initial=0)) + 1), -1, dtype=np.int32)
    links[pairs[:, 0], place] = pairs[:, 1]
    return links


def walk(points: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each probe the nodes found, nearest first (-1: none), their products, and the number of nodes compared.

    All probes take a step at once: the best node of the beam that is not yet open is opened, its unseen neighbours are
    compared, and the beam keeps the best. A probe is done when its whole beam is open.
    """
    n, m = len(points), len(q)
    first = min(ENTRIES, n)
    seen = np.zeros((m, n), dtype=bool)
    seen[:, :first] = True
    nodes, scores = np.full((m, beam), -1, dtype=np.int64), np.full((m, beam), -np.inf)
    opened = np.ones((m, beam), dtype=bool)
    start = q @ points[:first].T
    got = min(first, beam)
    best = np.argsort(-start, axis=1, kind="stable")[:, :got]
    nodes[:, :got], scores[:, :got], opened[:, :got] = best, np.take_along_axis(start, best, 1), False
    compared = np.full(m, first, dtype=np.int64)
    active = np.arange(m)
    while len(active):
        at = opened[active].argmin(1)
        opened[active, at] = True
        around = links[nodes[active, at]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        y, x = np.nonzero(fresh)
        met = np.full(around.shape, -np.inf)
        met[y, x] = np.einsum("nd,nd->n", points[around[y, x]], q[active[y]])
        seen[active[y], around[y, x]] = True
        compared[active] += fresh.sum(1)
        scored = np.c_[scores[active], met]
        keep = np.argsort(-scored, axis=1, kind="stable")[:, :beam]
        scores[active] = np.take_along_axis(scored, keep, 1)
        nodes[active] = np.take_along_axis(np.c_[nodes[active], np.where(fresh, around, -1)], keep, 1)
        opened[active] = np.take_along_axis(np.c_[opened[active], ~fresh], keep, 1)
        active = active[~opened[active].all(1)]
    return nodes, scores, compared


def _shard(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The row of the one shard whose (key, v, shard) these are."""
    held = [part for part in parts if len(part)]
    if not held:
        return
    part = pd.concat(held).sort_values("key")  # digests, so the order is random and the same in each run
    points = np.stack([np.asarray(v, dtype=np.float64) for v in part["v"]])
    links = link(points)
    row = [int(part["shard"].iloc[0]), part["key"].tolist(), points.tobytes(), links.tobytes(), links.shape[1]]
    yield pd.DataFrame([row], columns=["shard", "keys", "points", "links", "degree"])


def _beam_for(index: GraphIndex, one: DataFrame, k: int, recall: float) -> int:
    """The least beam whose walks find a share recall of the distinct vectors that are nearest to some rows."""
    v = index.vector_col
    probes = written(one.orderBy(F.xxhash64("key", F.lit("tuning")), "key").limit(TUNING_ROWS), "graph-tuning")
    exact = written(search.dense(one, probes, "key", v, k).select("probe", "key"), "graph-tuning-exact")
    beams = sorted({max(k + 1, round(b * k)) for b in BEAMS})
    asked = GraphIndex(index.shards, index.members, "key", v)
    found = walks(asked, probes, k, beams).filter("key IS NOT NULL AND key <> probe")
    hits = found.join(exact, ["probe", "key"], "left_semi").groupBy("beam").agg(F.count("*").alias("hits")).collect()
    wanted = recall * exact.count()
    return min((r.beam for r in hits if r.hits >= wanted), default=beams[-1])
