"""Alias clusters: labels that are stored and merged batch by batch, canonical names, and Leiden communities.

A cluster of the store is a component of all edges seen so far; its label is its least node. A batch of edges is first
read as edges between labels, so only what it joins is searched for components, and the labels of what has moved are
exchanged in one pass. Each batch makes a new version that becomes valid with its row in the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.graph import components, written
from folioscope.operators.order import top_per_group
from folioscope.operators.search import small

LOG = "number int, batch string, folder string"


class ClusterStore:
    """Labels (node, cluster) at a path of a shared file system. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, node_type: str = "string"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"node {node_type}, cluster {node_type}"

    def log(self) -> list:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted(self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect(), key=lambda r: r["number"])

    def labels(self) -> DataFrame:
        """(node, cluster) of every node that has an edge; others are in no cluster."""
        log = self.log()
        # Without a log an empty range: an empty local table would start Python workers.
        none = self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in self.schema.split(", "))])
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/labels/{log[-1]['folder']}") if log else none

    def merge(self, edges: DataFrame, batch: str) -> bool:
        """Merges edges (src, dst) into the labels; False if a batch of that name is in already."""
        log = self.log()
        if any(r["batch"] == batch for r in log):
            return False
        now = self.labels()
        e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        e = written(e.distinct(), "cluster-batch")
        # Merge joins: labels that are small enough for a broadcast would all go through the driver, version by version.
        of = lambda c: now.select(F.col("node").alias(c), F.col("cluster").alias(f"_{c}")).hint("merge")
        joined = e.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
        between = joined.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
        moved = written(components(between.filter("src <> dst")), "cluster-moves").select(F.col("node").alias("_old"), F.col("component").alias("_new"))
        new = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(now.hint("merge"), "node", "left_anti")
        all_ = now.unionByName(new.select("node", F.col("node").alias("cluster")))
        after = all_.join(small(moved), F.col("cluster") == F.col("_old"), "left").select("node", F.coalesce("_new", "cluster").alias("cluster"))
        folder = f"{len(log)}-{uuid.uuid4().hex[:12]}"
        after.write.parquet(f"{self.path}/labels/{folder}")
        self.spark.createDataFrame([(len(log), batch, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True


def canonical(labels: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(node, canonical): the member of each cluster of the best surface, in ties the more frequent, then the least node.

    surfaces is (node, surface, n); clusters without any surface keep their label.
    """
    s = labels.join(surfaces, "node").select("cluster", F.struct((-X.surface_quality(F.col("surface"))).alias("q"), (-F.col("n")).alias("n"), "node").alias("s"))
    best = s.groupBy("cluster").agg(F.min("s").alias("s"))
    return labels.join(best, "cluster", "left").select("node", F.coalesce("s.node", "cluster").alias("canonical"))


def _moves(nodes: DataFrame, edges: DataFrame, gamma: float, among: DataFrame | None = None) -> DataFrame:
    """Moves (node, size, comm, to, gain) that raise the quality, of which no two touch one community.

    A node weighs staying, joining a community of a neighbour, and standing alone. With `among` (node, bound) only nodes
    that stand alone move, only over edges inside one bound, and never back to stand alone.
    """
    e = edges
    if among is not None:
        a, b = among.select(F.col("node").alias("src"), F.col("bound").alias("_a")), among.select(F.col("node").alias("dst"), F.col("bound").alias("_b"))
        e = edges.join(a, "src").join(b, "dst").filter(F.col("_a") == F.col("_b")).select("src", "dst", "weight")
    sizes = nodes.groupBy("comm").agg(F.sum("size").alias("total"), F.count("*").alias("members"))
    links = e.join(nodes.select(F.col("node").alias("dst"), F.col("comm").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
    own = nodes.join(sizes, "comm").join(links.select("node", F.col("to").alias("comm"), F.col("w").alias("own")), ["node", "comm"], "left")
    stay = F.coalesce("own", F.lit(0.0)) - gamma * F.col("size") * (F.col("total") - F.col("size"))
    own = own.select("node", "size", "comm", "members", stay.alias("stay"))
    if among is not None:
        own = own.filter("members = 1")
    to = sizes.select(F.col("comm").alias("to"), F.col("total").alias("_t"))
    join = own.join(links, "node").filter(F.col("to") != F.col("comm")).join(to, "to")
    join = join.select("node", "size", "comm", "to", (F.col("w") - gamma * F.col("size") * F.col("_t") - F.col("stay")).alias("gain"))
    if among is None:
        alone = own.filter("members > 1").select("node", "size", "comm", F.concat(F.lit("alone:"), F.uuid()).alias("to"), (-F.col("stay")).alias("gain"))
        join = join.unionByName(alone)
    # In ties the order of the hashes decides, so that chains of equal gains don't move one by one.
    draw = F.xxhash64("node", "to")
    best = top_per_group(join.filter("gain > 1e-9").withColumn("draw", draw), ["node"], [F.desc("gain"), F.asc("draw")], 1).drop("rank")
    best = written(best, "leiden-best")
    touched = best.select("node", "gain", "draw", F.explode(F.array("comm", "to")).alias("c"))
    first = touched.groupBy("c").agg(F.max(F.struct("gain", "draw", "node")).alias("m")).select("c", F.col("m.node").alias("winner"))
    won = touched.join(first, "c").filter("node = winner").groupBy("node").agg(F.count("*").alias("k")).filter("k = 2")
    return best.join(won.select("node"), "node").select("node", "size", "comm", "to", "gain")


def _rounds(nodes: DataFrame, edges: DataFrame, gamma: float, among: DataFrame | None, most: int) -> tuple[DataFrame, int]:
    """nodes after rounds of moves, and how many moves there were."""
    moved_all = 0
    for _ in range(most):
        moves = written(_moves(nodes, edges, gamma, among), "leiden-moves")
        n = moves.count()
        if not n:
            break
        moved_all += n
        nodes = written(nodes.join(small(moves.select("node", "to")), "node", "left").select("node", "size", F.coalesce("to", "comm").alias("comm")), "leiden-nodes")
    return nodes, moved_all


def quality(labels: DataFrame, edges: DataFrame, gamma: float) -> float:
    """The constant Potts quality of (node, comm): weights inside communities less gamma for each pair of their nodes."""
    a, b = labels.select(F.col("node").alias("src"), F.col("comm").alias("_a")), labels.select(F.col("node").alias("dst"), F.col("comm").alias("_b"))
    inside = edges.join(a, "src").join(b, "dst").filter("_a = _b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    pairs = labels.groupBy("comm").count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0))).first()[0]
    return inside - gamma * pairs


def leiden(edges: DataFrame, gamma: float = 0.05, levels: int = 8, rounds: int = 40) -> DataFrame:
    """(node, community): communities by the constant Potts model, each connected, labelled by its least node.

    edges are (src, dst, weight), each pair once; repeated pairs add up, loops are left out. A level moves nodes locally, refines
    each community from single nodes, and contracts the refined ones. Moves of one round touch each community once at most,
    so their gains add up and the quality never falls; the bounds of levels and rounds only end the search early.
    """
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").cast("string").alias("src"), F.greatest("src", "dst").cast("string").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = written(e.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "leiden-edges")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    nodes = both.select(F.col("src").alias("node")).distinct().select("node", F.lit(1).cast("long").alias("size"), F.col("node").alias("comm"))
    nodes = written(nodes, "leiden-nodes")
    member = nodes.select("node", F.col("node").alias("super"))
    for _ in range(levels):
        nodes, moved = _rounds(nodes, both, gamma, None, rounds)
        bound = nodes.select("node", F.col("comm").alias("bound"))
        single = nodes.select("node", "size", F.col("node").alias("comm"))
        refined, joined = _rounds(single, both, gamma, bound, rounds)
        if not moved or not joined:
            break
        # Refined communities become nodes, which begin in the communities of their members.
        up = refined.join(bound, "node").select("node", F.col("comm").alias("_up"), "size", "bound")
        nodes_up = written(up.groupBy(F.col("_up").alias("node")).agg(F.sum("size").alias("size"), F.first("bound").alias("comm")), "leiden-nodes")
        a, b = up.select(F.col("node").alias("src"), F.col("_up").alias("_a")), up.select(F.col("node").alias("dst"), F.col("_up").alias("_b"))
        both = both.join(a, "src").join(b, "dst").filter("_a <> _b").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight"))
        both = written(both, "leiden-edges")
        member = written(member.join(up.select(F.col("node").alias("super"), "_up"), "super").select("node", F.col("_up").alias("super")), "leiden-members")
        nodes = nodes_up
    found = written(member.join(nodes.select(F.col("node").alias("super"), "comm"), "super").select("node", "comm"), "leiden-found")
    # What a community holds without a path inside it is two: apart they are worth more.
    a, b = found.select(F.col("node").alias("src"), F.col("comm").alias("_a")), found.select(F.col("node").alias("dst"), F.col("comm").alias("_b"))
    parts = components(e.join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst"))
    return found.join(parts.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("community"))
