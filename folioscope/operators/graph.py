"""Passage and surface graphs: building, ranking, contraction and walks, as joins and aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A node with more neighbours than this is not expanded through.
DEGREE_CAP = 12


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, a temporary one on a single machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")

        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='folioscope-')}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and executors may be lost."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entity_passage_edges(mentions: DataFrame) -> DataFrame:
    """(surface, passage, weight): the count's share of its passage's total, counts floored at one.

    Mentions may bring the sum of these counts over their passage as a column total; else it is made here.
    """
    n = F.greatest(F.col("n"), F.lit(1))
    if "total" in mentions.columns:
        return mentions.select("surface", "passage", (n / F.col("total")).alias("weight"))
    total = mentions.groupBy("passage").agg(F.sum(n).alias("total"))
    return mentions.join(total, "passage").select("surface", "passage", (n / F.col("total")).alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst, weight)."""
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def pagerank(edges: DataFrame, reset: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(node, score) of personalised PageRank over undirected weighted edges (src, dst, weight).

    x' = (1 - d) r + d (P^T x + dangling r), r being reset (node, mass) scaled to one. Nodes are numbered once. Transition
    shares are dealt out by node once and kept on the executors' disks until the rounds are over, so a round shuffles scores
    only; every fourth is written. Every node with an edge passes its score on, so only reset nodes without one are dangling,
    and their score follows from round to round without a look at the table.
    """
    e = edges.filter("weight > 0 AND src <> dst").select("src", "dst", "weight")
    names = written(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "ppr-names")
    names = written(names.select("node", F.monotonically_increasing_id().alias("id")), "ppr-numbers")
    of = lambda c: names.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")).hint("merge")
    e = written(e.join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight"), "ppr-edges")
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = symmetric(e).repartition(tasks, "src").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))
    p = both.select("src", "dst", share.alias("share")).persist(StorageLevel.DISK_ONLY)
    mass = reset.select("node", F.when(F.col("mass") > 0, F.col("mass")).otherwise(0.0).alias("mass"))
    r = mass.join(mass.agg(F.sum("mass").alias("_all")), F.lit(True)).filter("_all > 0").select("node", (F.col("mass") / F.col("_all")).alias("r"))
    r = written(r.join(names, "node", "left"), "ppr-reset")
    lone, r = r.filter("id IS NULL"), r.filter("id IS NOT NULL").select("id", "r")
    alone = lone.agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
    x, kept, lost = r.withColumnRenamed("r", "score"), 1.0, alone
    for k in range(rounds):
        moved = x.hint("shuffle_hash").join(p, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (damping * F.col("score") * F.col("share")).alias("s"))
        kept = 1 - damping + damping * lost
        x = moved.unionByName(r.select("id", (F.lit(kept) * F.col("r")).alias("s"))).groupBy("id").agg(F.sum("s").alias("score"))
        lost = kept * alone
        if k % 4 == 3 or k == rounds - 1:
            x = written(x, "ppr")
    p.unpersist()
    return x.join(names, "id").select("node", "score").unionByName(lone.select("node", (F.lit(kept) * F.col("r")).alias("score")))


def quotient(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges with clustered nodes (node, cluster) contracted: loops go, parallel weights add up."""
    a, b = cluster.select(F.col("node").alias("src"), F.col("cluster").alias("_a")).hint("merge"), cluster.select(F.col("node").alias("dst"), F.col("cluster").alias("_b")).hint("merge")
    e = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_a", "src").alias("x"), F.coalesce("_b", "dst").alias("y"), "weight")
    e = e.filter("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "weight")
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def quotient_pagerank(edges: DataFrame, cluster: DataFrame, reset: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(node, score) of PageRank on the quotient by clusters (node, cluster).

    The reset (node, mass), negative masses as none, is summed for each super-node; each node of the edges
    has the score of its super-node, so scores of the members of a cluster don't add up to one.
    """
    c = cluster.select("node", "cluster")
    mass = F.when(F.col("mass") > 0, F.col("mass")).otherwise(0.0)
    r = reset.join(c, "node", "left").groupBy(F.coalesce("cluster", "node").alias("node")).agg(F.sum(mass).alias("mass"))
    x = pagerank(written(quotient(edges, c), "quotient"), r, damping, rounds).withColumnRenamed("node", "_super")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(c, "node", "left").withColumn("_super", F.coalesce("cluster", "node")).join(x, "_super").select("node", "score")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component of (src, dst), by star contraction.

    Large stars and small stars alternate on written tables until all is stars; the number of rounds
    grows with the logarithm of the longest path. Joins are by shuffle, so that nothing goes through the driver.
    """
    now = written(edges.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("up")).filter("node <> up").distinct(), "components")
    while True:
        both = now.unionByName(now.select(F.col("up").alias("node"), F.col("node").alias("up")))
        low = both.groupBy("node").agg(F.least(F.min("up"), F.col("node")).alias("m"))
        large = both.join(low.hint("merge"), "node").filter("up > node AND up <> m").select(F.col("up").alias("node"), F.col("m").alias("up")).distinct()
        least = large.groupBy("node").agg(F.min("up").alias("m"))
        small = large.join(least.hint("merge"), "node").filter("up <> m").select(F.col("up").alias("node"), F.col("m").alias("up"))
        after = written(small.unionByName(least.withColumnRenamed("m", "up")).distinct(), "components")
        # A node with two above it, or one that is itself above another.
        ends = after.select("node", F.lit(1).alias("_own")).unionByName(after.select(F.col("up").alias("node"), F.lit(0).alias("_own")))
        open_ = ends.groupBy("node").agg(F.sum("_own").alias("_own"), F.min("_own").alias("_least")).filter("_own > 1 OR _own = 1 AND _least = 0").limit(1).count()
        now = after
        if not open_:
            roots = now.select(F.col("up").alias("node"), F.col("up").alias("component")).distinct()
            return now.withColumnRenamed("up", "component").unionByName(roots)


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop, weight) within some hops of seeds (node): the shortest hop and its largest edge weight."""
    if not 1 <= hops <= 3:
        raise ValueError("1 to 3 hops")
    both = symmetric(edges)
    seen = seeds.select("node", F.lit(0).alias("hop"), F.lit(None).cast("double").alias("weight")).distinct()
    front = seen
    for h in range(1, hops + 1):
        reached = front.select(F.col("node").alias("src")).join(both, "src").groupBy("dst").agg(F.max("weight").alias("weight"))
        front = reached.select(F.col("dst").alias("node"), F.lit(h).alias("hop"), "weight").join(seen.select("node"), "node", "left_anti")
        front = written(front.select("node", "hop", "weight"), "hop")
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    n = nodes.select("node").distinct()
    a = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
    return a.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def cooccurrence(rows: DataFrame, place: str, surface: str, cap: int = DEGREE_CAP) -> DataFrame:
    """(surface_a, surface_b, n): pairs that share a place with 2 to cap distinct surfaces.

    The cap bounds a place's pairs, and is the operator's own definition: places above it are counted
    by skipped_places().
    """
    listed = rows.groupBy(place).agg(F.array_sort(F.collect_set(surface)).alias("s")).filter(F.size("s").between(2, cap))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("surface_a"), y.alias("surface_b")))))
    return listed.select(F.explode(pairs).alias("p")).groupBy("p.surface_a", "p.surface_b").agg(F.count("*").alias("n"))


def skipped_places(rows: DataFrame, place: str, surface: str, cap: int = DEGREE_CAP) -> DataFrame:
    return rows.groupBy(place).agg(F.count_distinct(surface).alias("n")).filter(F.col("n") > cap).agg(F.count("*").alias("skipped"))


def collapse(edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves edges (surface, passage, weight) to canonical nodes (node, canonical) and adds up duplicates.

    Returns the edges and the hidden nodes with their provenance.
    """
    c = canonical.select(F.col("node").alias("surface"), "canonical")
    moved = edges.join(c, "surface", "left").select(F.coalesce("canonical", "surface").alias("surface"), "passage", "weight")
    out = moved.groupBy("surface", "passage").agg(F.sum("weight").alias("weight"))
    hidden = canonical.filter("node <> canonical").groupBy("canonical").agg(F.array_sort(F.collect_set("node")).alias("members"))
    return out, hidden


def visible(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (node, hidden) that aren't hidden, and the edges (src, dst, weight) among them."""
    seen = vertices.filter(~F.coalesce("hidden", F.lit(False)))
    gone = vertices.filter(F.coalesce("hidden", F.lit(False))).select("node")
    kept = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return seen, kept.select("src", "dst", "weight")


def chase(pairs: DataFrame, rounds: int = 16) -> DataFrame:
    """(node, root): follows other -> canonical until nothing changes; a cycle ends at its least node."""
    now = written(pairs.select("node", F.col("canonical").alias("root")), "chase")
    for _ in range(rounds):
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        step = now.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("root").alias("_old"))
        step = written(step, "chase")
        if not step.filter("root <> _old").limit(1).count():
            break
        now = step.select("node", "root")
    else:
        now = step.select("node", F.least("node", "root").alias("root"))
    return now.select("node", "root")


def cluster_scores(scores: DataFrame, cluster: DataFrame, how: str = "sum") -> DataFrame:
    """(cluster, score) rolled up by sum, max or sum over the root of the size; single nodes pass through."""
    size = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    rows = scores.join(cluster, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    out = rows.groupBy("cluster").agg(F.sum("score").alias("total"), F.max("score").alias("top"))
    if how == "max":
        return out.select("cluster", F.col("top").alias("score"))
    if how == "sum":
        return out.select("cluster", F.col("total").alias("score"))
    joined = out.join(size, "cluster", "left")
    return joined.select("cluster", (F.col("total") / F.sqrt(F.coalesce("size", F.lit(1)))).alias("score"))


def seed_spread(seeds: DataFrame, cluster: DataFrame, cap: int = 50) -> DataFrame:
    """Seeds (node, sim) and, at sim / sqrt(size), up to cap other members of their clusters, in order of name."""
    size = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    # All seeds of a cluster spread to the same members, its first ones that are no seeds, so the best seed decides.
    best = seeds.join(cluster, "node").groupBy("cluster").agg(F.max("sim").alias("sim"))
    best = best.join(size, "cluster").select("cluster", (F.col("sim") / F.sqrt("size")).alias("sim"))
    w = Window.partitionBy("cluster").orderBy("node")
    members = cluster.join(seeds.select("node"), "node", "left_anti").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    others = members.join(best, "cluster").groupBy("node").agg(F.max("sim").alias("sim"))
    return seeds.select("node", "sim").unionByName(others.select("node", "sim"))


def symmetric_difference(a: DataFrame, b: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows of one side only, with the side."""
    c = list(columns)
    left = a.select(*c).exceptAll(b.select(*c)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*c).exceptAll(a.select(*c)).withColumn("side", F.lit("right")))
