"""Which node leads to a passage: random walks as rows, one join a step, with draws that are hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graph import symmetric, written
from folioscope.operators.search import small

#: Slots that the edges of one node are dealt to at most, and edges of a slot, about.
SLOTS, EDGES = 65_536, 64
#: A node of more edges than this has them added up in blocks.
HUB = 4_096


def draw(*parts: Column) -> Column:
    """A number from 0 to below 1 that depends on the parts alone, so a task that runs again draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def slots(degree: Column) -> Column:
    return F.least(F.floor(degree / EDGES) + 1, F.lit(SLOTS))


def walk_slots(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, slot, lo, hi, dst): each edge's part of its node's unit interval, at every slot it reaches into; and (node, degree).

    A node has a slot for every EDGES edges, up to SLOTS, so a draw meets that many rows however many edges a hub has.
    Parts lie in order of the other node's digest; the edges of a node of more than HUB are added up in 256 blocks, then the blocks.
    """
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = symmetric(edges).filter("weight > 0 AND src <> dst")
    hubs = written(both.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("src", F.lit(True).alias("_hub")), "walk-hubs")
    both = both.withColumn("_digest", F.substring(F.md5(F.col("dst").cast("string")), 1, 2)).join(small(hubs), "src", "left")
    both = both.withColumn("_block", F.when(F.col("_hub"), F.col("_digest")).otherwise(""))
    both = both.repartition(tasks, "src", "_block").groupBy("src", "_block", "_digest", "dst").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy("src", "_block").orderBy("_digest", "dst")
    upto = lambda last: F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, last))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = both.select("src", "_block", "dst", F.coalesce(upto(-1), F.lit(0.0)).alias("_first"), upto(0).alias("_run"), F.sum("weight").over(full).alias("_sum"), F.count("*").over(full).alias("_n"))
    run = written(run, "walk-edges")
    whole, parts = run.filter("_block = ''"), run.filter("_block <> ''")
    blocks = parts.groupBy("src", "_block").agg(F.max("_sum").alias("_part"), F.count("*").alias("_n"))
    all_of, before = Window.partitionBy("src"), Window.partitionBy("src").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ordered = Window.partitionBy("src").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("src", "_block", F.coalesce(F.sum("_part").over(before), F.lit(0.0)).alias("_off"), F.sum("_part").over(ordered).alias("_total"), F.sum("_n").over(all_of).alias("degree"))
    at = lambda c: ((F.col("_off") + F.col(c)) / F.col("_total"))
    parts = parts.drop("_n").join(blocks, ["src", "_block"]).select("src", "dst", "degree", at("_first").alias("lo"), at("_run").alias("hi"))
    whole = whole.select("src", "dst", F.col("_n").alias("degree"), (F.col("_first") / F.col("_sum")).alias("lo"), (F.col("_run") / F.col("_sum")).alias("hi"))
    n = slots(F.col("degree"))
    reach = F.sequence(F.least(F.floor(F.col("lo") * n), n - 1), F.least(F.floor(F.col("hi") * n), n - 1))
    degree = written(run.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "walk-degrees")
    return whole.unionByName(parts).select("src", F.explode(reach).alias("slot"), "lo", "hi", "dst"), degree


def attribution_walks(edges: DataFrame, seeds: DataFrame, targets: DataFrame, is_entity: Callable[[Column], Column], walks: int = 200, steps: int = 6) -> DataFrame:
    """(target, credited, n): of weighted walks from each seed, how many met a target (node) first, by the entity that they came from.

    A walk looks where it stands `steps` times and ends at a target; the entity it stood at last is credited, or the
    target where there was none. Seeds without edges walk nowhere. The slots are dealt out once and kept on the executors' disks
    until the walks are over; a step shuffles walks only, by node for the degree and then by slot, so walks that stand at one hub
    are spread over tasks. Null nodes, repeated seeds and targets count as nothing or once.
    """
    table, degree = walk_slots(edges)
    goals = written(targets.select(F.col("node").alias("dst"), F.lit(True).alias("met")).filter("dst IS NOT NULL").distinct(), "walk-goals")
    table = table.join(small(goals), "dst", "left").select("src", "slot", "lo", "hi", "dst", F.coalesce("met", F.lit(False)).alias("met"))
    table = table.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "slot").persist(StorageLevel.DISK_ONLY)

    start = seeds.select(F.col("node").alias("dst")).filter("dst IS NOT NULL").distinct().join(small(goals), "dst", "left")
    now = start.select(F.col("dst").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.col("dst").alias("at"), F.coalesce("met", F.lit(False)).alias("hit"))
    now = now.withColumn("entity", F.lit(None).cast(edges.schema["src"].dataType))
    for k in range(1, steps):
        # A walk that has ended meets no slot; the number below zero deals such walks out.
        ended = -1 - F.pmod(F.xxhash64("seed", "walk"), F.lit(1_000_000))
        u = draw(F.col("seed"), F.col("walk"), F.lit(k))
        n = slots(F.coalesce("degree", F.lit(0)))
        drawn = now.join(degree.withColumnRenamed("node", "at").hint("merge"), "at", "left").withColumn("u", u)
        drawn = drawn.withColumn("slot", F.when(F.col("hit"), ended).otherwise(F.floor(F.col("u") * n)))
        a, b = drawn.alias("a"), table.alias("b")
        moved = a.join(b, F.expr("a.at = b.src AND a.slot = b.slot AND a.u >= b.lo AND a.u < b.hi"), "left")
        went = F.col("b.dst").isNotNull()
        now = moved.select(
            "a.seed",
            "a.walk",
            F.coalesce("b.dst", "a.at").alias("at"),
            F.coalesce("b.met", "a.hit").alias("hit"),
            F.when(went & is_entity(F.col("a.at")), F.col("a.at")).otherwise(F.col("a.entity")).alias("entity"),
        )
        if k % 3 == 0:
            now = written(now, "walks")
    found = written(now.filter("hit").groupBy(F.col("at").alias("target"), F.coalesce("entity", "at").alias("credited")).agg(F.count("*").alias("n")), "walks-credited")
    table.unpersist()
    return found
