"""Order-dependent operators that don't send a whole group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one block; blocks of a group are ordered in parallel and joined at their ends.
BLOCK = 10_000


def neighbours(df: DataFrame, group: str, order: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """df with next_<value> of the row that follows in its group.

    Rows are ordered within blocks of the order column's range; each block's last row takes the first
    row of the next block that has rows, found on one row a block. A group of any size is spread over
    many tasks. Ties of the order column within a group are not expected.
    """
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    own = Window.partitionBy(group, "_block").orderBy(order)
    row = F.struct(order, *values)
    b = b.withColumn("_next", F.lead(row).over(own))
    heads = b.groupBy(group, "_block").agg(F.min(row).alias("_head"))
    after = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(group).orderBy("_block"))).select(group, "_block", "_after")
    out = b.join(after, [group, "_block"], "left").withColumn("_next", F.coalesce("_next", "_after"))
    return out.select(*df.columns, *[F.col("_next")[v].alias(f"next_{v}") for v in values])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank. Rows past k go early, before the shuffle's last stage."""
    top = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows overall with their rank: a distributed top-k, then a window over its k rows."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def value_at_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row (cutoff): the value at index floor(q * n) of the sorted values.

    Counts by value are summed instead of sorting the rows: the window runs over distinct values.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    w = Window.orderBy(value)
    run = counts.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    return run.filter(F.col("_to") > F.floor(F.lit(q) * F.col("_all"))).agg(F.min(value).alias("cutoff"))


def gradient_cut(ranked_rows: DataFrame, group: str, score: str, floor: float, drop: float) -> DataFrame:
    """The front of each ranked list up to the first relative drop over the limit, or a score of zero or less."""
    w = Window.partitionBy(group).orderBy("rank")
    prev = F.lag(score).over(w)
    steep = F.coalesce((F.col(score) <= 0) | ((prev - F.col(score)) / prev > drop), F.lit(False)).cast("int")
    kept = ranked_rows.filter(F.col(score) >= floor).withColumn("_cut", steep)
    kept = kept.withColumn("_cut", F.max("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.filter("_cut = 0").drop("_cut")


def novelty_guard(seen: DataFrame, group: str, order: str, window: int = 3, least: int = 1) -> DataFrame:
    """stuck: of each step, whether the last `window` counts of new things are all at most `least`."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(1 - window, 0)
    return seen.withColumn("stuck", (F.max("n_new").over(w) <= least) & (F.count("*").over(w) == window))
