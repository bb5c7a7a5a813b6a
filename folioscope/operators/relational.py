"""Relational operators with plans that hold at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16, hot_share: float = 0.01) -> DataFrame:
    """An equi-join whose hot keys are dealt over salts.

    A key with more than hot_share of the left rows is hot; there can be 1 / hot_share of them at most, so
    their list is broadcast. Left rows of hot keys get a salt by the hash of the row, so that a stage run again
    deals them alike; right rows of hot keys get a copy for each salt. Right rows without a partner, which a right or
    full join keeps, are found apart by key, once each.
    """
    kind = how.replace("_", "").removesuffix("outer").removesuffix("join") or "full"
    if kind not in ("inner", "left", "right", "full"):
        raise ValueError(f"join kind {how}")
    keeps_right = kind in ("right", "full")
    n = left.count()
    hot = left.groupBy(key).count().filter(F.col("count") > max(1, int(n * hot_share))).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    a = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    out = a.join(b, [key, "_salt"], "left" if kind in ("left", "full") else "inner").drop("_salt")
    if not keeps_right:
        return out
    alone = right.join(left.select(key).distinct(), key, "left_anti")
    return out.unionByName(alone, allowMissingColumns=True).select(*out.columns)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """left with the values of the right row of its key with the greatest `at` not after its own.

    One union and one window: no row is compared with more than its predecessor.
    """
    names = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).cast(right.select(F.struct(at, *values)).schema[0].dataType).alias("_right"))
    b = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(at, *values).alias("_right"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(key, at, *[F.col("_left")[c].alias(c) for c in names], F.col("_right")[at].alias(f"{at}_matched"), *[F.col("_right")[v].alias(v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, step: int) -> DataFrame:
    """Points in spans of their key: spans are dealt to the steps they touch, so the join is an equi-join."""
    p = points.withColumn("_bin", F.floor(F.col(at) / step))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.col(end) / step))))
    return p.join(s, [key, "_bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bin")
