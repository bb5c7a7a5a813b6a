"""Admission of alias edges: neighbours that choose each other, share rare words and never stand in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.graph import shared_path, written
from folioscope.operators.order import gradient_cut, top_per_group

#: Names the gates that an edge has passed, for audits.
RULE = "mutual-overlap-places-1"

Search = Callable[[DataFrame], DataFrame]


def mutual_neighbours(find: Search, entities: DataFrame, probes: DataFrame, id_col: str, floor: float, drop: float) -> DataFrame:
    """(src, dst, score): neighbours of the probes that have the probe among their own.

    find gives (probe, <id>, score, rank) of entity rows, by an exact scan or an index; each list ends at the floor and at
    the first relative drop. Only entities that were found are searched from in turn.
    """
    spark = entities.sparkSession
    path = shared_path(spark, "alias-neighbours")
    gradient_cut(find(probes), "probe", "score", floor, drop).select("probe", id_col, "score").write.parquet(path)
    first = spark.read.parquet(path)
    back = gradient_cut(find(entities.join(first.select(id_col).distinct(), id_col, "left_semi")), "probe", "score", floor, drop)
    back = back.select(F.col(id_col).alias("src"), F.col("probe").alias("dst"))
    return first.toDF("src", "dst", "score").join(back, ["src", "dst"])


def word_overlap(pairs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with overlap: the weighted Jaccard of the words of their surfaces (node, surface).

    A word in df of n surfaces weighs ln((n + 1) / (df + 0.5)), so also a word of all surfaces counts a little.
    Without words on one side the overlap is 0.
    """
    s = surfaces.select("node", X.surface_tokens(F.coalesce("surface", F.lit(""))).alias("_t"))
    n = s.agg(F.count("*").alias("_n"))
    df = s.select(F.explode("_t").alias("_w")).groupBy("_w").agg(F.count("*").alias("_df"))
    a, b = s.select(F.col("node").alias("src"), F.col("_t").alias("_a")), s.select(F.col("node").alias("dst"), F.col("_t").alias("_b"))
    both = pairs.select("src", "dst").join(a, "src").join(b, "dst").filter((F.size("_a") > 0) & (F.size("_b") > 0))
    words = both.select("src", "dst", F.explode(F.array_union("_a", "_b")).alias("_w"), "_a", "_b")
    words = words.select("src", "dst", "_w", (F.array_contains("_a", F.col("_w")) & F.array_contains("_b", F.col("_w"))).alias("_both"))
    weight = F.log((F.col("_n") + 1.0) / (F.col("_df") + 0.5))
    summed = words.join(df, "_w").crossJoin(F.broadcast(n)).groupBy("src", "dst").agg((F.sum(F.when(F.col("_both"), weight).otherwise(0.0)) / F.sum(weight)).alias("_o"))
    return pairs.join(summed, ["src", "dst"], "left").withColumn("overlap", F.round(F.coalesce("_o", F.lit(0.0)), 6)).drop("_o")


def apart(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs whose two nodes share no place (place, node): what stands side by side is two things."""
    p = places.select("place", "node").distinct()
    of = pairs.select("src", "dst").join(p.withColumnRenamed("node", "src"), "src")
    met = of.join(p.withColumnRenamed("node", "dst"), ["place", "dst"], "left_semi").select("src", "dst").distinct()
    return pairs.join(met, ["src", "dst"], "left_anti")


def admitted(pairs: DataFrame, surfaces: DataFrame, places: DataFrame, least: float = 0.3, most: int = 5) -> DataFrame:
    """(src, dst, weight, overlap, features_json): alias edges of mutual neighbours (src, dst, score) that pass all gates.

    Surfaces that are lists of several names are no aliases; words overlap by least or more; the two share no place;
    each src keeps its most similar ones.
    """
    single = surfaces.filter(~F.coalesce(X.is_composite(F.col("surface")), F.lit(False))).select("node")
    p = pairs.join(single.withColumnRenamed("node", "src"), "src", "left_semi").join(single.withColumnRenamed("node", "dst"), "dst", "left_semi")
    p = apart(word_overlap(p, surfaces).filter(F.col("overlap") >= least), places)
    best = top_per_group(p, ["src"], [F.desc("score"), F.asc("dst")], most)
    features = F.to_json(F.struct(F.col("score").alias("cos_sim"), F.col("overlap").alias("idf_overlap"), F.lit(RULE).alias("admission_rule_version"), F.lit("gates").alias("accepted_by")))
    return best.select("src", "dst", F.col("score").alias("weight"), "overlap", features.alias("features_json"))


def best_edits(counted: DataFrame, most: int) -> DataFrame:
    """(src, dst): for each of the surfaces (node, n), none empty, the `most` of largest n that are one inserted, deleted or replaced code point away.

    Surfaces meet where they are equal with one code point taken out, or are what is left of another. Of those that are equal with the code
    point of one place taken out only the first most + 1 can be among the best of any, so that a group costs its size, not its pairs.
    """
    s = counted.select("node", "n").filter(F.char_length("node") > 0)
    at = F.explode(F.sequence(F.lit(1), F.char_length("node"))).alias("i")
    cut = F.concat(F.substring("node", F.lit(1), F.col("i") - 1), F.substring("node", F.col("i") + 1, F.char_length("node")))
    rows = s.select("node", "n", at).select(cut.alias("cut"), "i", "node", "n").unionByName(s.select(F.col("node").alias("cut"), F.lit(0).alias("i"), "node", "n"))
    place = Window.partitionBy("cut", "i").orderBy(F.desc("n"), F.asc("node")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.array(*[F.nth_value(F.struct("node", "n"), k).over(place) for k in range(1, most + 2)])
    rows = rows.select("*", first.alias("first"), F.max(F.when(F.col("i") == 0, F.col("n"))).over(Window.partitionBy("cut")).alias("whole"))
    pair = lambda src, dst, n: F.struct(src.alias("src"), dst.alias("dst"), n.alias("n"))
    replaced = F.transform(F.filter("first", lambda x: x.isNotNull() & (x["node"] != F.col("node"))), lambda x: pair(F.col("node"), x["node"], x["n"]))
    shorter = F.when(F.col("whole").isNotNull(), F.array(pair(F.col("node"), F.col("cut"), F.col("whole")), pair(F.col("cut"), F.col("node"), F.col("n")))).otherwise(F.array())
    pairs = rows.filter("i > 0").select(F.explode(F.concat(replaced, shorter)).alias("p")).select("p.*")
    # By src, so that neither taking out repeats nor the order needs a shuffle of its own.
    pairs = pairs.repartition("src").groupBy("src", "dst").agg(F.first("n").alias("n"))
    return top_per_group(pairs, ["src"], [F.desc("n"), F.asc("dst")], most).select("src", "dst")


def spelling_aliases(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(src, dst), both ways: surfaces one edit apart that are among each other's `most` most frequent ones and share no passage.

    mentions is (passage, surface, n).
    """
    count = written(mentions.groupBy(F.col("surface").alias("node")).agg(F.sum("n").alias("n")), "alias-counts")
    best = written(best_edits(count, most), "alias-best")
    # Each pair once, from the rarer surface, whose passages are looked for the other.
    mutual = best.filter("src < dst").join(best.select(F.col("dst").alias("src"), F.col("src").alias("dst")).hint("merge"), ["src", "dst"], "left_semi")
    a, b = (count.select(F.col("node").alias(c), F.col("n").alias(f"_{c}")).hint("merge") for c in ("src", "dst"))
    mutual = mutual.join(a, "src").join(b, "dst")
    rarer = F.col("_src") <= F.col("_dst")
    mutual = written(mutual.select(F.when(rarer, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(rarer, F.col("dst")).otherwise(F.col("src")).alias("dst")), "alias-mutual")
    found = written(apart(mutual, mentions.select(F.col("passage").alias("place"), F.col("surface").alias("node"))).select("src", "dst"), "alias-apart")
    return found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
