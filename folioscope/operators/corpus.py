"""The corpus as snapshots: append, removal, orphan sweep and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.order import neighbours


def occurrences(pages: DataFrame) -> DataFrame:
    """Distinct (file_id, page, passage), repeats of content across pages kept."""
    return pages.select("file_id", "page", "passage").distinct()


def append_new(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch that the store lacks, one for each key; smaller rows win."""
    first = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("_r")).select(key, "_r.*")
    return first.select(*batch.columns).join(store.select(key).distinct(), key, "left_anti")


def remove_file(occ: DataFrame, file_id: str) -> dict[str, DataFrame]:
    """What stays and what goes when a file goes: a passage stays while another file holds it."""
    gone = occ.filter(F.col("file_id") == file_id)
    kept = occ.filter(F.col("file_id") != file_id)
    lost = gone.select("passage").distinct().join(kept.select("passage").distinct(), "passage", "left_anti")
    return {"occurrences": kept, "removed_passages": lost}


def orphan_surfaces(mentions: DataFrame, removed: DataFrame) -> DataFrame:
    """Surfaces that no passage holds any more."""
    kept = mentions.join(removed, "passage", "left_anti").select("surface").distinct()
    return mentions.select("surface").distinct().join(kept, "surface", "left_anti")


def adjacent_passages(occ: DataFrame) -> DataFrame:
    """(passage_a, passage_b, weight): passages of following pages of a file, no self loops, once each."""
    n = neighbours(occ, "file_id", "page", ["passage"]).filter("next_passage IS NOT NULL AND passage <> next_passage")
    pair = n.select(F.least("passage", "next_passage").alias("passage_a"), F.greatest("passage", "next_passage").alias("passage_b"))
    return pair.distinct().withColumn("weight", F.lit(1.0))


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one snapshot only, with the side that has them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def unique_surfaces(found: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """(id, surfaces): normalised surfaces of each id's list, first occurrences in order; null and empty lists give empty ones.

    Distinct surfaces are normalised once each, not once an occurrence.
    """
    rows = found.select(id_col, F.posexplode_outer(F.array_distinct(items_col)).alias("_pos", "_raw"))
    keys = rows.select("_raw").filter("_raw IS NOT NULL").distinct().select("_raw", X.surface_key(F.col("_raw")).alias("_key"))
    kept = rows.join(keys, "_raw", "left").select(id_col, F.when(F.length("_key") > 0, F.struct("_pos", "_key")).alias("_k"))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list("_k")), lambda k: k["_key"]))
    return kept.groupBy(id_col).agg(listed.alias("surfaces"))
