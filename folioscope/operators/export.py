"""Evidence tables with running identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.graph import written
from folioscope.operators.order import neighbours


def running_ids(df: DataFrame, order: list[Column], name: str, pattern: str) -> DataFrame:
    """df with ids that count from 1 in a total order of the rows.

    Rows are dealt out by ranges of the order and numbered within their partition; a window over one row a
    partition gives each its offset. No task sees more than its range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("_m", F.monotonically_increasing_id()), "running-ids")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    out = rows.withColumn("_p", part).join(offsets, "_p")
    return out.withColumn(name, F.format_string(pattern, F.col("_o") + place + 1)).drop("_p", "_o", "_m")


def evidence_tables(docs: DataFrame, id_col: str = "doc_id", file_col: str = "source", text_col: str = "text") -> dict[str, DataFrame]:
    """Documents, passages, sentences, surfaces, mentions and the edges among them.

    A page of a file is a passage; passages and sentences are numbered in the order of pages, surfaces by
    name, mentions by sentence and place.
    """
    pages = docs.select(F.col(file_col).alias("file_id"), F.col(id_col).alias("page"), F.col(text_col).alias("text"))
    documents = running_ids(pages.groupBy("file_id").agg(F.count("*").alias("n_pages")), [F.col("file_id")], "doc_id", "d_%04d")
    passages = running_ids(pages.withColumn("sha256", F.sha2("text", 256)), [F.col("file_id"), F.col("page")], "passage_id", "p_%06d")
    passages = passages.join(documents.select("file_id", "doc_id"), "file_id")
    cut = passages.select("passage_id", "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_order", "text"))
    sentences = running_ids(cut, [F.col("passage_id"), F.col("sentence_order")], "sentence_id", "s_%06d")
    found = sentences.select("sentence_id", "passage_id", "doc_id", F.posexplode(X.surfaces(F.col("text"))).alias("pos", "surface_norm"))
    names = found.groupBy("surface_norm").agg(F.count("*").alias("mention_count"))
    surfaces = running_ids(names, [F.col("surface_norm")], "surface_id", "sf_%06d")
    mentions = running_ids(found.join(surfaces.select("surface_norm", "surface_id"), "surface_norm"), [F.col("sentence_id"), F.col("pos")], "mention_id", "m_%07d")
    surface_sentence = mentions.groupBy("surface_id", "sentence_id").agg(F.count("*").alias("mention_count"))
    surface_passage = mentions.groupBy("surface_id", "passage_id").agg(F.count("*").alias("mention_count"))
    total = surface_passage.groupBy("passage_id").agg(F.sum("mention_count").alias("_t"))
    surface_passage = surface_passage.join(total, "passage_id").withColumn("weight_in_passage", F.round(F.col("mention_count") / F.col("_t"), 6)).drop("_t")
    following = neighbours(passages.select("file_id", "page", "passage_id"), "file_id", "page", ["passage_id"]).filter("next_passage_id IS NOT NULL")
    forward = following.select("passage_id", "next_passage_id", F.lit("next_in_doc").alias("relation"))
    back = following.select(F.col("next_passage_id").alias("passage_id"), F.col("passage_id").alias("next_passage_id"), F.lit("prev_in_doc").alias("relation"))
    return {
        "documents": documents.select("doc_id", "file_id", "n_pages"),
        "passages": passages.select("passage_id", "doc_id", "page", "sha256"),
        "sentences": sentences.select("sentence_id", "passage_id", "doc_id", "sentence_order", "text"),
        "surfaces": surfaces.select("surface_id", "surface_norm", "mention_count"),
        "mentions": mentions.select("mention_id", "surface_id", "sentence_id", "passage_id", "doc_id"),
        "surface_sentence": surface_sentence,
        "surface_passage": surface_passage,
        "sentence_passage": sentences.select("sentence_id", "passage_id", "sentence_order"),
        "passage_next": forward.unionByName(back),
    }
