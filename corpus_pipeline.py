"""The corpus pipeline: from documents to tokens of what is worth training on.

Each stage works on all that the one before has kept and, but for the last, returns the columns of
documents:

1. toxicity: rows predicted toxic go; the model learns from the stage's own input and the labels table.
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. SimHash near-dedup: of each component the row with the smallest doc_id stays. Links are op4's: three-word
   fingerprints within 3 of 64 bits. Most near copies with a few changed words are further apart and stay;
   README has the measured share.
4. benchmark decontamination: merged spans of benchmark words are cut from the texts, n_chars follows;
   a row that has nothing but such spans keeps an empty text.
5. BPE encoding and decoding: token counts and digests of the texts that are left.

Null and empty texts pass every stage as empty texts; as equal texts they leave one row behind. Rows with
a null doc_id go only in the exact dedup, where a row with an id has the same text. Rows go each by itself,
also where ids repeat. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup, simhash
from folioscope.llm.bpe import encode_documents, token_digests
from folioscope.llm.common import stored, table
from folioscope.llm.decontaminate import cut_spans
from folioscope.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = cut_spans(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokens),
]

#: A trained classifier, XXH64 fingerprints and a tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
