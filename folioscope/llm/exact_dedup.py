"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by text digest. A batch is reduced to one winner per digest,
compared with the index by a sort-merge anti-join, and what is new is appended. Everything on this
path is DataFrame and SQL work.

Defined cases: null text counts as empty; texts are equal only when identical, byte for byte; of equal
texts the largest id stays; a null id loses to any other, and a group of null ids has a null keep_id
and keeps nothing; rows that repeat the winner's id are each reported as kept; a long text is hashed whole; an
empty input gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from folioscope.llm.common import id_and_text, row_keys, stored, table, without, work_dir

#: A digest held by more than one row in this many is joined as a broadcast row: there can be no more
#: such digests than this, whatever the input.
HOT_SHARE = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): lowercase hex SHA-256 of each whole text in UTF-8."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id) bucketed and sorted by digest, kept at a path of the shared folder.

    Its layout, the number of buckets and the type of the ids, is stored beside the data when the index is made and
    holds from then on, whatever the session's settings are; arguments that differ from it are an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.schema("buckets int, id_type string").parquet(f"{self.path}/layout").first()
            if buckets not in (None, held["buckets"]) or id_type is not None and id_type.lower() != held["id_type"]:
                raise ValueError(f"the index at {path} has {held['buckets']} buckets and ids of type {held['id_type']}")
            self.buckets, self.id_type = held
        else:
            self.buckets, self.id_type = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), (id_type or "bigint").lower()
            spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(self.id_type).alias("id_type")).write.parquet(f"{self.path}/layout")
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id {self.id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """One row for each digest of the batch (doc_id, digest) that the index doesn't hold."""
        winners = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        # Always true, but no join is pushed below it: copies are combined before they are dealt out by digest.
        winners = winners.filter(F.spark_partition_id() >= 0)
        return winners.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Deduplicates the batch against the index and adds what is new; a batch that is added again adds nothing.

        A job that fails leaves nothing that is read. One writer at a time.
        """
        self.fresh(batch).select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Takes the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the id that stays for its text, the group's size and whether the row stays.

    Rows enter the index in two batches, larger ids first, so that an entry of the index is always the
    largest id of its text. Ids that are no numbers, which are compared as texts, enter in one.
    """
    spark = docs.sparkSession
    marks = stored(digests(docs, id_col, text_col), "digests")
    number = isinstance(marks.schema["doc_id"].dataType, NumericType)
    n, middle = marks.agg(F.count("*"), F.avg("doc_id") if number else F.lit(None)).first()
    index = DigestIndex(spark, work_dir(spark, "digest-index"), id_type=marks.schema["doc_id"].dataType.simpleString())
    if number:
        upper = F.coalesce(F.col("doc_id") > F.lit(middle or 0.0), F.lit(False))
        index.append(marks.filter(upper))
        index.append(marks.filter(~upper))
    else:
        index.append(marks)

    sizes = marks.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = stored(index.rows().join(sizes.hint("merge"), "digest"), "digest-groups")
    index.drop()
    hot = groups.filter(F.col("group_size") > max(1, n // HOT_SHARE))
    many = marks.join(F.broadcast(hot), "digest")
    few = marks.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.hint("merge"), "digest")
    return many.unionByName(few).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the largest id; every other column stays.

    Rows go each by itself, also where ids repeat. Of rows that repeat the winner's id one stays; a text
    that only rows without an id have keeps them all.
    """
    rows, key = row_keys(docs, id_col, text_col, null_first=True)
    gone = exact_groups(rows, key, text_col).filter(~F.col("kept"))
    if key != id_col:
        # Rows without an id come first: a winner among them has no rival with an id.
        least = rows.filter(F.col(id_col).isNotNull()).agg(F.min(key)).first()[0]
        gone = gone.filter(F.col("keep_id") >= F.lit(least).cast("bigint"))
    return without(rows, key, gone.select("doc_id"), "exact-gone").select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
