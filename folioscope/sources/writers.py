"""Sinks and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import one_line
from folioscope.operators.structure import PAGE_MARKER


class Snapshots:
    """Versions of a table below a path: each save is a new folder, and a pointer table names the newest.

    Readers see the old version or the new one, never a part. A version is refused if its guard
    (schema version and page count) isn't the one asked for.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, df: DataFrame, version: str, guard: int = 0) -> None:
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        n = self.pointers().agg(F.max("seq")).first()[0] if self._any() else 0
        row = self.spark.createDataFrame([(n + 1 if n else 1, folder, version, guard)], "seq long, folder string, version string, guard long")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")

    def _any(self) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def pointers(self) -> DataFrame:
        return self.spark.read.schema("seq long, folder string, version string, guard long").parquet(f"{self.path}/pointers")

    def load(self, version: str, guard: int = 0) -> DataFrame | None:
        """The newest version, or None if there is none or its guard differs."""
        if not self._any():
            return None
        top = self.pointers().orderBy(F.desc("seq")).first()
        return self.spark.read.parquet(top["folder"]) if top["version"] == version and top["guard"] == guard else None


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated lines with a header; fields lose tabs and line ends."""
    flat = df.select(*[one_line(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])
    flat.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def combined_markdown(batches: DataFrame) -> DataFrame:
    """(file_id, text): batch texts (file_id, pos, text) in order, the page marker between them. Bounded by a file's pages."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return batches.groupBy("file_id").agg(F.array_join(parts["text"], f"\n\n{PAGE_MARKER}\n\n").alias("text"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def write_traces(rows: DataFrame, path: str) -> None:
    """JSON lines by flavour and day; of equal contents of a day and name one stays."""
    w = Window.partitionBy("day", "name", "content_hash").orderBy("ts")
    one = rows.withColumn("day", F.to_date("ts")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    one.write.mode("append").partitionBy("flavor", "day").json(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A property graph as two tables."""
    vertices.write.parquet(f"{path}/vertices")
    edges.write.parquet(f"{path}/edges")


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """Vectors joined with their metadata by hash; all parts or none, and counts must agree."""
    meta, vectors = spark.read.parquet(f"{path}/meta"), spark.read.parquet(f"{path}/vectors")
    a, b = meta.count(), vectors.count()
    if a != b:
        raise ValueError(f"{path}: {a} rows of metadata, {b} vectors")
    return meta.join(vectors, "hash_id")
