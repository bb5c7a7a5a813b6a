"""Sources: page assets, corpora, numbered text files, JSON lines, tables; each a DataFrame with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType(
    [T.StructField("block_label", T.StringType()), T.StructField("block_content", T.StringType()), T.StructField("block_id", T.IntegerType()), T.StructField("block_order", T.IntegerType())]
)
PAGE = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text_markdown", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("layout_blocks", T.ArrayType(BLOCK)),
        T.StructField("quality_flags", T.MapType(T.StringType(), T.BooleanType())),
    ]
)
CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in ("idx", "title", "text", "paragraph_text", "passage")])
VISUAL_FLAGS = ("has_table", "has_image", "has_chart", "has_formula", "has_seal", "has_figure", "dense_layout")
DENSE_BLOCKS = 12


def page_assets(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all JSON files below a path; of a key that repeats, the row of the last file stays.

    Files that aren't JSON are left out, as are rows without a page id.
    """
    raw = spark.read.schema(PAGE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("_file", F.input_file_name())
    rows = raw.select(F.coalesce("page_id", "id").alias("page_id"), "file_id", "page_number", F.coalesce("text_markdown", "text").alias("text_markdown"), "layout_blocks", "quality_flags", "_file")
    w = Window.partitionBy("file_id", "page_id").orderBy(F.desc("_file"))
    return rows.filter("page_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_file")


def page_mode() -> Column:
    """text_with_img if any visual flag is set."""
    flags = [F.coalesce(F.col("quality_flags")[f], F.lit(False)) for f in VISUAL_FLAGS]
    any_set = flags[0]
    for f in flags[1:]:
        any_set = any_set | f
    return F.when(any_set, "text_with_img").otherwise("text")


def block_flags(blocks: Column) -> Column:
    """Signals of a page from the labels of its blocks."""
    has = lambda *labels: F.exists(blocks, lambda b: F.lower(b["block_label"]).isin(*labels))
    return F.create_map(
        F.lit("has_table"), has("table"), F.lit("has_figure"), has("figure", "image"), F.lit("has_chart"), has("chart"), F.lit("has_formula"), has("formula", "display_formula"), F.lit("dense_layout"), F.size(blocks) >= DENSE_BLOCKS
    )


def find_page(pages: DataFrame, key: str) -> DataFrame:
    """One page by `file/page`, or by page id alone if only one file has it; no row otherwise."""
    if "/" in key:
        file_id, _, page_id = key.rpartition("/")
        return pages.filter((F.col("file_id") == file_id) & (F.col("page_id") == page_id))
    hit = pages.filter(F.col("page_id") == key)
    return hit.withColumn("_n", F.count("*").over(Window.partitionBy("page_id"))).filter("_n = 1").drop("_n")


def corpus_items(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(file_id, title, text) of a JSON list; the first of text, paragraph_text and passage that isn't empty."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    filled = [F.when(F.length(c) > 0, F.col(c)) for c in ("text", "paragraph_text", "passage")]
    number = F.col("idx").try_cast("bigint")
    slug = F.regexp_replace(F.lower("idx"), "[^a-z0-9]+", "-")
    name = F.when(number.isNotNull(), F.format_string(f"{dataset}_%06d", number)).otherwise(F.concat(F.lit(f"{dataset}_"), slug))
    return raw.select(name.alias("file_id"), "title", F.coalesce(*filled, F.lit("")).alias("text"))


def qa_paragraphs(qa: DataFrame) -> DataFrame:
    """(title, text) of questions with context lists or paragraph lists; blank ones go."""
    parts = []
    if "context" in qa.columns:
        parts.append(qa.select(F.explode("context").alias("c")).select("c.title", F.array_join("c.sentences", " ").alias("text")))
    if "paragraphs" in qa.columns:
        parts.append(qa.select(F.explode("paragraphs").alias("p")).select("p.title", F.col("p.paragraph_text").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.length(F.trim("text")) > 0).distinct()


def numbered_texts(spark: SparkSession, path: str) -> DataFrame:
    """(number, part, text) of files NNN.txt and NNN_M.txt."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(name.alias("name"), F.col("value").alias("text"))
    n, m = F.regexp_extract("name", r"^([0-9]+)(?:_([0-9]+))?\.txt$", 1), F.regexp_extract("name", r"^([0-9]+)(?:_([0-9]+))?\.txt$", 2)
    return raw.filter(n != "").select(n.cast("int").alias("number"), m.try_cast("int").alias("part"), "text")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines; a line that isn't JSON stands in _corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    return rows if limit is None else rows.limit(limit)


def batch_ranges(files: DataFrame, size: int = 50) -> DataFrame:
    """(file_id, first, last) of page batches of n_pages, from 1, both ends included."""
    first = F.explode(F.sequence(F.lit(1), F.col("n_pages"), F.lit(size)))
    return files.filter("n_pages >= 1").withColumn("first", first).select("file_id", "first", F.least(F.col("first") + size - 1, F.col("n_pages")).alias("last"))


def ocr_pages(batches: DataFrame) -> DataFrame:
    """(file_id, page_number, text) of OCR batches (file_id, first, results): number is the batch's first and the index."""
    r = batches.select("file_id", "first", F.posexplode("results").alias("i", "text"))
    return r.select("file_id", (F.col("first") + F.col("i")).alias("page_number"), "text")


def table_newest_first(spark: SparkSession, name: str, at: str, key: str) -> DataFrame:
    return spark.table(name).orderBy(F.desc(at), F.desc(key))


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read in key ranges by many tasks. The driver class must be on the class path."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
