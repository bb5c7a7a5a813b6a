"""A stored word index: postings in stripes of documents, with bounds that let a query skip most of them.

Documents of a batch are numbered in the order of their lengths and cut into stripes of STRIPE numbers. A row of the
postings table is a word in a stripe: how many of its documents hold it, places within the stripe, counts and lengths,
the largest count and the least length. BM25 grows with the count and falls with the length, so the last two bound
the score of any document of the stripe, whatever the mean length has become.

The table is partitioned by a hash of the word and sorted by word, so a query reads the postings of its words only.
Top k is exact: the stripes of the highest bounds are scored first, the k-th score found there is a threshold, and
of the other stripes only those whose bound reaches it are scored.

A batch is written to a folder of its own and then entered in the log; only batches of the log are read, and a batch whose
name is in the log already is not added again. Files are removed by positions, which queries leave out.
One writer at a time. Null texts count as documents, but not for the mean length; empty batches are entered without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scores
from folioscope.functions import text as X
from folioscope.operators.graph import written
from folioscope.operators.order import top_per_group
from folioscope.operators.search import QUERY_ROWS, small

STRIPE = 512
BUCKETS = 64
#: Stripes of each query that are scored before there is a threshold.
FIRST = 2
#: Scores are rounded to six places; a bound this close may still tie.
SLACK = 1e-5

LOG = "kind string, batch string, folder string, number int, n_docs bigint, n_texts bigint, n_words bigint"


class WordIndex:
    """An index at a path of a shared file system; opened anew, it is as it was left."""

    def __init__(self, spark: SparkSession, path: str, stripe: int = STRIPE, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        head = self._table("layout", "stripe int, buckets int").collect()
        if not head:
            spark.createDataFrame([(stripe, buckets)], "stripe int, buckets int").coalesce(1).write.parquet(f"{self.path}/layout")
        self.stripe, self.buckets = head[0] if head else (stripe, buckets)

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the index, empty where it isn't there yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def log(self) -> list:
        """One row a batch or removal, in the order of their entry."""
        return sorted(self._table("log", LOG).collect(), key=lambda r: r["number"])

    def _enter(self, *row) -> None:
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def append(self, docs: DataFrame, batch: str, id_col: str = "doc_id", file_col: str = "file_id", text_col: str = "text") -> bool:
        """Adds a batch of documents under a name; False if that name has been added before."""
        log = self.log()
        if any(r["kind"] == "add" and r["batch"] == batch for r in log):
            return False
        number = len(log)
        folder = f"{number}-{uuid.uuid4().hex[:12]}"
        listed = docs.select(F.col(id_col).alias("id"), F.col(file_col).cast("string").alias("file"), X.words(F.col(text_col)).alias("words"))
        listed = listed.withColumn("length", F.size("words"))
        # Like lengths lie together: bounds are tight. Partitions begin a stripe, for their numbers are multiples of 2**33.
        # Written first: the ranges are found on a pass of its own, which would look for all words again.
        listed = written(listed, "index-words")
        ordered = written(listed.repartitionByRange("length", "id").sortWithinPartitions("length", "id"), "index-batch")
        no = F.monotonically_increasing_id()
        ordered = ordered.withColumn("no", no).select(
            "id", "file", "words", "length", (F.lit(number).cast("long") * (1 << 42) + F.floor(F.col("no") / self.stripe)).alias("stripe"), (F.col("no") % self.stripe).cast("smallint").alias("place")
        )
        ordered.select("stripe", "place", "id", "file", "length").write.parquet(f"{self.path}/docs/{folder}")
        # Counts within the row: a sorted list's runs. One shuffle, of a document's distinct words.
        n = F.size("w")
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("w", i) != F.element_at("w", F.greatest(i - 1, F.lit(1)))))
        runs = ordered.filter("length > 0").withColumn("w", F.array_sort("words")).drop("words").withColumn("b", begins)
        ends = F.concat(F.slice("b", 2, F.size("b")), F.array(n + 1))
        pairs = runs.withColumn("e", ends).select("stripe", "place", "length", F.explode(F.zip_with("b", "e", lambda b, e: F.struct(F.element_at("w", b).alias("word"), (e - b).alias("tf")))).alias("x"))
        pairs = pairs.select("x.word", "stripe", "place", "x.tf", "length")
        blocks = pairs.groupBy("word", "stripe").agg(F.sort_array(F.collect_list(F.struct("place", "tf", "length"))).alias("p"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
        blocks = blocks.select(
            F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int").alias("bucket"), "word", "stripe", F.size("p").alias("n"), "max_tf", "min_length",
            F.col("p.place").alias("places"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"),
        )
        # By bucket, with large ones split as they come out: ranges would make all blocks twice.
        blocks.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "word", "stripe").write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={folder}")
        n_docs, n_texts, n_words = self.spark.read.parquet(f"{self.path}/docs/{folder}").agg(F.count("*"), F.count("length"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0))).first()
        self._enter("add", batch, folder, number, n_docs, n_texts, n_words)
        return True

    def docs(self) -> DataFrame | None:
        """(stripe, place, id, file, length) of all batches, removed documents included; None for an index without any."""
        folders = [f"{self.path}/docs/{r['folder']}" for r in self.log() if r["kind"] == "add" and r["n_docs"]]
        return self.spark.read.parquet(*folders) if folders else None

    def removed(self) -> DataFrame | None:
        """(stripe, place) of what has been removed."""
        folders = [r["folder"] for r in self.log() if r["kind"] == "remove" and r["n_docs"]]
        return self.spark.read.schema("stripe bigint, place smallint").parquet(*folders) if folders else None

    def remove(self, file: str) -> int:
        """Takes a file's documents out; their number. Their postings stay and are left out by queries."""
        docs, gone = self.docs(), self.removed()
        if docs is None:
            return 0
        own = docs.filter(F.col("file") == str(file))
        own = own if gone is None else own.join(gone, ["stripe", "place"], "left_anti")
        number = len(self.log())
        folder = f"{self.path}/removed/{number}-{uuid.uuid4().hex[:12]}"
        own.select("stripe", "place", "length").write.parquet(folder)
        n_docs, n_texts, n_words = self.spark.read.parquet(folder).agg(F.count("*"), F.count("length"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0))).first()
        self._enter("remove", str(file), folder, number, n_docs, n_texts, n_words)
        return n_docs

    def postings(self, words: DataFrame) -> DataFrame | None:
        """The rows of the words (column word, distinct): up to QUERY_ROWS words by pruned partitions and pushed filters, more by a join."""
        folders = [f"{self.path}/postings/batch={r['folder']}" for r in self.log() if r["kind"] == "add" and r["n_words"]]
        if not folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/postings").parquet(*folders).drop("batch")
        bucketed = words.select("word", F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int").alias("bucket"))
        few = bucketed.limit(QUERY_ROWS + 1).collect()
        if len(few) > QUERY_ROWS:
            return rows.join(bucketed, ["bucket", "word"], "left_semi")
        return rows.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("word").isin(sorted(r["word"] for r in few)))

    def _scored(self, pairs: DataFrame, terms: DataFrame, weights: DataFrame, rows: DataFrame, mean: float) -> DataFrame:
        """(query_id, stripe, place, score) of every live document of the pairs (query_id, stripe) that holds a word."""
        wanted = pairs.join(small(terms), "query_id").join(small(weights), "word")
        hits = wanted.join(rows.select("word", "stripe", "places", "tfs", "lengths"), ["word", "stripe"])
        hits = hits.select("query_id", "stripe", "idf", F.explode(F.arrays_zip("places", "tfs", "lengths")).alias("p"))
        value = scores.bm25(F.col("p.tfs"), F.col("p.lengths"), F.lit(mean), F.col("idf"))
        found = hits.groupBy("query_id", "stripe", F.col("p.places").alias("place")).agg(F.round(F.sum(value), 6).alias("score"))
        gone = self.removed()
        return found if gone is None else found.join(gone, ["stripe", "place"], "left_anti")

    def search(self, queries: DataFrame, k: int, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
        """(query_id, <id_col>, score, rank): the exact k best documents by BM25, and what was read for it.

        The second table has (query_id, stripes, scored) for each query with any hit.
        """
        spark = self.spark
        terms = queries.select("query_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
        terms = written(terms, "index-terms")
        rows = self.postings(terms.select("word").distinct())
        docs = self.docs()
        kind = queries.schema["query_id"].dataType.simpleString()
        if rows is None or docs is None:
            id_type = "bigint" if docs is None else docs.schema["id"].dataType.simpleString()
            return spark.createDataFrame([], f"query_id {kind}, `{id_col}` {id_type}, score double, rank int"), spark.createDataFrame([], f"query_id {kind}, stripes bigint, scored bigint")
        sign = {"add": 1, "remove": -1}
        n_docs = sum(sign[r["kind"]] * r["n_docs"] for r in self.log())
        n_texts = sum(sign[r["kind"]] * r["n_texts"] for r in self.log())
        mean = sum(sign[r["kind"]] * r["n_words"] for r in self.log()) / n_texts if n_texts else 0.0
        held = rows.groupBy("word").agg(F.sum("n").alias("df"))
        gone = self.removed()
        if gone is not None:
            # Only stripes with removed documents are opened to correct the counts.
            open_ = rows.join(gone.select("stripe").distinct(), "stripe", "left_semi").select("word", "stripe", F.explode("places").alias("place"))
            less = open_.join(gone, ["stripe", "place"], "left_semi").groupBy("word").agg(F.count("*").alias("less"))
            held = held.join(less, "word", "left").select("word", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df")).filter("df > 0")
        weights = written(held.select("word", scores.bm25_idf(F.lit(n_docs), F.col("df")).alias("idf")), "index-weights")
        bound = scores.bm25(F.col("max_tf"), F.col("min_length"), F.lit(mean), F.col("idf"))
        tops = rows.select("word", "stripe", "max_tf", "min_length").join(small(weights), "word").select("word", "stripe", bound.alias("bound"))
        bounds = tops.join(small(terms), "word").groupBy("query_id", "stripe").agg(F.sum("bound").alias("bound"))
        bounds = written(bounds, "index-bounds")

        first = top_per_group(bounds, ["query_id"], [F.desc("bound"), F.asc("stripe")], FIRST).select("query_id", "stripe")
        begun = written(self._scored(first, terms, weights, rows, mean), "index-first")
        # Queries of fewer than k hits so far have no threshold.
        least = top_per_group(begun, ["query_id"], [F.desc("score"), F.asc("stripe"), F.asc("place")], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        left = bounds.join(first, ["query_id", "stripe"], "left_anti").join(small(least), "query_id", "left")
        left = written(left.filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select("query_id", "stripe"), "index-left")
        rest = self._scored(left, terms, weights, rows, mean)
        both = begun.unionByName(rest)
        # Ties go by id: all that reach the k-th score get their ids first.
        place = top_per_group(both, ["query_id"], [F.desc("score"), F.asc("stripe"), F.asc("place")], k)
        last = place.groupBy("query_id").agg(F.min("score").alias("last"))
        near = both.join(small(last), "query_id").filter(F.col("score") >= F.col("last"))
        named = near.join(docs.select("stripe", "place", "id"), ["stripe", "place"]).select("query_id", F.col("id").alias(id_col), "score")
        found = top_per_group(named, ["query_id"], [F.desc("score"), F.asc(id_col)], k)
        opened = first.unionByName(left).groupBy("query_id").agg(F.count("*").alias("scored"))
        read = bounds.groupBy("query_id").agg(F.count("*").alias("stripes")).join(opened, "query_id")
        return found.select("query_id", id_col, "score", "rank"), read
