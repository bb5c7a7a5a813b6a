"""Retrieval queries: word, vector and pattern channels, fusion and page folding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import order, search
from folioscope.operators.graph import shared_path
from folioscope.operators.word_index import WordIndex
from folioscope.plans.base import Registry, table

R = Registry()

#: Patterns of the registered pattern channel: name, expression, weight.
PATTERNS = [("number", "[0-9]+", 0.5), ("email", "[a-z0-9.]+@[a-z0-9.]+", 1.0), ("capital", "[A-Z][a-z]{11,}", 0.8)]

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark question whose id is divisible by ten."""
    return table(spark, sf_dir, "benchmark").filter("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = rf"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS_SQL}) AS word FROM benchmark WHERE item_id % 10 = 0),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(CAST(len(w) AS DOUBLE)) AS mean FROM d),
tf AS (SELECT doc_id, length, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
idf AS (SELECT word, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, mean FROM (SELECT word, count(*) AS df FROM tf GROUP BY 1), tot),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
      FROM tf JOIN idf USING (word) JOIN q USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", "text", 30)


@R.add(BM25_SQL + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 30")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 best documents of each question."""
    return _bm25(spark, sf_dir).select("query_id", "doc_id", "score", "rank")


def _word_index(spark: SparkSession, sf_dir: str) -> WordIndex:
    """An index of all documents, added in two batches."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "file_id")
    index = WordIndex(spark, shared_path(spark, "word-index"), buckets=16)
    second = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    index.append(d.filter(~second), "first")
    index.append(d.filter(second), "second")
    return index


@R.add(BM25_SQL + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 30")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 best documents of each question, from a stored index of two batches."""
    return _word_index(spark, sf_dir).search(_queries(spark, sf_dir), 30)[0].select("query_id", "doc_id", "score", "rank")


@R.add(
    BM25_SQL.replace("AS w FROM documents)", "AS w FROM documents WHERE source <> 'src7')") + "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 30"
)
def bm25_index_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after one source has been removed from the index."""
    index = _word_index(spark, sf_dir)
    index.remove("src7")
    return index.search(_queries(spark, sf_dir), 30)[0].select("query_id", "doc_id", "score", "rank")


@R.add(
    BM25_SQL
    + """SELECT source, doc_id, round(sum(score) / sqrt(count(*) + 1), 6) AS score, count(*) AS n_hits
FROM r JOIN documents USING (doc_id) WHERE rank <= 30 GROUP BY ALL"""
)
def bm25_multi_subquery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions as sub-queries of one: page scores over their top 30."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return search.page_scores(_bm25(spark, sf_dir).join(d, "doc_id"), ["source", "doc_id"]).select("source", "doc_id", "score", "n_hits")


DENSE_SQL = """
WITH p AS (SELECT vec_id AS probe, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT probe, vec_id, label, round(list_inner_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, p WHERE probe <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.dense(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", k)


@R.add(DENSE_SQL + "SELECT probe, vec_id, score, rank FROM r WHERE rank <= 30")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest vectors of each probe."""
    return _dense(spark, sf_dir, 30).select("probe", "vec_id", "score", "rank")


@R.add(
    DENSE_SQL
    + """, f AS (SELECT *, lag(score) OVER (PARTITION BY probe ORDER BY rank) AS prev FROM r WHERE rank <= 50 AND score >= 0.1),
c AS (SELECT *, max(CASE WHEN score <= 0 OR (prev - score) / prev > 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY probe ORDER BY rank) AS cut FROM f)
SELECT probe, vec_id, rank FROM c WHERE cut = 0"""
)
def gradient_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked neighbours up to the first steep drop."""
    return order.gradient_cut(_dense(spark, sf_dir, 50), "probe", "score", 0.1, 0.1).select("probe", "vec_id", "rank")


@R.add(
    DENSE_SQL
    + """SELECT probe, label, round(sum(score) / sqrt(count(*) + 1), 6) AS score, count(*) AS n_hits
FROM r WHERE rank <= 30 GROUP BY ALL"""
)
def dense_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours folded to labels by the saturating score."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return search.page_scores(_dense(spark, sf_dir, 30).join(e, "vec_id"), ["probe", "label"]).select("probe", "label", "score", "n_hits")


@R.add(
    r"""
WITH d AS (SELECT doc_id, text FROM documents), n AS (SELECT count(*) AS n FROM d),
h AS (
  SELECT doc_id, 'number' AS pattern, 0.5 AS weight, 1.0 AS broad, list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: lower(x))) AS m FROM d
  UNION ALL SELECT doc_id, 'email', 1.0, 1.0, list_distinct(list_transform(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+'), lambda x: lower(x))) FROM d
  UNION ALL SELECT doc_id, 'capital', 0.8, 1.0, list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{11,}'), lambda x: lower(x))) FROM d),
df AS (SELECT pattern, count(*) AS df FROM h WHERE len(m) > 0 GROUP BY 1),
s AS (SELECT doc_id, pattern, match, round(weight * ln((n + 1) / (df + 1)) * least(greatest(ln(1 + length(match) / 10.0), 0.1), 1.0)
        * CASE WHEN regexp_matches(match, '^[\p{N}\p{P} ]+$') THEN 0.2 ELSE 1.0 END, 6) AS score
      FROM (SELECT doc_id, pattern, weight, unnest(m) AS match FROM h) JOIN df USING (pattern), n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pattern, match) AS rank FROM s)
SELECT doc_id, pattern, match, score, rank FROM r WHERE rank <= 5"""
)
def regex_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best pattern matches of each document."""
    hits = search.regex_hits(table(spark, sf_dir, "documents"), PATTERNS, "doc_id", "text")
    return hits.select("doc_id", "pattern", "match", "score", "rank")


@R.add(
    BM25_SQL
    + """, e AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) DESC, vec_id) AS rank FROM embeddings WHERE vec_id <> 0),
c AS (SELECT 'bm25' AS channel, doc_id, rank FROM r WHERE query_id = 0 AND rank <= 30 UNION ALL SELECT 'dense', doc_id, rank FROM e WHERE rank <= 30)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(DISTINCT channel) AS n_channels FROM c GROUP BY 1"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and vector channels of question 0 fused by reciprocal ranks."""
    words = _bm25(spark, sf_dir).filter("query_id = 0").select(F.lit("bm25").alias("channel"), "doc_id", "rank")
    near = _dense(spark, sf_dir, 30).filter("probe = 0").select(F.lit("dense").alias("channel"), F.col("vec_id").alias("doc_id"), "rank")
    return search.fuse(words.unionByName(near), ["doc_id"], top=60).select("doc_id", F.round("score", 6).alias("score"), "n_channels")


@R.add(
    BM25_SQL
    + """, e AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT p.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings v, embeddings p WHERE p.vec_id % 100 = 0 AND v.vec_id <> p.vec_id)),
c AS (SELECT 'bm25' AS channel, query_id, doc_id, rank FROM r WHERE query_id % 100 = 0 AND rank <= 30 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM e WHERE rank <= 30),
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS s, count(DISTINCT channel) AS n_channels FROM c GROUP BY 1, 2)
SELECT query_id, doc_id, round(s, 6) AS score, n_channels, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM f"""
)
def rrf_fusion_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and vector channels of every question and probe whose id is divisible by 100, fused for each id."""
    d, asked = table(spark, sf_dir, "documents"), _queries(spark, sf_dir).filter("query_id % 100 = 0")
    words = search.bm25(d, asked, "doc_id", "text", 30).select(F.lit("bm25").alias("channel"), "query_id", "doc_id", "rank")
    near = _dense(spark, sf_dir, 30).select(F.lit("dense").alias("channel"), F.col("probe").alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    found = search.fuse(words.unionByName(near), ["doc_id"], top=60, query=["query_id"])
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "n_channels", "rank")


@R.add(
    r"""
WITH s AS (SELECT doc_id, source,
  CAST(len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'tion')) AS BIGINT) AS score FROM documents)
SELECT source, doc_id, score, rank FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
)
def passage_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten passages of each file that hold the needles most often."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", search.needle_score(F.col("text"), ["the", "tion", "x"]).cast("bigint").alias("score"))
    return order.top_per_group(d.filter("score > 0"), ["source"], [F.desc("score"), F.asc("doc_id")], 10)


@R.add(
    r"""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'tion')) AS h FROM documents),
s AS (SELECT doc_id, CASE WHEN len(h) > 0 THEN h[1] ELSE text END AS line FROM l)
SELECT doc_id, CASE WHEN length(line) > 240 THEN substr(line, 1, 240) || '…' ELSE line END AS snippet FROM s"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with the needle, or the head, at most 240 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


@R.add("SELECT source, doc_id, n_chars FROM documents WHERE source IN ('src1', 'src2') AND doc_id BETWEEN 10 AND 500")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File set and page range, pushed to the scan."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), "n_chars")
    found = search.within_scope(d, ["src1.pdf", "src2"], (10, 500))
    return found.select(F.col("file_id").alias("source"), F.col("page").alias("doc_id"), "n_chars")


@R.add(
    DENSE_SQL
    + """, m AS (SELECT probe, min(score) AS lo, max(score) AS hi FROM r WHERE rank <= 30 GROUP BY 1)
SELECT probe, vec_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 4) AS scaled FROM r JOIN m USING (probe) WHERE rank <= 30"""
)
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each ranked list scaled to 0..1."""
    from pyspark.sql import Window

    from folioscope.functions.scores import min_max

    w = Window.partitionBy("probe")
    top = _dense(spark, sf_dir, 30)
    return top.select("probe", "vec_id", F.round(min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)), 4).alias("scaled"))


@R.add(
    BM25_SQL
    + """SELECT query_id AS query, md5(string_agg('  [^' || rank || '] file_id=' || source || ' page_number=' || doc_id, chr(10) ORDER BY rank)) AS legend,
md5(string_agg('----- [^' || rank || '] Page file_id=' || source || ' page_id=' || doc_id || ' -----' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY rank)) AS block
FROM r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1"""
)
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best pages of each question as a numbered block of text with its legend, by digest."""
    from folioscope.operators.evidence import prompt_blocks as blocks

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("file_id"))
    best = search.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", "text", 5)
    pages = search.small(best.select("query_id", "doc_id", "rank")).join(d, "doc_id")
    got = blocks(pages.select(F.col("query_id").alias("query"), F.col("rank").alias("number"), "file_id", F.col("doc_id").alias("page_id"), "text"))
    return got.select("query", F.md5("legend").alias("legend"), F.md5("block").alias("block"))


QUERIES, ORACLES = R.queries, R.oracles
