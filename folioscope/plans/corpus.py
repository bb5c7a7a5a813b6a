"""Corpus queries: content dedup, sentences, surfaces, statistics, append, removal and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scores
from folioscope.functions import text as X
from folioscope.operators import corpus, graph, order
from folioscope.plans.base import MENTIONS, SENTENCES, Registry, mentions, passages, sentence_rows, table

R = Registry()


@R.add("SELECT 'passage-' || md5(text) AS passage, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def dedup_by_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct passages with their first document."""
    return passages(spark, sf_dir).groupBy("passage").agg(F.min("page").alias("first_doc"), F.count("*").alias("n"))


@R.add("WITH " + SENTENCES + "SELECT doc_id, pos, md5(sentence) AS sentence FROM sent")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, by position."""
    return sentence_rows(spark, sf_dir).select("doc_id", "pos", F.md5("sentence").alias("sentence"))


@R.add(
    "WITH "
    + SENTENCES
    + """, hit AS (SELECT doc_id, min(pos) AS mid FROM sent WHERE contains(lower(sentence), 'worth') GROUP BY 1)
SELECT doc_id, mid, md5(string_agg(sentence, ' ' ORDER BY pos)) AS window_text, count(*) AS n FROM sent JOIN hit USING (doc_id) WHERE pos BETWEEN mid - 1 AND mid + 1 GROUP BY ALL"""
)
def sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence with a needle and its neighbours. The split array is sliced: no shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    mid = F.array_position(F.transform("s", lambda x: F.contains(F.lower(x), F.lit("worth"))), True).cast("int") - 1
    w = F.slice("s", F.greatest(F.col("mid"), F.lit(1)), F.when(F.col("mid") == 0, 2).otherwise(3))
    return d.withColumn("mid", mid).filter("mid >= 0").select("doc_id", "mid", F.md5(F.array_join(w, " ")).alias("window_text"), F.size(w).cast("bigint").alias("n"))


STATS = (
    "WITH "
    + SENTENCES
    + r""", m AS (SELECT doc_id, source, pos, surface, count(*) AS n FROM (
  SELECT doc_id, source, pos, lower(unnest(regexp_extract_all(sentence, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM sent) GROUP BY ALL),
st AS (SELECT surface, CAST(sum(n) AS BIGINT) AS mention_count, count(*) AS sentence_df, count(DISTINCT doc_id) AS passage_df, count(DISTINCT source) AS doc_df FROM m GROUP BY 1)
"""
)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a surface. Counts go up in two steps, so that no distinct aggregate sees all mentions of a surface at once."""
    s = sentence_rows(spark, sf_dir).select("doc_id", "source", "pos", F.explode(X.surfaces(F.col("sentence"))).alias("surface"))
    per = s.groupBy("surface", "source", "doc_id", "pos").agg(F.count("*").alias("n"))
    per = per.groupBy("surface", "source", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("s"))
    per = per.groupBy("surface", "source").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("p"))
    return per.groupBy("surface").agg(F.sum("n").alias("mention_count"), F.sum("s").alias("sentence_df"), F.sum("p").alias("passage_df"), F.count("*").alias("doc_df"))


@R.add(STATS + "SELECT * FROM st")
def surface_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, and sentence, passage and file frequencies of surfaces."""
    return _stats(spark, sf_dir)


@R.add(
    STATS
    + """, r AS (SELECT passage_df, row_number() OVER (ORDER BY passage_df) - 1 AS i, count(*) OVER () AS n FROM st)
SELECT surface, passage_df FROM st WHERE passage_df >= (SELECT passage_df FROM r WHERE i = CAST(floor(0.95 * n) AS BIGINT))"""
)
def high_df_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces at or above the 0.95 quantile of passage frequency."""
    st = graph.written(_stats(spark, sf_dir).select("surface", "passage_df"), "surface-df")
    cut = order.value_at_quantile(st, "passage_df", 0.95)
    return st.join(F.broadcast(cut), F.col("passage_df") >= F.col("cutoff")).select("surface", "passage_df")


@R.add(STATS + "SELECT surface, round(ln(((SELECT count(*) FROM documents) + 1) / (passage_df + 0.5)), 6) AS idf FROM st")
def surface_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rarity of surfaces."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return _stats(spark, sf_dir).crossJoin(F.broadcast(n)).select("surface", F.round(scores.surface_idf(F.col("n"), F.col("passage_df")), 6).alias("idf"))


@R.add(
    "WITH "
    + SENTENCES
    + r""", m AS (SELECT DISTINCT doc_id, pos, lower(unnest(regexp_extract_all(sentence, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM sent),
d AS (SELECT doc_id, pos, count(*) AS k FROM m GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12)
SELECT a.surface AS surface_a, b.surface AS surface_b, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.surface < b.surface
JOIN d ON a.doc_id = d.doc_id AND a.pos = d.pos GROUP BY 1, 2"""
)
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of surfaces in sentences of 2 to 12 distinct surfaces, made within the sentence's row."""
    s = sentence_rows(spark, sf_dir)
    listed = s.select(F.concat_ws(":", "doc_id", "pos").alias("place"), F.explode(F.array_distinct(X.surfaces(F.col("sentence")))).alias("surface"))
    return graph.cooccurrence(listed, "place", "surface")


@R.add("WITH " + MENTIONS + "SELECT surface, passage, round(n / sum(n) OVER (PARTITION BY passage), 6) AS weight FROM men")
def entity_passage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from surfaces to passages by share of mentions."""
    e = graph.entity_passage_edges(mentions(spark, sf_dir))
    return e.select("surface", "passage", F.round("weight", 6).alias("weight"))


@R.add(
    """
WITH o AS (SELECT source, doc_id, md5(text) AS h, lead(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS nx FROM documents)
SELECT DISTINCT 'passage-' || least(h, nx) AS passage_a, 'passage-' || greatest(h, nx) AS passage_b, CAST(1.0 AS DOUBLE) AS weight FROM o WHERE nx IS NOT NULL AND h <> nx"""
)
def adjacent_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of following pages of a file."""
    return corpus.adjacent_passages(passages(spark, sf_dir))


@R.add(
    "SELECT source AS file_id, doc_id AS page, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_page FROM documents QUALIFY next_page IS NOT NULL"
)
def passage_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows each page of a file."""
    p = passages(spark, sf_dir).select("file_id", "page", F.col("page").alias("at"))
    n = order.neighbours(p, "file_id", "page", ["at"])
    return n.filter("next_at IS NOT NULL").select("file_id", "page", F.col("next_at").alias("next_page"))


@R.add(
    """
WITH o AS (SELECT DISTINCT source, md5(text) AS h FROM documents), gone AS (SELECT DISTINCT h FROM o WHERE source = 'src3')
SELECT 'passage-' || h AS passage FROM gone WHERE h NOT IN (SELECT h FROM o WHERE source <> 'src3')"""
)
def remove_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that go with a file: those no other file holds."""
    return corpus.remove_file(corpus.occurrences(passages(spark, sf_dir)), "src3")["removed_passages"]


@R.add(
    "WITH "
    + MENTIONS
    + """, o AS (SELECT DISTINCT source, 'passage-' || md5(text) AS passage FROM documents),
rem AS (SELECT DISTINCT passage FROM o WHERE source = 'src3' AND passage NOT IN (SELECT passage FROM o WHERE source <> 'src3'))
SELECT DISTINCT surface FROM men WHERE surface NOT IN (SELECT surface FROM men WHERE passage NOT IN (SELECT passage FROM rem))"""
)
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces without a passage once a file is gone."""
    gone = corpus.remove_file(corpus.occurrences(passages(spark, sf_dir)), "src3")["removed_passages"]
    return corpus.orphan_surfaces(mentions(spark, sf_dir), gone)


@R.add(
    """
SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"""
)
def id_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that one of two tables lacks."""
    return corpus.drift(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@R.add(
    """
WITH h AS (SELECT doc_id, source, md5(text) AS h FROM documents)
SELECT 'passage-' || h AS passage, min(doc_id) AS page FROM h WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM h WHERE doc_id % 2 = 0) GROUP BY 1"""
)
def append_new_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second batch (odd ids) adds to the store of the first (even ids)."""
    p = passages(spark, sf_dir).select("passage", "page")
    return corpus.append_new(p.filter("page % 2 = 0"), p.filter("page % 2 = 1"), "passage")


@R.add("SELECT source, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT md5(text)) AS passages FROM documents GROUP BY 1")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, characters and distinct passages of files."""
    d = table(spark, sf_dir, "documents").groupBy("source", F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return d.groupBy("source").agg(F.sum("n").alias("pages"), F.sum("c").alias("chars"), F.count("*").alias("passages"))


@R.add(
    r"""
SELECT doc_id, CAST(pos AS INTEGER) AS line_no, start_char, md5(line) AS line FROM (
  SELECT doc_id, pos, l[pos] AS line, CAST(coalesce(list_sum(list_transform(l[1:pos - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start_char FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
"""
)
def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with numbers from 1 and exact character offsets; a running sum over the split array, no shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    ends = F.aggregate(
        F.transform("l", lambda x: F.length(x).cast("bigint") + 1),
        F.array(F.lit(0).cast("bigint")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    zipped = F.arrays_zip(F.col("l").alias("line"), F.slice(ends, 1, F.size("l")).alias("start_char"))
    return d.select("doc_id", F.posexplode(zipped).alias("p", "z")).select("doc_id", (F.col("p") + 1).alias("line_no"), "z.start_char", F.md5("z.line").alias("line"))


@R.add(
    r"""
WITH s AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
t AS (SELECT w, count(*) AS df FROM (SELECT unnest(w) AS w FROM s) GROUP BY 1)
SELECT CASE WHEN df = 1 THEN 'once' WHEN df < 10 THEN 'few' WHEN df < 100 THEN 'many' ELSE 'most' END AS band, count(*) AS words, CAST(sum(df) AS BIGINT) AS total FROM t GROUP BY 1"""
)
def word_df_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words by document frequency."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    band = F.when(F.col("df") == 1, "once").when(F.col("df") < 10, "few").when(F.col("df") < 100, "many").otherwise("most")
    return w.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("df").alias("total"))


@R.add(
    "WITH "
    + MENTIONS
    + """, r AS (SELECT passage, surface, n, row_number() OVER (PARTITION BY passage ORDER BY n DESC, surface) AS rank FROM men)
SELECT passage, surface, n, rank FROM r WHERE rank <= 5"""
)
def passage_top_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most mentioned surfaces of each passage."""
    return order.top_per_group(mentions(spark, sf_dir), ["passage"], [F.desc("n"), F.asc("surface")], 5)


@R.add("SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Han}') THEN 'zh' ELSE 'en' END AS script, lang FROM documents")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han or not, beside the given language."""
    return table(spark, sf_dir, "documents").select("doc_id", X.language(F.col("text")).alias("script"), "lang")


@R.add(
    "WITH "
    + MENTIONS
    + """SELECT surface, CAST(round(-0.05 * length(surface), 6) AS DOUBLE) AS quality, CASE WHEN surface LIKE 'the %' THEN 1 ELSE 0 END AS article FROM (SELECT DISTINCT surface FROM men)"""
)
def surface_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of surfaces as names; here without brackets, so length decides."""
    s = mentions(spark, sf_dir).select("surface").distinct()
    return s.select("surface", F.round(X.surface_quality(F.col("surface")), 6).alias("quality"), F.col("surface").startswith("the ").cast("int").alias("article"))


@R.add(
    """
WITH w AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, arg_max(lang, (n, lang)) AS main_lang, CAST(sum(n) AS BIGINT) AS pages FROM w GROUP BY 1"""
)
def most_voted_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of each file, larger name on ties."""
    w = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return w.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("main_lang"), F.sum("n").alias("pages"))


QUERIES, ORACLES = R.queries, R.oracles
