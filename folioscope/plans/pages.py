"""Web page, conversation and passage-packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import structure
from folioscope.plans.base import SENTENCES, Registry, table

R = Registry()

HTML_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'),
  '(?is)<noscript[^>]*>.*?</noscript>', '', 'g'), '(?is)<head[^>]*>.*?</head>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n+', chr(10) || chr(10), 'g') AS t FROM c)
SELECT page_id, md5(regexp_replace(t, '^[ \n]+|[ \n]+$', '', 'g')) AS text FROM d
"""


@R.add(HTML_SQL)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of web pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_text(F.col("html"))).alias("text"))


@R.add(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of web pages."""
    return table(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@R.add(
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, host and path of addresses."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"),
    )


@R.add(
    r"""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1"""
)
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and characters by host."""
    p = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return p.agg(F.count("*").alias("pages"), F.sum(F.length("html").cast("bigint")).alias("chars"))


@R.add(
    r"""SELECT page_id, CAST(pos AS INTEGER) AS item, trim(regexp_replace(items[pos], '<[^>]*>', '', 'g')) AS text FROM (
SELECT page_id, items, unnest(range(1, len(items) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1) AS items FROM pages))"""
)
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists in pages, numbered."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li>(.*?)</li>"), F.lit(1))
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(items).alias("p", "x"))
    return p.select("page_id", (F.col("p") + 1).alias("item"), F.trim(F.regexp_replace("x", "<[^>]*>", "")).alias("text"))


@R.add(
    """
SELECT conv_id, turn, user_turn FROM (
  SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn
  FROM conversations) WHERE role = 'assistant' AND user_turn IS NOT NULL"""
)
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the question before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    c = c.withColumn("user_turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))
    return c.filter("role = 'assistant' AND user_turn IS NOT NULL").select("conv_id", "turn", "user_turn")


@R.add(
    """SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS rendered, count(*) AS n FROM (
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY 1"""
)
def conversation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six turns as text."""
    from folioscope.operators.order import top_per_group

    last = top_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return last.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.md5(F.array_join("t.line", "\n")).alias("rendered"), F.size("t").cast("bigint").alias("n"))


@R.add("SELECT conv_id, max(turn) AS last_turn, count(*) AS turns FROM conversations GROUP BY 1 ORDER BY last_turn DESC, conv_id DESC LIMIT 50")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of sessions, newest first."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"))
    return c.orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(50)


@R.add("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS sessions, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, sessions and characters by role."""
    c = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("c"))
    return c.groupBy("role").agg(F.sum("n").alias("turns"), F.count("*").alias("sessions"), F.sum("c").alias("chars"))


@R.add(
    "WITH "
    + SENTENCES
    + f""", c AS (SELECT doc_id, flatten(list_transform(list(sentence ORDER BY pos), lambda s: CASE WHEN length(s) <= {structure.PASSAGE_BUDGET} THEN [s]
  ELSE list_transform(range(1, length(s) + 1, {structure.PASSAGE_BUDGET}), lambda i: substr(s, i, {structure.PASSAGE_BUDGET})) END)) AS c FROM sent GROUP BY 1),
p AS (SELECT doc_id, list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= {structure.PASSAGE_BUDGET}
  THEN list_concat(a[:len(a) - 1], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END) AS p FROM c),
u AS (SELECT doc_id, n, p[n + 1] AS t FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS n FROM p))
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(length(t) AS INTEGER) AS chars, md5(t) AS passage FROM u"""
)
def passage_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed to passages of at most 1200 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(structure.budget_split(X.sentences(F.col("text")))).alias("n", "passage"))
    return d.select("doc_id", "n", F.length("passage").alias("chars"), F.md5("passage").alias("passage"))


@R.add(
    "WITH "
    + SENTENCES
    + """, b AS (SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars, CAST(max(length(sentence)) AS INTEGER) AS longest FROM sent GROUP BY 1)
SELECT * FROM b"""
)
def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, in all and the longest. Reduced within the row."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(X.sentences(F.col("text")), F.length).alias("l")).filter(F.size("l") > 0)
    return d.select("doc_id", F.size("l").cast("bigint").alias("n"), F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"), F.array_max("l").alias("longest"))


QUERIES, ORACLES = R.queries, R.oracles
