"""Queries on walks, staged seeds, keyed reads and redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import corpus, graph
from folioscope.operators.attribution import attribution_walks
from folioscope.operators.fallback import staged_seeds
from folioscope.operators.order import neighbours
from folioscope.plans.base import MENTIONS, Registry, mentions, table
from folioscope.plans.graphs import PPR_SQL, ROUNDS, _edges, _seeds
from folioscope.sources import readers

R = Registry()

WALKS, STEPS = 200, 6
_MOVES = "".join(
    f""", k{k} AS MATERIALIZED (SELECT w.seed, w.walk, coalesce(p.dst, w.pos) AS pos, CASE WHEN p.dst IS NOT NULL AND w.pos NOT LIKE 'passage-%' THEN w.pos ELSE w.entity END AS entity
  FROM k{k - 1} w LEFT JOIN part p ON p.src = w.pos AND w.pos NOT IN (SELECT node FROM goal)
    AND CAST('0x' || substr(md5(w.seed || ':' || w.walk || ':{k}'), 1, 13) AS BIGINT) / pow(2, 52) >= p.lo AND CAST('0x' || substr(md5(w.seed || ':' || w.walk || ':{k}'), 1, 13) AS BIGINT) / pow(2, 52) < p.hi)"""
    for k in range(1, STEPS)
)


@R.add(
    PPR_SQL
    + f""", goal AS MATERIALIZED (SELECT node FROM x{ROUNDS} WHERE node LIKE 'passage-%' ORDER BY round(s, 8) DESC, node LIMIT 20),
cum AS (SELECT src, dst, sum(w) OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 2), dst ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY src) AS hi FROM sym),
part AS MATERIALIZED (SELECT src, dst, coalesce(lag(hi) OVER (PARTITION BY src ORDER BY substr(md5(dst), 1, 2), dst), 0) AS lo, hi FROM cum),
k0 AS MATERIALIZED (SELECT node AS seed, walk, node AS pos, CAST(NULL AS VARCHAR) AS entity FROM seed, range(1, {WALKS + 1}) r(walk))"""
    + _MOVES
    + f" SELECT pos AS target, coalesce(entity, pos) AS credited, count(*) AS n FROM k{STEPS - 1} WHERE pos IN (SELECT node FROM goal) GROUP BY ALL"
)
def walk_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which surfaces lead to the twenty passages of highest rank: 200 walks of five moves at most from each seed surface."""
    e = _edges(spark, sf_dir)
    ranked = graph.pagerank(e, _seeds(e).withColumn("mass", F.lit(1.0)), 0.5, ROUNDS).filter(F.col("node").startswith("passage-"))
    goal = graph.written(ranked.orderBy(F.round("score", 8).desc(), "node").limit(20).select("node"), "walk-targets")
    return attribution_walks(e, _seeds(e), goal, lambda node: ~node.startswith("passage-"), WALKS, STEPS)


@R.add(
    "WITH "
    + MENTIONS
    + r""", d AS MATERIALIZED (SELECT surface FROM men GROUP BY 1 HAVING count(*) * 200 >= (SELECT count(*) FROM pas) AND count(*) * 50 <= (SELECT count(*) FROM pas)),
qs AS (SELECT conv_id || '-' || turn AS q, conv_id, text FROM conversations WHERE role = 'user'),
s1 AS MATERIALIZED (SELECT DISTINCT q, surface FROM (SELECT q, lower(unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM qs) WHERE surface IN (SELECT surface FROM d)),
r1 AS (SELECT * FROM qs WHERE q NOT IN (SELECT q FROM s1)),
h2 AS (SELECT q, surface, count(*) AS n FROM (SELECT q, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS surface FROM r1) WHERE surface IN (SELECT surface FROM d) GROUP BY ALL),
s2 AS MATERIALIZED (SELECT q, surface FROM h2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, surface) <= 8),
r2 AS (SELECT q, conv_id FROM r1 WHERE q NOT IN (SELECT q FROM s2)),
s3 AS MATERIALIZED (SELECT q, node, sim FROM (
  SELECT r2.q, 'vector-' || b.vec_id AS node, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim
  FROM r2 JOIN embeddings a ON a.vec_id = r2.conv_id JOIN embeddings b ON b.vec_id NOT IN (SELECT conv_id FROM qs)) WHERE sim >= 0.3
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, node) <= 3)
SELECT q, surface AS node, CAST(1 AS DOUBLE) AS score, 'names' AS mode FROM s1 UNION ALL SELECT q, surface, 1, 'dictionary' FROM s2
UNION ALL SELECT q, node, sim, 'vectors' FROM s3 UNION ALL SELECT q, NULL, 0, 'no_seeds' FROM r2 WHERE q NOT IN (SELECT q FROM s3)"""
)
def question_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of every question that a user asks, and the stage that found them.

    The dictionary is the surfaces in half a per cent to two per cent of all passages; the vector of a question is
    the one with its conversation's number, and those of questions aren't searched; the given
    vectors lie far apart, so the floor is 0.3.
    """
    m = graph.written(mentions(spark, sf_dir), "mentions")
    n = table(spark, sf_dir, "documents").select(X.content_hash(F.col("text"))).distinct().count()
    known = m.groupBy("surface").agg(F.count("*").alias("df")).filter(f"df * 200 >= {n} AND df * 50 <= {n}").select("surface")
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("q"), "conv_id", "text")
    names = asked.select("q", F.explode(X.surfaces(F.col("text"))).alias("surface"))
    v = table(spark, sf_dir, "embeddings")
    probes = asked.join(v, F.col("conv_id") == F.col("vec_id")).select("q", F.col("embedding").alias("vec"))
    stored = v.join(asked.select(F.col("conv_id").alias("vec_id")), "vec_id", "left_anti")
    return staged_seeds(asked, names, known, probes, stored.select(F.concat(F.lit("vector-"), "vec_id").alias("node"), F.col("embedding").alias("v")), floor=0.3)


@R.add("SELECT source AS file_id, 'p_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS page_id, md5(text) AS digest FROM documents QUALIFY doc_id IN (min(doc_id) OVER (), max(doc_id) OVER ())")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages by key: the first by its page id alone, the last by file and page id."""
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("source").alias("file_id"), F.format_string("p_%08d", "doc_id").alias("page_id"), F.md5("text").alias("digest"))
    ends = d.agg(F.min("doc_id").alias("low"), F.max_by(F.struct("source", "doc_id"), "doc_id").alias("high")).first()
    if ends.low is None:
        return pages
    return readers.find_page(pages, f"p_{ends.low:08d}").unionByName(readers.find_page(pages, f"{ends.high.source}/p_{ends.high.doc_id:08d}"))


@R.add("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the session's catalogue, newest rows first."""
    name = "newest_" + graph.shared_path(spark, "view").rsplit("-", 1)[1]
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").createOrReplaceTempView(name)
    return readers.table_newest_first(spark, name, "o_orderdate", "o_orderkey")


@R.add("SELECT DISTINCT md5(html) AS upload, CASE WHEN in_docs THEN 'right' ELSE 'left' END AS side FROM (SELECT html, FALSE AS in_docs FROM pages WHERE md5(html) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL) UNION ALL SELECT text, TRUE FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(html) FROM pages WHERE html IS NOT NULL))")
def orphan_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads without a record and records without an upload, by digest."""
    stored = table(spark, sf_dir, "pages").select(F.md5("html").alias("upload")).filter("upload IS NOT NULL")
    recorded = table(spark, sf_dir, "documents").select(F.md5("text").alias("upload")).filter("upload IS NOT NULL")
    return corpus.drift(stored, recorded, "upload")


@R.add(
    """WITH p AS (SELECT md5(text) AS h, doc_id, lead(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS up FROM documents WHERE text IS NOT NULL),
r AS (SELECT md5(text) AS h, max(doc_id) AS root FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT doc_id AS node, root FROM p JOIN r USING (h) WHERE up IS NOT NULL"""
)
def redirect_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of equal texts redirects to the one after it; where the chain of redirects ends."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5("text").alias("h"), "doc_id")
    n = neighbours(d.withColumn("id", F.col("doc_id")), "h", "doc_id", ["id"]).filter("next_id IS NOT NULL")
    return graph.chase(n.select(F.col("doc_id").alias("node"), F.col("next_id").alias("canonical")), rounds=40)


QUERIES, ORACLES = R.queries, R.oracles
