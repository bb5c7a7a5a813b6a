"""Graph queries over surfaces and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.scores import hub_damping
from folioscope.operators import clusters, graph
from folioscope.plans.base import ALIASES, MENTIONS, Registry, alias_clusters, alias_edges, mentions, mentions_of_total, table

R = Registry()

EDGES_SQL = (
    "WITH RECURSIVE "
    + MENTIONS
    + """, ed AS MATERIALIZED (SELECT surface AS src, passage AS dst, n / sum(n) OVER (PARTITION BY passage) AS w FROM men),
sym AS MATERIALIZED (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed)"""
)
CLUSTERS_SQL = EDGES_SQL + "," + ALIASES


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.written(_ends(graph.entity_passage_edges(mentions_of_total(spark, sf_dir))), "edges")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("surface").alias("src"), F.col("passage").alias("dst"), "weight")


def _edges_and_mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges as of _edges, and the mentions they are made of, from one written table."""
    m = graph.written(mentions_of_total(spark, sf_dir), "mentions")
    return _ends(graph.entity_passage_edges(m)), m.drop("total")


def _seeds(edges: DataFrame) -> DataFrame:
    """Surfaces that begin with then or reth."""
    return edges.filter(F.col("src").rlike("^(then|reth)")).select(F.col("src").alias("node")).distinct()


ROUNDS = 8
_STEPS = "".join(
    f""", x{k + 1} AS MATERIALIZED (SELECT node, sum(s) AS s FROM (
  SELECT sh.dst AS node, 0.5 * sum(x.s * sh.share) AS s FROM x{k} x JOIN sh ON x.node = sh.src GROUP BY 1
  UNION ALL SELECT node, 0.5 * s FROM x0) GROUP BY 1)"""
    for k in range(ROUNDS)
)
PPR_SQL = (
    EDGES_SQL
    + """, sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM sym),
seed AS (SELECT DISTINCT src AS node FROM ed WHERE regexp_matches(src, '^(then|reth)')),
x0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM seed) AS s FROM seed)"""
    + _STEPS
)


def _ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return graph.pagerank(e, _seeds(e).withColumn("mass", F.lit(1.0)), 0.5, ROUNDS)


@R.add(PPR_SQL + f" SELECT node, round(s, 8) AS score FROM x{ROUNDS} WHERE round(s, 8) > 0 AND node LIKE 'passage-%'")
def ppr_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personalised PageRank of passages from seed surfaces, damping 0.5, eight rounds."""
    x = _ppr(spark, sf_dir)
    return x.filter(F.col("node").startswith("passage-")).select("node", F.round("score", 8).alias("score")).filter("score > 0")


@R.add(PPR_SQL + f" SELECT count(*) AS nodes, round(sum(s), 6) AS mass FROM x{ROUNDS}")
def ppr_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked mass sums to one."""
    return _ppr(spark, sf_dir).agg(F.count("*").alias("nodes"), F.round(F.sum("score"), 6).alias("mass"))


@R.add(
    CLUSTERS_SQL
    + """, q AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, w FROM (SELECT coalesce(cluster, src) AS x, dst AS y, w FROM ed LEFT JOIN cl ON surface = src))
SELECT src, dst, round(sum(w), 6) AS weight FROM q GROUP BY 1, 2"""
)
def ppr_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces contracted by alias clusters; weights of parallel edges add up."""
    e, m = _edges_and_mentions(spark, sf_dir)
    return graph.quotient(e, alias_clusters(spark, sf_dir, m)).select("src", "dst", F.round("weight", 6).alias("weight"))


_QSTEPS = "".join(
    f""", y{k + 1} AS MATERIALIZED (SELECT node, sum(s) AS s FROM (
  SELECT sh.dst AS node, 0.5 * sum(y.s * sh.share) AS s FROM y{k} y JOIN sh ON y.node = sh.src GROUP BY 1
  UNION ALL SELECT node, 0.5 * s FROM y0) GROUP BY 1)"""
    for k in range(ROUNDS)
)


@R.add(
    CLUSTERS_SQL
    + """, q AS MATERIALIZED (SELECT coalesce(cluster, src) AS src, dst, sum(w) AS w FROM ed LEFT JOIN cl ON surface = src GROUP BY 1, 2),
both_ AS (SELECT src, dst, w FROM q UNION ALL SELECT dst, src, w FROM q),
sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM both_),
seed AS (SELECT DISTINCT src AS node FROM ed WHERE regexp_matches(src, '^(then|reth)')),
y0 AS MATERIALIZED (SELECT coalesce(cluster, node) AS node, count(*) / (SELECT count(*) FROM seed) AS s FROM seed LEFT JOIN cl ON surface = node GROUP BY 1)"""
    + _QSTEPS
    + f""", m AS (SELECT DISTINCT src AS node, coalesce(cluster, src) AS super FROM ed LEFT JOIN cl ON surface = src UNION ALL SELECT DISTINCT dst, dst FROM ed)
SELECT m.node, round(s, 8) AS score FROM m JOIN y{ROUNDS} y ON y.node = m.super WHERE round(s, 8) > 0"""
)
def ppr_supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personalised PageRank on the graph of contracted surfaces; every member has the score of its super-node."""
    e, m = _edges_and_mentions(spark, sf_dir)
    x = graph.quotient_pagerank(e, alias_clusters(spark, sf_dir, m), _seeds(e).withColumn("mass", F.lit(1.0)), 0.5, ROUNDS)
    return x.select("node", F.round("score", 8).alias("score")).filter("score > 0")


@R.add(EDGES_SQL + " SELECT src AS surface, count(*) AS passages, round(sum(w), 6) AS degree FROM ed GROUP BY 1")
def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and summed weight of each surface."""
    return _edges(spark, sf_dir).groupBy(F.col("src").alias("surface")).agg(F.count("*").alias("passages"), F.round(F.sum("weight"), 6).alias("degree"))


@R.add(
    EDGES_SQL
    + """ SELECT src AS surface, dst AS passage, round(CASE WHEN df > 1 THEN w * pow(df, -0.5) ELSE w END, 6) AS weight
FROM ed JOIN (SELECT src, CAST(count(*) AS DOUBLE) AS df FROM ed GROUP BY 1) USING (src)"""
)
def hub_damped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge weights damped by the surface's number of passages."""
    e = _edges(spark, sf_dir)
    df = e.groupBy("src").agg(F.count("*").alias("df"))
    return e.join(df, "src").select(F.col("src").alias("surface"), F.col("dst").alias("passage"), F.round(hub_damping(F.col("weight"), F.col("df")), 6).alias("weight"))


@R.add(
    EDGES_SQL
    + """, h0 AS (SELECT DISTINCT src AS node FROM ed WHERE regexp_matches(src, '^(then|reth)')),
h1 AS (SELECT dst AS node, max(w) AS w FROM sym WHERE src IN (SELECT node FROM h0) AND dst NOT IN (SELECT node FROM h0) GROUP BY 1),
h2 AS (SELECT dst AS node, max(w) AS w FROM sym WHERE src IN (SELECT node FROM h1) AND dst NOT IN (SELECT node FROM h0) AND dst NOT IN (SELECT node FROM h1) GROUP BY 1)
SELECT node, 0 AS hop, NULL::DOUBLE AS weight FROM h0 UNION ALL SELECT node, 1, round(w, 6) FROM h1 UNION ALL SELECT node, 2, round(w, 6) FROM h2"""
)
def graph_bfs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from the seed surfaces."""
    e = _edges(spark, sf_dir)
    return graph.neighbourhood(e, _seeds(e), 2).select("node", "hop", F.round("weight", 6).alias("weight"))


@R.add(
    EDGES_SQL
    + """ SELECT 'surface' AS kind, count(DISTINCT src) AS n FROM ed UNION ALL SELECT 'passage', count(DISTINCT dst) FROM ed UNION ALL SELECT 'edge', count(*) FROM ed"""
)
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind."""
    e = _edges(spark, sf_dir)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(e.select("src").distinct(), "surface").unionByName(count(e.select("dst").distinct(), "passage")).unionByName(count(e, "edge"))


@R.add(
    EDGES_SQL
    + """, keep AS (SELECT src AS node FROM ed GROUP BY 1 HAVING count(*) BETWEEN 5 AND 20 UNION ALL SELECT dst FROM ed GROUP BY 1 HAVING count(*) > 20)
SELECT src, dst, round(w, 6) AS weight FROM ed WHERE src IN (SELECT node FROM keep) AND dst IN (SELECT node FROM keep)"""
)
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among middling surfaces and large passages."""
    e = _edges(spark, sf_dir)
    keep = e.groupBy(F.col("src").alias("node")).count().filter("count BETWEEN 5 AND 20").select("node")
    keep = keep.unionByName(e.groupBy(F.col("dst").alias("node")).count().filter("count > 20").select("node"))
    return graph.induced(e, keep).select("src", "dst", F.round("weight", 6).alias("weight"))


@R.add(
    EDGES_SQL
    + """, rare AS (SELECT src, min(dst) AS root FROM ed GROUP BY 1 HAVING count(*) BETWEEN 2 AND 2),
link AS MATERIALIZED (SELECT DISTINCT ed.dst AS a, root AS b FROM ed JOIN rare USING (src) WHERE ed.dst <> root),
both_ AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, other) AS (SELECT a, a FROM both_ UNION SELECT r.node, b.b FROM reach r JOIN both_ b ON r.other = b.a)
SELECT node, min(other) AS component FROM reach GROUP BY 1"""
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages linked by surfaces that stand in two passages only; the least name marks a component."""
    e = _edges(spark, sf_dir)
    rare = e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("root")).filter("n = 2")
    links = e.join(rare, "src").filter("dst <> root").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    return graph.components(links)


@R.add()
def surface_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages linked by any surface they share, however many passages it stands in: each hangs on the surface's least passage.

    It has no SQL counterpart: the recursion over all reachable pairs is too large. A test holds it against union-find.
    """
    e = _edges(spark, sf_dir)
    root = e.groupBy("src").agg(F.min("dst").alias("root"))
    return graph.components(e.join(root, "src").filter("dst <> root").select(F.col("dst").alias("src"), F.col("root").alias("dst")))


ROLL = """
WITH c AS (SELECT CAST(label AS VARCHAR) AS cluster, CAST(vec_id AS VARCHAR) AS node, CAST(vec_id % 17 AS DOUBLE) AS score FROM embeddings)
"""


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("node"), F.col("label").cast("string").alias("cluster"), (F.col("vec_id") % 17).cast("double").alias("score"))
    return e.select("node", "score"), e.select("node", "cluster")


@R.add(ROLL + "SELECT cluster, round(sum(score), 6) AS score FROM c GROUP BY 1")
def cluster_rollup_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of clusters as sums."""
    return graph.cluster_scores(*_clusters(spark, sf_dir), "sum").select("cluster", F.round("score", 6).alias("score"))


@R.add(ROLL + "SELECT cluster, round(max(score), 6) AS score FROM c GROUP BY 1")
def cluster_rollup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of clusters as maxima."""
    return graph.cluster_scores(*_clusters(spark, sf_dir), "max").select("cluster", F.round("score", 6).alias("score"))


@R.add(ROLL + "SELECT cluster, round(sum(score) / sqrt(count(*)), 6) AS score FROM c GROUP BY 1")
def cluster_rollup_normsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of clusters over the root of their size."""
    return graph.cluster_scores(*_clusters(spark, sf_dir), "normsum").select("cluster", F.round("score", 6).alias("score"))


CANON_SQL = """, canon AS (SELECT cluster, arg_min(node, (0.05 * length(node), -n, node)) AS canonical FROM cl JOIN al_s ON node = surface GROUP BY 1)"""


@R.add(CLUSTERS_SQL + CANON_SQL + " SELECT surface AS node, cluster, canonical FROM cl JOIN canon USING (cluster)")
def alias_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surface with an alias, its cluster as stored after two batches, and the cluster's canonical surface."""
    m = graph.written(mentions(spark, sf_dir), "mentions")
    labels = alias_clusters(spark, sf_dir, m)
    return labels.join(_canonical(m, labels), "node").select("node", "cluster", "canonical")


def _canonical(found: DataFrame, labels: DataFrame) -> DataFrame:
    s = found.groupBy(F.col("surface").alias("node")).agg(F.sum("n").alias("n"))
    return clusters.canonical(labels, s.withColumn("surface", F.col("node")))


@R.add(
    CLUSTERS_SQL
    + CANON_SQL
    + """, k AS (SELECT surface, canonical FROM cl JOIN canon USING (cluster))
SELECT coalesce(canonical, src) AS surface, dst AS passage, round(sum(w), 6) AS weight FROM ed LEFT JOIN k ON surface = src GROUP BY 1, 2"""
)
def alias_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the surfaces of a cluster moved to its canonical one."""
    e, m = _edges_and_mentions(spark, sf_dir)
    e = e.withColumnsRenamed({"src": "surface", "dst": "passage"})
    edges, _ = graph.collapse(e, _canonical(m, alias_clusters(spark, sf_dir, m)))
    return edges.select("surface", "passage", F.round("weight", 6).alias("weight"))


@R.add()
def alias_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leiden communities of the admitted alias edges: clusters that hang together by few edges come apart."""
    edges = graph.written(alias_edges(spark, sf_dir).filter("src < dst").withColumn("weight", F.lit(1.0)), "alias-edges")
    return clusters.leiden(edges, 0.2)


@R.add(
    CLUSTERS_SQL
    + """, s0 AS (SELECT DISTINCT src AS node FROM ed WHERE regexp_matches(src, '^(then|reth)')),
cn AS (SELECT surface AS node, cluster FROM cl),
sz AS (SELECT cluster, count(*) AS size FROM cl GROUP BY 1),
o AS (SELECT s0.node AS seed, o.node, 1.0 / sqrt(size) AS sim, row_number() OVER (PARTITION BY s0.node ORDER BY o.node) AS k
  FROM s0 JOIN cn a ON a.node = s0.node JOIN sz ON sz.cluster = a.cluster JOIN cn o ON o.cluster = a.cluster WHERE o.node NOT IN (SELECT node FROM s0))
SELECT node, 1.0 AS sim FROM s0 UNION ALL SELECT node, round(max(sim), 6) FROM o WHERE k <= 50 GROUP BY 1"""
)
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds and siblings of their clusters at a lower weight."""
    e, m = _edges_and_mentions(spark, sf_dir)
    return graph.seed_spread(_seeds(e).withColumn("sim", F.lit(1.0)), alias_clusters(spark, sf_dir, m)).select("node", F.round("sim", 6).alias("sim"))


@R.add(
    EDGES_SQL
    + """, t AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS rank FROM ed)
SELECT src AS surface, dst AS passage, rank FROM t WHERE rank <= 3"""
)
def entity_top_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest passages of each surface."""
    from folioscope.operators.order import top_per_group

    e = _edges(spark, sf_dir)
    top = top_per_group(e, ["src"], [F.round("weight", 9).desc(), F.asc("dst")], 3)
    return top.select(F.col("src").alias("surface"), F.col("dst").alias("passage"), "rank")


QUERIES, ORACLES = R.queries, R.oracles
