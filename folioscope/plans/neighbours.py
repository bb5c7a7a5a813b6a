"""Queries over neighbours of vectors: an index of cells, and the admission of alias edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import alias, search, vector_graph, vector_index
from folioscope.plans.base import Registry, table

R = Registry()
#: Neighbours looked for, least similarity, steepest drop and least overlap of alias edges over the given vectors.
NEAREST, FLOOR, DROP, OVERLAP = 20, 0.1, 0.3, 0.2


def _indexed(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 100 = 0"), vector_index.build(e, "vec_id", "embedding", k=k)


@R.add()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each probe that the index finds; every row is indexed. Recall is that of ann_recall."""
    probes, index = _indexed(spark, sf_dir, 10)
    return vector_index.nearest(index, probes, 10).select("probe", "vec_id", "score", "rank")


@R.add("SELECT count(DISTINCT p.vec_id) AS probes, CAST(count(DISTINCT p.vec_id) * 10 AS BIGINT) AS wanted, true AS reached FROM embeddings p WHERE vec_id % 100 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of the neighbours that an exact scan finds for every probe."""
    probes, index = _indexed(spark, sf_dir, 10)
    exact = search.dense(table(spark, sf_dir, "embeddings"), probes, "vec_id", "embedding", 10)
    got = vector_index.recall_of(vector_index.nearest(index, probes, 10), exact, "vec_id")
    return got.crossJoin(probes.agg(F.count("*").alias("probes"))).select("probes", F.col("n").alias("wanted"), (F.col("hits") >= 0.9 * F.col("n")).alias("reached"))


@R.add()
def graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each probe that walks over the proximity graphs find. Recall is that of graph_recall."""
    e = table(spark, sf_dir, "embeddings")
    return vector_graph.nearest(vector_graph.build(e, "vec_id", "embedding", k=10), e.filter("vec_id % 100 = 0"), 10).select("probe", "vec_id", "score", "rank")


@R.add("SELECT count(DISTINCT p.vec_id) AS probes, CAST(count(DISTINCT p.vec_id) * 10 AS BIGINT) AS wanted, true AS reached, true AS fewer FROM embeddings p WHERE vec_id % 100 = 0")
def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the walks find nine tenths of the exact neighbours, and compare less than half of what a scan does."""
    e = table(spark, sf_dir, "embeddings")
    probes, index = e.filter("vec_id % 100 = 0"), vector_graph.build(e, "vec_id", "embedding", k=10)
    done = vector_graph.walked(index, probes, 10)
    got = vector_index.recall_of(vector_graph.nearest_of(index, done, 10), search.dense(e, probes, "vec_id", "embedding", 10), "vec_id")
    whole = got.crossJoin(probes.agg(F.count("*").alias("probes"))).crossJoin(vector_graph.share_of(index, done))
    return whole.select("probes", F.col("n").alias("wanted"), (F.col("hits") >= 0.9 * F.col("n")).alias("reached"), (2 * F.col("compared") < F.col("of")).alias("fewer"))


@R.add(
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS probe, b.vec_id, round(list_inner_product(b.v, a.v), 6) AS score FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {NEAREST}),
f AS (SELECT *, lag(score) OVER (PARTITION BY probe ORDER BY rank) AS prev FROM r WHERE score >= {FLOOR}),
c AS (SELECT *, max(CASE WHEN (prev - score) / prev > {DROP} THEN 1 ELSE 0 END) OVER (PARTITION BY probe ORDER BY rank) AS cut FROM f),
g AS (SELECT probe, vec_id, score FROM c WHERE cut = 0),
m AS (SELECT a.probe AS src, a.vec_id AS dst, a.score FROM g a JOIN g b ON a.probe = b.vec_id AND a.vec_id = b.probe WHERE a.probe % 100 = 0),
t AS (SELECT vec_id AS node, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM embeddings JOIN part ON p_partkey = vec_id),
i AS (SELECT w, ln(((SELECT count(DISTINCT node) FROM t) + 1) / (count(*) + 0.5)) AS idf FROM t GROUP BY 1),
u AS (SELECT src, dst, w, count(*) AS k FROM (SELECT src, dst, w FROM m JOIN t ON node = src UNION ALL SELECT src, dst, w FROM m JOIN t ON node = dst) GROUP BY ALL),
o AS (SELECT src, dst, round(coalesce(sum(idf) FILTER (k = 2), 0) / sum(idf), 6) AS overlap FROM u JOIN i USING (w) GROUP BY ALL),
x AS (SELECT m.*, overlap FROM m JOIN o USING (src, dst) WHERE overlap >= {OVERLAP}
  AND NOT EXISTS (SELECT 1 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey = src AND b.l_partkey = dst)),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM x)
SELECT src, dst, score AS weight, overlap FROM k WHERE n <= 5"""
)
def alias_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias edges of every hundredth vector, named by the part of its id; parts of one order are two things."""
    e = table(spark, sf_dir, "embeddings")
    find = lambda probes: search.dense(e, probes, "vec_id", "embedding", NEAREST)
    pairs = alias.mutual_neighbours(find, e, e.filter("vec_id % 100 = 0"), "vec_id", FLOOR, DROP)
    names = e.select(F.col("vec_id").alias("p_partkey")).join(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("surface"))
    places = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_partkey").alias("node"))
    return alias.admitted(pairs, names, places, OVERLAP).select("src", "dst", "weight", "overlap")


QUERIES, ORACLES = R.queries, R.oracles
