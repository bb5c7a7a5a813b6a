"""Registration of queries with their DuckDB counterparts, and shared table views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import alias
from folioscope.operators.clusters import ClusterStore
from folioscope.operators.graph import shared_path, written

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its own name."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of files: file_id, page, passage (content hash), text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("file_id"), F.col("doc_id").alias("page"), X.content_hash(F.col("text")).alias("passage"), "text")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, pos, sentence."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


#: The same sentences in DuckDB.
SENTENCES = r"""
sent AS (
  SELECT doc_id, source, CAST(pos - 1 AS INTEGER) AS pos, pieces[pos] AS sentence FROM (
    SELECT doc_id, source, pieces, unnest(range(1, len(pieces) + 1)) AS pos FROM (
      SELECT doc_id, source, list_filter(list_transform(string_split(
          regexp_replace(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n\n+', chr(1), 'g'), chr(1)),
          lambda x: regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda x: length(x) >= 20) AS pieces
      FROM documents)))
"""

#: Passages and their surfaces in DuckDB.
MENTIONS = r"""
pas AS (SELECT 'passage-' || md5(text) AS passage, any_value(text) AS text FROM documents GROUP BY 1),
men AS (
  SELECT passage, surface, count(*) AS n FROM (
    SELECT passage, lower(unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM pas) GROUP BY ALL)
"""


#: Alias clusters of surfaces in DuckDB, after MENTIONS; its statement has to be WITH RECURSIVE.
ALIASES = r"""
al_s AS MATERIALIZED (SELECT surface AS node, sum(n) AS n FROM men GROUP BY 1),
al_c AS MATERIALIZED (SELECT node, n, i, substr(node, 1, i - 1) || substr(node, i + 1) AS cut FROM (SELECT node, n, unnest(range(1, length(node) + 1)) AS i FROM al_s)),
al_p AS MATERIALIZED (
  SELECT a.node AS src, b.node AS dst, b.n FROM al_c a JOIN al_c b ON a.cut = b.cut AND a.i = b.i AND a.node <> b.node
  UNION SELECT a.node, b.node, b.n FROM al_c a JOIN al_s b ON a.cut = b.node
  UNION SELECT b.node, a.node, a.n FROM al_c a JOIN al_s b ON a.cut = b.node),
al_t AS MATERIALIZED (SELECT src, dst FROM al_p QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 3),
al_e AS MATERIALIZED (SELECT a.src, a.dst FROM al_t a JOIN al_t b ON a.src = b.dst AND a.dst = b.src
  WHERE NOT EXISTS (SELECT 1 FROM men x JOIN men y USING (passage) WHERE x.surface = a.src AND y.surface = a.dst)),
al_r(node, root) AS (SELECT DISTINCT src, src FROM al_e UNION SELECT e.dst, r.root FROM al_r r JOIN al_e e ON e.src = r.node),
cl AS MATERIALIZED (SELECT node AS surface, min(root) AS cluster FROM al_r GROUP BY 1)
"""


def mentions_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage, surface, n, total: counts of surfaces in distinct passages, and of all surfaces of the passage.

    Surfaces are found before copies meet, so what is shuffled is a line of surfaces, which hold no blanks, and no text.
    """
    s = passages(spark, sf_dir).select("passage", X.surfaces(F.col("text")).alias("s")).filter(F.size("s") > 0)
    p = s.select("passage", F.array_join("s", " ").alias("line")).groupBy("passage").agg(F.first("line").alias("line"))
    words = p.select("passage", F.split("line", " ").alias("s")).select("passage", F.size("s").alias("total"), F.explode("s").alias("surface"))
    return words.groupBy("passage", "surface").agg(F.count("*").alias("n"), F.first("total").cast("bigint").alias("total"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage, surface, n: counts of surfaces in distinct passages."""
    return mentions_of_total(spark, sf_dir).drop("total")


_LABELS: dict[tuple[str, str], ClusterStore] = {}


def alias_edges(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """src, dst, both ways: admitted aliases among the surfaces of all passages; found are written mentions, if there are any."""
    return alias.spelling_aliases(written(mentions(spark, sf_dir), "mentions") if found is None else found)


def alias_clusters(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """node, cluster: surfaces that have an alias, from a store that an application fills once, in two batches."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LABELS:
        edges = written(alias_edges(spark, sf_dir, found).filter("src < dst"), "alias-edges")
        store = ClusterStore(spark, shared_path(spark, "alias-clusters"))
        second = F.pmod(F.xxhash64("src", "dst"), F.lit(4)) == 0
        store.merge(edges.filter(~second), "first")
        store.merge(edges.filter(second), "second")
        _LABELS[key] = store
    return _LABELS[key].labels()
