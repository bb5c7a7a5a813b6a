"""Evidence tables and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import sql
from folioscope.operators import export
from folioscope.operators.graph import written
from folioscope.plans.base import SENTENCES, Registry, table

R = Registry()

TABLES_SQL = (
    "WITH "
    + SENTENCES
    + r""", dd AS (SELECT source, printf('d_%04d', row_number() OVER (ORDER BY source)) AS doc, count(*) AS n_pages FROM documents GROUP BY source),
pp AS (SELECT doc_id AS page, source, printf('p_%06d', row_number() OVER (ORDER BY source, doc_id)) AS passage_id, sha256(text) AS sha256 FROM documents),
ss AS (SELECT printf('s_%06d', row_number() OVER (ORDER BY passage_id, pos)) AS sentence_id, passage_id, pos, sentence FROM sent JOIN pp ON pp.page = sent.doc_id),
mm AS (SELECT sentence_id, passage_id, lower(w[i]) AS surface_norm, i FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT sentence_id, passage_id, regexp_extract_all(sentence, '\p{Lu}\p{Ll}{3,}') AS w FROM ss))),
sf AS (SELECT printf('sf_%06d', row_number() OVER (ORDER BY surface_norm)) AS surface_id, surface_norm, count(*) AS mention_count FROM mm GROUP BY surface_norm)
"""
)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return export.evidence_tables(table(spark, sf_dir, "documents"))


@R.add(TABLES_SQL + "SELECT passage_id, doc AS doc_id, page, sha256 FROM pp JOIN dd USING (source)")
def evidence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with running ids."""
    return _tables(spark, sf_dir)["passages"]


@R.add(TABLES_SQL + "SELECT sentence_id, passage_id, CAST(pos AS INTEGER) AS sentence_order FROM ss")
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with running ids and their passages."""
    return _tables(spark, sf_dir)["sentence_passage"]


@R.add(TABLES_SQL + "SELECT surface_id, surface_norm, mention_count FROM sf")
def evidence_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces numbered by name."""
    return _tables(spark, sf_dir)["surfaces"]


@R.add(TABLES_SQL + "SELECT printf('m_%07d', row_number() OVER (ORDER BY sentence_id, i)) AS mention_id, surface_id, sentence_id FROM mm JOIN sf USING (surface_norm)")
def evidence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions numbered by sentence and place."""
    return _tables(spark, sf_dir)["mentions"].select("mention_id", "surface_id", "sentence_id")


@R.add(TABLES_SQL + "SELECT surface_id, passage_id, count(*) AS mention_count, round(count(*) / sum(count(*)) OVER (PARTITION BY passage_id), 6) AS weight_in_passage FROM mm JOIN sf USING (surface_norm) GROUP BY 1, 2")
def evidence_surface_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from surfaces to passages."""
    return _tables(spark, sf_dir)["surface_passage"].select("surface_id", "passage_id", "mention_count", "weight_in_passage")


@R.add(r"SELECT source, 'passage-' || md5(text) AS h, md5(trim(regexp_replace(text, '[\t\r\n]+', ' ', 'g'))) AS t FROM documents")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions over a view."""
    sql.register(spark)
    sql.views(spark, sf_dir, ["documents"])
    return spark.sql("SELECT source, content_hash(text) AS h, md5(one_line(text)) AS t FROM documents")


@R.add("SELECT l_returnflag, l_linestatus, round(max_l + ln(s), 6) AS lse FROM (SELECT l_returnflag, l_linestatus, any_value(m) AS max_l, sum(exp(l_quantity / 7 - m)) AS s FROM (SELECT *, max(l_quantity / 7) OVER (PARTITION BY l_returnflag, l_linestatus) AS m FROM lineitem) GROUP BY ALL)")
def sql_log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate registered for SQL, over a few groups that hold all rows: parts by salt first, then their merge."""
    sql.register(spark)
    table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", "l_orderkey", "CAST(l_quantity AS DOUBLE) / 7 AS x").createOrReplaceTempView("salted_items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = sql.MERGED.format(key="l_returnflag, l_linestatus", name="log_sum_exp", value="x", table="salted_items", salt="l_orderkey", parts=parts)
    return spark.sql(f"SELECT l_returnflag, l_linestatus, round(log_sum_exp, 6) AS lse FROM ({merged})")


@R.add(
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)
SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no FROM g"""
)
def sql_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function with a table argument, whose result type and order follow from its input: session numbers of events."""
    sql.register(spark)
    sql.views(spark, sf_dir, ["events"])
    return spark.sql("SELECT event_id, user_id, session_no FROM gap_sessions(TABLE(SELECT event_id, user_id, ts FROM events), 'user_id', 'ts', 1800D)")


@R.add("SELECT event_type, date_trunc('month', ts)::DATE AS month, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY ALL")
def sketch_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by type and month from stored sketches of days: they are merged without the events, and lie within a twentieth of the exact count."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = e.groupBy("event_type", "day").agg(F.hll_sketch_agg("user_id", F.lit(14)).alias("users"))
    stored = written(daily, "daily-sketches")
    month = F.trunc("day", "month").alias("month")
    merged = stored.groupBy("event_type", month).agg(F.count("*").alias("days"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("about"))
    exact = e.groupBy("event_type", month).agg(F.count_distinct("user_id").alias("users"))
    return merged.join(exact, ["event_type", "month"]).select("event_type", "month", "days", "users", (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("near"))


QUERIES, ORACLES = R.queries, R.oracles
