"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import relational as rel
from folioscope.plans.base import Registry, table

R = Registry()


def _revenue():
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")


@R.add(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by flag and status of what was shipped by a date."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n")
    )


@R.add(
    """SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, grouping(r_name) + grouping(n_name) AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def relational_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by region and nation with subtotals. Regions and nations are fixed tables of 30 rows."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), (F.grouping("r_name") + F.grouping("n_name")).alias("level"))
    return out.withColumn("level", F.col("level").cast("bigint"))


@R.add(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def relational_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority in every combination."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add(
    """SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())"""
)
def relational_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, by user bucket, and in all."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"))
    return e.groupingSets([["event_type"], ["bucket"], []], "event_type", "bucket").agg(F.count("*").alias("n"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def relational_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a large order."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def relational_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a very large order."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@R.add(
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"""
)
def relational_topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    from folioscope.operators.order import top_per_group

    return top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@R.add(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"""
)
def relational_local_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of suppliers from customers of their own nation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", _revenue())
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = li.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").filter("s_nationkey = c_nationkey")
    return j.groupBy("s_nationkey").agg(F.sum("revenue").alias("r")).join(n, "s_nationkey").groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@R.add(
    """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def relational_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished and with urgent orders."""
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@R.add("SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def relational_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference of nation keys."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return s.exceptAll(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")))


@R.add(
    """SELECT event_id, lag(value) OVER w AS before, ntile(4) OVER w AS part, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3,
round(percent_rank() OVER w, 6) AS pr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def relational_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag, quartile, moving mean and rank share of each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lag("value").over(w).alias("before"),
        F.ntile(4).over(w).cast("bigint").alias("part"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"),
        F.round(F.percent_rank().over(w), 6).alias("pr"),
    )


@R.add(
    """SELECT e.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS matched FROM events e
LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'view' GROUP BY 1"""
)
def relational_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the user at each view."""
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'view'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("matched"))
    return rel.as_of(left, right, "user_id", "ts", ["matched"]).select("event_id", "matched")


@R.add(
    """WITH s AS (SELECT source, min(doc_id) AS a, max(doc_id) AS b, lang FROM documents GROUP BY source, lang)
SELECT d.source, d.doc_id, count(*) AS n FROM documents d JOIN s ON s.source = d.source AND d.doc_id BETWEEN s.a AND s.b GROUP BY ALL"""
)
def section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many language spans of its file each page stands in."""
    d = table(spark, sf_dir, "documents")
    spans = d.groupBy("source", "lang").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).drop("lang")
    n = rel.range_join(d.select("source", "doc_id"), spans, "source", "doc_id", "a", "b", 100_000)
    return n.groupBy("source", "doc_id").agg(F.count("*").alias("n"))


@R.add(
    """SELECT p_brand, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def relational_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by brand, hot parts dealt over salts."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", _revenue())
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rel.salted_join(li, p, "l_partkey").groupBy("p_brand").agg(F.count("*").alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"))


@R.add(
    """SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS view, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase FROM events GROUP BY 1"""
)
def relational_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by two types."""
    p = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "purchase"]).agg(F.count("event_id"))
    return p.select("user_id", F.coalesce("view", F.lit(0)).alias("view"), F.coalesce("purchase", F.lit(0)).alias("purchase"))


@R.add("SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, median(p_retailprice) AS mid FROM part GROUP BY 1")
def relational_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and median aggregates."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes"), F.percentile("p_retailprice", 0.5).alias("mid"))


QUERIES, ORACLES = R.queries, R.oracles
