"""Event queries: windows, sessions, novelty and stream runs over the events table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import graph, order
from folioscope.plans.base import Registry, table
from folioscope.streaming import events as E

R = Registry()


@R.add("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums by type."""
    return E.windowed(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@R.add(
    """WITH e AS (SELECT event_type, value, time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k AS start FROM events, range(0, 4) r(k))
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL"""
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over an hour, every 15 minutes."""
    return E.windowed(table(spark, sf_dir, "events"), "1 hour", "15 minutes").withColumn("total", F.round("total", 4))


@R.add(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of less than half an hour."""
    return E.sessions(table(spark, sf_dir, "events"), "30 minutes")


@R.add(
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL),
c AS (SELECT e.user_id, e.event_id, CASE WHEN f.event_id IS NULL THEN 0 ELSE 1 END AS n_new FROM events e LEFT JOIN f ON f.event_id = e.event_id)
SELECT user_id, event_id, n_new, max(n_new) OVER w < 1 AND count(*) OVER w = 3 AS stuck FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
)
def novelty_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last three events brought no new type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(1).alias("n_new"))
    steps = e.join(first, "event_id", "left").select("user_id", "event_id", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return order.novelty_guard(steps, "user_id", "event_id", 3, 0)


@R.add("SELECT event_type, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n FROM events GROUP BY 1")
def last_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("n"))


@R.add("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the table that runs to its end; equal to the batch result."""
    batch = table(spark, sf_dir, "events")
    stamp = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))  # noqa: E731  watermarks need a time zone
    source = stamp(spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*"))
    out, state = graph.shared_path(spark, "stream-out"), graph.shared_path(spark, "stream-state")
    shape = E.windowed(stamp(batch), "1 day").schema

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{epoch}")

    # Complete mode hands on the whole table of counts each time; the last one stands.
    q = E.windowed(source, "1 day").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress if p["numInputRows"]), default=None)
    if last is None:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{out}/{last}").withColumn("total", F.round("total", 4))


@R.add("SELECT json_extract_string(props, '$.' || k) IS NOT NULL AS has, k, count(*) AS n FROM events, (SELECT unnest(['page', 'ref']) AS k) GROUP BY ALL")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often properties stand in the JSON text."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get_json_object("props", f"$.{k}").isNotNull().alias("has")) for k in ("page", "ref")]))
    return table(spark, sf_dir, "events").select(keys.alias("x")).groupBy("x.has", "x.k").agg(F.count("*").alias("n"))


def _ended(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    """What a stream over the events gives until it ends, written and read back."""
    batch = table(spark, sf_dir, "events")
    stamp = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    out = graph.shared_path(spark, "stream-rows")
    found = f(stamp(spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")))
    E.run_to_end(found, out, graph.shared_path(spark, "stream-marks"))
    return spark.read.schema(found.schema).parquet(out)


@R.add(
    """SELECT CAST(user_id AS VARCHAR) AS run, event_type AS item, epoch_us(ts) AS ts_us,
coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) > 21600000000, true) AS is_new FROM events"""
)
def stream_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events, which are of a type that the user had none of for six hours; the state outlives batches and ends by timers."""
    source = lambda e: e.select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("item"), "ts")
    found = _ended(spark, sf_dir, lambda e: E.novelty(source(e), timedelta(hours=6)))
    return found.select("run", "item", F.unix_micros("ts").alias("ts_us"), "is_new")


@R.add("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type that a stream appends where a row like one before, by user, type and value, is left out; the watermark spans the log."""
    keyed = lambda e: e.withColumn("key", F.concat_ws(":", "user_id", "event_type", F.coalesce(F.col("value").cast("string"), F.lit("null"))))
    found = _ended(spark, sf_dir, lambda e: E.first_seen(keyed(e).select("key", "event_type", "ts"), "key", "3650 days"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"))


@R.add(
    """SELECT consumer, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES ('early'), ('late')) c(consumer) GROUP BY ALL"""
)
def stream_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consumers of one log with a place of their own each: one reads after each of four parts, one joins after the third and replays it."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    log, runs = graph.shared_path(spark, "log"), graph.shared_path(spark, "consumers")

    def read(consumer: str) -> None:
        E.run_to_end(E.read_events(spark, f"{log}/*", e.schema), f"{runs}/out/{consumer}", f"{runs}/place/{consumer}")

    for part in range(4):
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).write.parquet(f"{log}/{part}")
        read("early")
        if part >= 2:
            read("late")
    both = [spark.read.schema(e.schema).parquet(f"{runs}/out/{c}").withColumn("consumer", F.lit(c)) for c in ("early", "late")]
    return both[0].unionByName(both[1]).groupBy("consumer", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: What an event type stands for where users are read as files.
STATUS_OF = {"signup": "pending", "view": "parsing", "click": "indexing", "purchase": "ready", "error": "failed"}


@R.add(
    "WITH RECURSIVE m AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in STATUS_OF.items())
    + ") AS t(event_type, status)), ok AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, to in E.NEXT_STATUS.items() for b in to)
    + """) AS t(a, b)),
e AS (SELECT user_id, status, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, status) AS k FROM events JOIN m USING (event_type)),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS ts_us, '' AS status_from, '' AS status_to, false AS allowed, 'pending' AS now FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT w.user_id, e.k, e.ts_us, w.now, e.status, ok.a IS NOT NULL, CASE WHEN ok.a IS NOT NULL THEN e.status ELSE w.now END
FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1 LEFT JOIN ok ON ok.a = w.now AND ok.b = e.status)
SELECT CAST(user_id AS VARCHAR) AS file_id, ts_us, status_from, status_to, allowed FROM w WHERE k > 0"""
)
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a state machine for each user, whose event types stand for statuses."""
    kinds = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    found = _ended(spark, sf_dir, lambda e: E.status_changes(e.select(F.col("user_id").cast("string").alias("file_id"), "ts", kinds[F.col("event_type")].alias("status"))))
    return found.select("file_id", F.unix_micros("ts").alias("ts_us"), "status_from", "status_to", "allowed")


QUERIES, ORACLES = R.queries, R.oracles
