"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import plugins, vectors
from folioscope.sources import readers, writers
from folioscope.streaming import events as E


def test_page_assets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"page_id": "p_0001", "file_id": "f", "text": "old", "quality_flags": {"has_table": True}}, {"file_id": "f", "text": "no id"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "p_0001", "file_id": "f", "text_markdown": "new"}, {"page_id": "p_0002", "file_id": "g"}]))
    (tmp_path / "c.json").write_text("not json")
    pages = readers.page_assets(spark, str(tmp_path))
    got = {(r.file_id, r.page_id): r.text_markdown for r in pages.collect()}
    assert got == {("f", "p_0001"): "new", ("g", "p_0002"): None}
    assert readers.find_page(pages, "f/p_0001").count() == 1 and readers.find_page(pages, "p_0002").count() == 1


def test_corpus_and_texts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"idx": 7, "title": "t", "text": "", "paragraph_text": "p"}, {"idx": "X y", "title": "u"}]))
    got = {r.file_id: r.text for r in readers.corpus_items(spark, str(tmp_path / "c.json"), "set").collect()}
    assert got == {"set_000007": "p", "set_x-y": ""}
    d = tmp_path / "txt"
    d.mkdir()
    for n, t in (("001.txt", "a"), ("002_3.txt", "b"), ("note.txt", "c")):
        (d / n).write_text(t)
    assert sorted((r.number, r.part, r.text) for r in readers.numbered_texts(spark, str(d)).collect()) == [(1, None, "a"), (2, 3, "b")]
    files = spark.createDataFrame([("f", 120), ("e", 0)], "file_id string, n_pages int")
    assert [(r["first"], r["last"]) for r in readers.batch_ranges(files).orderBy("first").collect()] == [(1, 50), (51, 100), (101, 120)]


def test_json_lines_and_tsv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    rows = readers.json_lines(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("a", T.IntegerType())])).collect()
    assert sorted((r.a is None, r._corrupt_record) for r in rows) == [(False, None), (True, "broken")]
    writers.write_tsv(spark.createDataFrame([("a\tb\n", 1)], "x string, n int"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).filter(F.col("value") != "x\tn").first().value == "a b\t1"


def test_snapshots(spark, tmp_path):
    s = writers.Snapshots(spark, f"file://{tmp_path}/snap")
    assert s.load("v1") is None
    s.save(spark.range(3).toDF("id"), "v1", 3)
    s.save(spark.range(5).toDF("id"), "v1", 5)
    assert s.load("v1", 5).count() == 5 and s.load("v1", 4) is None and s.load("v2", 5) is None


def test_markdown_and_manifest(spark):
    b = spark.createDataFrame([("f", 2, "two"), ("f", 1, "one")], "file_id string, pos int, text string")
    assert writers.combined_markdown(b).first().text == f"one\n\n{writers.PAGE_MARKER}\n\ntwo"
    assert {r.name: r.n for r in writers.manifest({"a": b, "b": b.limit(1)}).collect()} == {"a": 2, "b": 1}


def test_plugins(spark):
    df = spark.createDataFrame([("apex plan", "the apex plan"), ("zenith", None)], "q string, t string")
    got = df.select(plugins.reranker()("q", "t").alias("s"), vectors.cosine(plugins.embedder()("q"), plugins.embedder()("q")).alias("c")).collect()
    assert [r.s for r in got] == [1.0, 0.0] and all(abs(r.c - 1) < 1e-9 for r in got)
    long = spark.createDataFrame([("end", "x " * 4000 + "end")], "q string, t string")
    assert long.select(plugins.reranker()("q", "t"), plugins.reranker(length=None)("q", "t")).first()[:] == (0.0, 1.0)


def test_streams(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "x"), ("r", "2024-01-01 00:01:00", "y"), ("r", "2024-01-01 00:02:00", "x"), ("s", "2024-01-01 00:03:00", "x")]
    df = spark.createDataFrame(rows, "run string, t string, item string").select("run", F.to_timestamp("t").alias("ts"), "item")
    for i, r in enumerate(df.orderBy("ts").collect()):
        spark.createDataFrame([r], df.schema).write.mode("append").parquet(f"{tmp_path}/in")
    E.run_to_end(E.novelty(E.read_events(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 4 and sum(r.is_new for r in got) == 3

    steps = [("f", "2024-01-01 00:00:00", "parsing"), ("f", "2024-01-01 00:01:00", "ready"), ("f", "2024-01-01 00:02:00", "indexing")]
    s = spark.createDataFrame(steps, "file_id string, t string, status string").select("file_id", F.to_timestamp("t").alias("ts"), "status")
    s.coalesce(1).write.parquet(f"{tmp_path}/in2")
    E.run_to_end(E.status_changes(E.read_events(spark, f"{tmp_path}/in2", s.schema)), f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert {r.status_to: r.allowed for r in spark.read.parquet(f"{tmp_path}/out2").collect()} == {"parsing": True, "ready": False, "indexing": True}
    lost = spark.createDataFrame([("parsing", None), ("ready", None)], "status string, error_msg string")
    assert {r.status: r.error_msg for r in E.reconcile(lost).collect()} == {"failed": "interrupted", "ready": None}


def test_order_of_steps_does_not_depend_on_the_batch_size(spark, tmp_path):
    """Steps of one file in reverse, in parts of two rows: all are allowed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    steps = [("f", 3, "ready"), ("f", 2, "indexing"), ("f", 1, "parsing")]
    s = spark.createDataFrame(steps, "file_id string, t int, status string").select("file_id", F.timestamp_seconds("t").alias("ts"), "status")
    s.coalesce(1).write.parquet(f"{tmp_path}/in")
    try:
        for n in ("2", "1"):
            spark.conf.set(key, n)
            E.run_to_end(E.status_changes(E.read_events(spark, f"{tmp_path}/in", s.schema)), f"{tmp_path}/out{n}", f"{tmp_path}/state{n}")
            assert {r.status_to: r.allowed for r in spark.read.parquet(f"{tmp_path}/out{n}").collect()} == {"parsing": True, "indexing": True, "ready": True}
    finally:
        spark.conf.set(key, before)


def test_marks_of_items_end_by_timers(spark, tmp_path):
    """A day is kept: the state holds the items of the last day, and one that comes back later is new again."""
    import os
    from datetime import timedelta

    hour, base = 3600, 400_000
    steps = [(0, "a"), (1, "b"), (20, "a"), (50, "c"), (90, "a"), (91, "a"), (130, "d"), (200, "d")]
    s = spark.createDataFrame([("r", (base + h) * hour, x) for h, x in steps], "run string, t int, item string").select("run", F.timestamp_seconds("t").alias("ts"), "item")
    for k, r in enumerate(s.collect()):  # a stream takes files in order of their times
        spark.createDataFrame([r], s.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for name in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = E.novelty(E.read_events(spark, f"{tmp_path}/in/*", s.schema), timedelta(days=1))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.h - base, r.item, r.is_new) for r in spark.read.parquet(f"{tmp_path}/out").select((F.unix_seconds("ts") / hour).cast("int").alias("h"), "item", "is_new").orderBy("ts").collect()]
    assert got == [(0, "a", True), (1, "b", True), (20, "a", False), (50, "c", True), (90, "a", True), (91, "a", False), (130, "d", True), (200, "d", True)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 2 and held[-1] <= 1


def test_sql_functions(spark):
    from folioscope.functions import sql

    sql.register(spark)
    rows = spark.sql("SELECT * FROM table_rows('<table><tr><th>H</th></tr><tr><td>a &amp; b</td></tr></table>')").collect()
    assert [(r.table_no, r.row_no, r.text, r.is_header) for r in rows] == [(1, 1, "H", True), (1, 2, "a & b", False)]
    got = spark.sql("SELECT page_number_of('p_0007') AS a, page_number_of('x') AS b, dot_product(array(1f, 2f), array(3f, 4f)) AS c, one_line('a\tb') AS d").first()
    assert (got.a, got.b, got.c, got.d) == (7, None, 11.0, "a b")


def test_running_ids(spark):
    from folioscope.operators.export import running_ids

    df = spark.createDataFrame([(x,) for x in "qwertyuiopasdfgh"], "x string").repartition(5)
    got = {r.x: r.k for r in running_ids(df, [F.col("x")], "k", "k_%03d").collect()}
    assert got == {x: f"k_{i + 1:03d}" for i, x in enumerate(sorted("qwertyuiopasdfgh"))}
