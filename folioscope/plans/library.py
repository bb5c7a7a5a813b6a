"""Queries over sources and sinks (written, then read back), alias edges, views and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import vectors
from folioscope.operators import evidence, graph, search, structure
from folioscope.plans.base import Registry, table
from folioscope.sources import readers, writers
from folioscope.streaming import events as E

R = Registry()
#: Items of one JSON list.
LIST_ITEMS = 500


def json_lists(rows: DataFrame, key: str, path: str) -> None:
    """Writes rows as files that each hold one JSON list of bounded length."""
    cols = [c for c in rows.columns if c != "_list"]
    listed = rows.groupBy(F.floor(F.col(key) / LIST_ITEMS).alias("_list")).agg(F.to_json(F.collect_list(F.struct(*cols))).alias("value"))
    listed.write.partitionBy("_list").text(path)


@R.add(
    """SELECT 'set_' || CASE WHEN doc_id % 4 = 0 THEN 'item-' || doc_id || '-' ELSE printf('%06d', doc_id) END AS file_id, source AS title, md5(text) AS text
FROM documents WHERE text <> ''"""
)
def corpus_item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus items written as JSON lists, their texts in one of three fields, and read back."""
    d = table(spark, sf_dir, "documents").filter("text <> ''")
    field = lambda k, name: F.when(F.col("doc_id") % 3 == k, F.col("text")).otherwise(F.lit("")).alias(name)
    idx = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Item "), "doc_id", F.lit("!"))).otherwise(F.col("doc_id").cast("string"))
    path = graph.shared_path(spark, "corpus-items")
    json_lists(d.select("doc_id", idx.alias("idx"), F.col("source").alias("title"), field(0, "text"), field(1, "paragraph_text"), field(2, "passage")), "doc_id", path)
    return readers.corpus_items(spark, path, "set").withColumn("text", F.md5("text"))


@R.add(
    """SELECT DISTINCT 'c' || conv_id AS title, md5(text || ' ' || role) AS text FROM conversations WHERE text IS NOT NULL AND conv_id % 2 = 0
UNION SELECT DISTINCT 'c' || conv_id, md5(text) FROM conversations WHERE length(trim(text)) > 0 AND conv_id % 2 = 1"""
)
def qa_paragraph_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of questions in list form and in paragraph form."""
    c = table(spark, sf_dir, "conversations")
    context = F.when(F.col("conv_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), F.array("text", "role").alias("sentences"))))
    paragraphs = F.when(F.col("conv_id") % 2 == 1, F.array(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), F.col("text").alias("paragraph_text"))))
    made = c.filter("text IS NOT NULL").select(context.alias("context"), paragraphs.alias("paragraphs"))
    return readers.qa_paragraphs(made).withColumn("text", F.md5("text")).distinct()


@R.add("SELECT page_id, 'web' AS file_id, CAST(page_id % 9 AS INTEGER) AS page_number, md5(html) AS digest FROM pages WHERE html IS NOT NULL")
def page_asset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page assets written as JSON lists twice and read back; of a key that repeats one row stays."""
    p = table(spark, sf_dir, "pages").filter("html IS NOT NULL")
    made = p.select("page_id", F.col("page_id").cast("string").alias("id"), F.lit("web").alias("file_id"), (F.col("page_id") % 9).cast("int").alias("page_number"), F.col("html").alias("text"))
    path = graph.shared_path(spark, "page-assets")
    rows = made.withColumn("key", F.col("page_id")).drop("page_id")
    json_lists(rows.select("key", "id", "file_id", "page_number", "text"), "key", f"{path}/run=1")
    json_lists(rows.select("key", "id", "file_id", "page_number", "text"), "key", f"{path}/run=2")
    found = readers.page_assets(spark, path)
    return found.select(F.col("page_id").cast("bigint").alias("page_id"), "file_id", "page_number", F.md5("text_markdown").alias("digest"))


@R.add("SELECT doc_id, source, doc_id % 10 = 0 AS corrupt FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS doc_id2, * FROM documents) WHERE doc_id % 10 <> 0 UNION ALL SELECT NULL, NULL, true FROM documents WHERE doc_id % 10 = 0")
def json_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which every tenth is broken off."""
    line = F.to_json(F.struct("doc_id", "source"))
    path = graph.shared_path(spark, "json-lines")
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType())])
    return readers.json_lines(spark, path, schema).select("doc_id", "source", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@R.add("SELECT doc_id, CAST(f AS INTEGER) AS first, CAST(least(f + 49, n) AS INTEGER) AS last FROM (SELECT doc_id, n, unnest(range(1, n + 1, 50)) AS f FROM (SELECT doc_id, length(text) // 40 AS n FROM documents))")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most fifty pages, with forty characters to a page."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.floor(F.length("text") / 40).cast("int").alias("n_pages"))
    return readers.batch_ranges(d).withColumnRenamed("file_id", "doc_id")


@R.add("SELECT doc_id AS file_id, CAST(i + 100 * (doc_id % 3) AS INTEGER) AS page_number, md5(ls[i]) AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def ocr_page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as results of batches whose first page differs."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (100 * (F.col("doc_id") % 3) + 1).cast("int").alias("first"), F.split("text", "\n").alias("results"))
    return readers.ocr_pages(d).withColumn("text", F.md5("text"))


@R.add(r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(trim(regexp_replace(text || chr(9) || source, '[\t\r\n]+', ' ', 'g'))) AS line FROM documents WHERE text IS NOT NULL")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as tab-separated lines and read back."""
    path = graph.shared_path(spark, "tsv")
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    writers.write_tsv(d.select("doc_id", F.concat_ws("\t", "text", "source").alias("line")), path)
    found = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("ignoreTrailingWhiteSpace", False).schema("doc_id string, line string").csv(path)
    return found.withColumn("line", F.md5("line"))


@R.add("SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and their metadata saved apart, loaded together, and kept as a guarded snapshot."""
    e = table(spark, sf_dir, "embeddings").withColumn("hash_id", F.concat(F.lit("v-"), "vec_id"))
    path = graph.shared_path(spark, "vector-store")
    e.select("hash_id", "vec_id", "label").write.parquet(f"{path}/meta")
    e.select("hash_id", "embedding").write.parquet(f"{path}/vectors")
    kept = writers.Snapshots(spark, f"{path}/snapshots")
    kept.save(e.limit(0).select("vec_id", "label"), "v0")
    kept.save(writers.load_store(spark, path).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first")), "v1", guard=7)
    if kept.load("v0") is not None or kept.load("v1", guard=8) is not None:
        raise ValueError("a snapshot of another version or guard was loaded")
    return kept.load("v1", guard=7)


def label_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): each vector and the next one; every third edge is missing."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.filter("vec_id % 3 <> 0").select(F.concat(F.lit("v"), "vec_id").alias("src"), F.concat(F.lit("v"), F.col("vec_id") + 1).alias("dst"), F.lit(1.0).alias("weight"))


def alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): alias edges the other way round, of every second vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 2 = 0").select(F.concat(F.lit("v"), F.col("vec_id") + 1).alias("src"), F.concat(F.lit("v"), "vec_id").alias("dst"), (F.col("label") / 10.0).alias("weight"))


ALIAS = """e AS (SELECT 'v' || vec_id AS src, 'v' || (vec_id + 1) AS dst, 1.0 AS weight FROM embeddings WHERE vec_id % 3 <> 0),
a AS (SELECT 'v' || (vec_id + 1) AS src, 'v' || vec_id AS dst, label / 10.0 AS weight FROM embeddings WHERE vec_id % 2 = 0)
"""


@R.add("WITH " + ALIAS + "SELECT src, dst, weight FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.dst AND e.dst = a.src)")
def alias_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias edges that no edge joins yet."""
    return evidence.overlay(label_edges(spark, sf_dir), alias_pairs(spark, sf_dir))


@R.add(
    "WITH "
    + ALIAS
    + """, g AS (SELECT 'v' || vec_id AS node, vec_id % 4 // 2 AS part FROM embeddings WHERE vec_id % 5 <> 0)
SELECT src, dst, weight FROM a LEFT JOIN g x ON x.node = src LEFT JOIN g y ON y.node = dst WHERE coalesce(x.part = y.part, true)"""
)
def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias edges left after nodes are dealt to parts."""
    g = table(spark, sf_dir, "embeddings").filter("vec_id % 5 <> 0").select(F.concat(F.lit("v"), "vec_id").alias("node"), F.floor(F.col("vec_id") % 4 / 2).alias("part"))
    return evidence.split_cluster(alias_pairs(spark, sf_dir), g)


@R.add(
    "WITH "
    + ALIAS
    + """, x AS (SELECT src, dst FROM e), y AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM a)
SELECT src, dst, 'right' AS side FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x) UNION ALL SELECT src, dst, 'left' FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)"""
)
def graph_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that one of two graphs has and the other hasn't, repeats counted."""
    e = label_edges(spark, sf_dir)
    return graph.symmetric_difference(e, e.select("src", "dst").unionByName(alias_pairs(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"])


@R.add("WITH " + ALIAS + ", h AS (SELECT 'v' || vec_id AS node FROM embeddings WHERE label = 0 AND vec_id % 4 <> 1) SELECT src, dst, weight FROM e WHERE src NOT IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h)")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among vertices that aren't hidden; a vertex without a mark is visible."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("node"), F.when(F.col("vec_id") % 4 != 1, F.col("label") == 0).alias("hidden"))
    return graph.visible(v, label_edges(spark, sf_dir))[1]


@R.add("WITH " + ALIAS + ", v AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM v) AS vertices, count(*) AS edges, count(DISTINCT src) AS sources FROM e")
def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as two tables, read back and counted."""
    e = label_edges(spark, sf_dir)
    path = graph.shared_path(spark, "graph")
    writers.write_graph(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e, path)
    counts = spark.read.parquet(f"{path}/edges").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))
    return counts.crossJoin(spark.read.parquet(f"{path}/vertices").agg(F.count("*").alias("vertices")))


@R.add(
    """WITH f AS (SELECT (vec_id % 97) / 97.0 AS c, (vec_id % 89) / 89.0 AS r, CASE WHEN vec_id % 3 = 0 THEN 'unknown' ELSE 'rule' || label END AS who FROM embeddings),
b AS (SELECT string_agg(who || '=' || n, ',' ORDER BY who) AS by_acceptor FROM (SELECT who, count(*) AS n FROM f GROUP BY 1))
SELECT count(*) AS n, round(min(c), 9) AS least, round(avg(c), 9) AS mean, round(avg(r), 9) AS rerank, any_value(by_acceptor) AS by_acceptor FROM f, b"""
)
def alias_audit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of alias edges from their JSON features, by who accepted them."""
    e = table(spark, sf_dir, "embeddings")
    who = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("rule"), "label")).alias("accepted_by")
    features = F.to_json(F.struct((F.col("vec_id") % 97 / 97.0).alias("cos_sim"), (F.col("vec_id") % 89 / 89.0).alias("rerank"), who))
    found = evidence.alias_audit(e.select(features.alias("features_json")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("by_acceptor"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")
    return found.select("n", F.round("least", 9).alias("least"), F.round("mean", 9).alias("mean"), F.round("rerank", 9).alias("rerank"), shown.alias("by_acceptor"))


@R.add(
    """WITH m AS (SELECT doc_id, lang AS label, (doc_id % 100) / 100.0 AS score FROM documents)
SELECT doc_id, label, score FROM m WHERE score >= CASE label WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.8 ELSE 0.3 * 0.5 END"""
)
def label_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that reach the threshold of their label; others that of the default by its temperature."""
    m = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), (F.col("doc_id") % 100 / 100.0).alias("score"))
    return evidence.above_threshold(m, {"en": 0.5, "de": 0.8}, temperature=0.5)


@R.add("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS page_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 10)")
def scoped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids of the files with ten pages or more."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").cast("string").alias("page_id"))
    return evidence.units(d, "page", d.groupBy("file_id").count().filter("count >= 10"))


@R.add(
    """WITH act AS (SELECT 'v' || vec_id AS id, round((vec_id * 37 % 101) / 101.0, 6) AS score FROM embeddings WHERE label <> 1),
p AS (SELECT 'p' || vec_id AS hash_id FROM embeddings ORDER BY round((vec_id * 53 % 97) / 97.0, 6) DESC, 'p' || vec_id LIMIT 10),
ed AS (SELECT 'v' || vec_id AS s, 'p' || k AS t, 0.5 + k % 5 AS w FROM embeddings, (SELECT unnest(range(0, 400, 7)) AS k) WHERE (vec_id + k) % 3 = 0),
hit AS (SELECT ed.*, score FROM ed JOIN p ON t = hash_id JOIN act ON act.id = s),
kept AS (SELECT s, max(score) AS score FROM hit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'rf_' || s AS source, t AS target, CAST(w AS DOUBLE) AS weight FROM hit WHERE s IN (SELECT s FROM kept)
UNION ALL SELECT 'customer', 'rf_' || s, 1.0 / (SELECT count(*) FROM kept) FROM kept"""
)
def risk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from the top active entities to the top passages, half of them given the other way round."""
    e = table(spark, sf_dir, "embeddings")
    active = e.filter("label <> 1").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.round(F.col("vec_id") * 37 % 101 / 101.0, 6).alias("score"))
    passages = e.select(F.concat(F.lit("p"), "vec_id").alias("hash_id"), F.round(F.col("vec_id") * 53 % 97 / 97.0, 6).alias("score"))
    pairs = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(399), F.lit(7))).alias("k")).filter((F.col("vec_id") + F.col("k")) % 3 == 0)
    s, t = F.concat(F.lit("v"), "vec_id"), F.concat(F.lit("p"), "k")
    turned = F.col("k") % 2 == 0
    edges = pairs.select(F.when(turned, t).otherwise(s).alias("source"), F.when(turned, s).otherwise(t).alias("target"), (0.5 + F.col("k") % 5).alias("weight"))
    return evidence.risk_view(active, passages, edges)


@R.add(
    """WITH a AS (SELECT user_id AS run, event_type AS stage, ts FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id AS run, event_type AS stage, ts FROM events WHERE event_id % 2 = 1)
SELECT a.run, a.stage, epoch_us(a.ts) AS start_us, epoch_us(b.ts) AS done_us, epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 AS elapsed_ms FROM a JOIN b ON a.run = b.run AND a.stage = b.stage AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR"""
)
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with the dones of their stage within an hour: events of even and odd numbers."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("done").alias("phase"), F.col("ts").cast("timestamp").alias("ts"))
    return E.stage_pairs(e).select("run", "stage", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("done_ts").alias("done_us"), "elapsed_ms")


@R.add(
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 'failed' ELSE ['pending', 'parsing', 'indexing', 'ready'][doc_id % 4 + 1] END AS status, CASE WHEN doc_id % 4 IN (1, 2) THEN 'interrupted' WHEN doc_id % 8 = 3 THEN 'old' END AS error_msg FROM documents"""
)
def crash_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were in flight when the service stopped are failed."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "parsing", "indexing", "ready")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return E.reconcile(table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 8 == 3, "old").alias("error_msg")))


@R.add("SELECT doc_id, lang, source, NULL AS section FROM documents WHERE lang = 'en' AND doc_id % 2 = 0")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filters and a projection that fills a column that isn't there."""
    d = table(spark, sf_dir, "documents").withColumn("even", F.col("doc_id") % 2 == 0)
    return search.columns_or_null(search.where_equal(d, {"lang": "en", "even": True}), ["doc_id", "lang", "source", "section"])


@R.add(
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'entity' WHEN 2 THEN 'passage' ELSE 'unknown' END AS kind,
CASE WHEN doc_id % 3 = 0 AND length(text) > 0 THEN text WHEN doc_id % 3 < 2 THEN source || ' p' || doc_id ELSE 'key' || doc_id END = CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS own_label,
CAST(doc_id AS INTEGER) AS page_number, '![a](img/x' || doc_id || '.png) ![b](https://e.example/x.png) ![c](/abs.png)' AS images,
CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' ELSE 'none' END AS blob, 'cell ' || doc_id || chr(10) || 'next' AS plain FROM documents WHERE text IS NOT NULL"""
)
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, labels, page numbers, image targets, table formats and plain markup of rows."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    i = F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*values), (i % n + 1).cast("int"))
    name = pick(4, F.lit("entity-x"), F.lit("entity-y"), F.lit("passage-z"), F.lit("other"))
    label = X.display_label(F.when(i % 3 == 0, F.col("text")), F.when(i % 3 < 2, F.col("source")), i, F.concat(F.lit("key"), i))
    markup = F.concat(F.lit("<style>p{}</style><table><tr><td>cell</td><td>"), i, F.lit("[^1]</td></tr><tr><td>next<img src='x'></td></tr></table>"))
    return d.select(
        "doc_id",
        X.vertex_type(F.when(i % 4 == 0, "given"), name).alias("kind"),
        (label == F.when(i % 3 == 0, F.col("text")).otherwise("")).alias("own_label"),
        X.page_number(X.page_id(i)).alias("page_number"),
        X.image_paths(F.concat(F.lit("![a](x"), i, F.lit(".png) ![b](https://e.example/x.png) ![c](/abs.png)")), "img/").alias("images"),
        X.table_format(pick(3, F.lit("<TABLE><tr>"), F.lit("a | b"), F.lit("plain"))).alias("blob"),
        X.plain_markup(markup).alias("plain"),
    )


@R.add(
    r"""WITH q AS (SELECT item_id, text || ' +(a:b)~' || item_id || '?' AS t FROM benchmark WHERE text IS NOT NULL)
SELECT item_id, md5(trim(regexp_replace(t, '[-+&|!(){}\[\]^"~*?:\\/]', ' ', 'g'))) AS query, CAST(length(trim(regexp_replace(t, '[-+&|!(){}\[\]^"~*?:\\/]', ' ', 'g'))) AS INTEGER) AS n FROM q"""
)
def query_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without syntax characters."""
    q = X.query_words(F.concat("text", F.lit(" +(a:b)~"), "item_id", F.lit("?")))
    return table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", F.md5(q).alias("query"), F.length(q).alias("n"))


@R.add(
    r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN length(nice) > 0 THEN nice ELSE substr(text, 1, 200) END AS short
FROM (SELECT doc_id, text, regexp_extract(substr(text, 1, 200), '(?s)^(.{100,})[。；;. ]', 1) AS nice FROM documents)"""
)
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at a sentence end or blank in the second half of 200 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", X.shorten(F.col("text"), 200).alias("short"))


@R.add("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first, 1.0 AS length FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    return e.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(vectors.norm(F.col("u")), 6).alias("length"))


@R.add(
    """WITH s AS (SELECT p.vec_id AS probe, e.vec_id AS node, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS sim FROM embeddings e, embeddings p WHERE p.vec_id % 100 = 0 AND e.vec_id % 100 <> 0)
SELECT probe, node, sim FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, node) AS r FROM s WHERE sim >= 0.05) WHERE r = 1"""
)
def nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest stored vector of each probe."""
    e = table(spark, sf_dir, "embeddings")
    stored = e.filter("vec_id % 100 <> 0").select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    probes = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("q"))
    return evidence.seed_search(probes, stored, k=1, floor=0.05, drop=1e9).select("probe", "node", "sim")


@R.add(
    r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS INTEGER) AS page, md5(trim(text)) AS text FROM conversations WHERE text IS NOT NULL"""
)
def combined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined to one text by page markers, and parted again."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("pos"), "text")
    flat = F.regexp_replace("text", r"^\s+|\s+$", "")
    parted = structure.pages_of(writers.combined_markdown(c), "file_id", "text")
    return parted.select(F.col("file_id").alias("conv_id"), "page", F.md5(flat).alias("text"))


@R.add(
    """WITH r AS (SELECT CAST(ts AS DATE) AS day, event_type, event_type || user_id % 5 AS h, ts, event_id FROM events),
f AS (SELECT day, event_type AS name, h, min(ts) AS ts FROM r GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN name = 'error' THEN 'bad' ELSE 'good' END AS flavor, name, h AS content_hash FROM f"""
)
def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces written by flavour and day, equal contents of a day once, and read back."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("name"), F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "bad").otherwise("good").alias("flavor"))
    path = graph.shared_path(spark, "traces")
    writers.write_traces(rows, path)
    found = spark.read.schema("name string, content_hash string, ts string, flavor string, day date").json(path)
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "flavor", "name", "content_hash")


@R.add("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of tables."""
    return writers.manifest({n: table(spark, sf_dir, n) for n in ("pages", "documents", "events")})


@R.add(
    r"""SELECT item_id, p AS pattern, w AS weight FROM (SELECT item_id, unnest([{'p': 'a' || item_id, 'w': 1.0}, {'p': 'b.*', 'w': 0.3}, {'p': 'c', 'w': 0.7}], recursive := true) FROM benchmark WHERE item_id % 3 <> 0)"""
)
def answer_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of JSON answers in code fences; weights are held to their bounds, every third answer is no JSON."""
    made = F.concat(F.lit('```json\n[{"pattern": "a'), "item_id", F.lit('", "weight": 7}, {"pattern": "b.*", "weight": 0.1}, {"pattern": ""}, {"pattern": "c", "weight": 0.7}, {"weight": 1}]\n```'))
    answer = F.when(F.col("item_id") % 3 == 0, "no JSON at all").otherwise(made)
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.weighted_patterns(answer)).alias("p")).select("item_id", "p.pattern", "p.weight")


@R.add("SELECT 'k' || vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 'set ' || vec_id ELSE CAST(label AS VARCHAR) END AS value FROM embeddings")
def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with the overrides of every third key."""
    e = table(spark, sf_dir, "embeddings")
    key = F.concat(F.lit("k"), "vec_id").alias("key")
    changed = e.filter("vec_id % 3 = 0").select(key, F.concat(F.lit("set "), "vec_id").alias("value"))
    return evidence.settings(e.select(key, F.col("label").cast("string").alias("value")), changed)


QUERIES, ORACLES = R.queries, R.oracles
