"""Evidence queries: surfaces, their passages, partners and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import evidence, graph, search
from folioscope.operators.dictionary import dictionary_join
from folioscope.plans.base import ALIASES, MENTIONS, SENTENCES, Registry, alias_clusters, mentions, passages, sentence_rows, table

R = Registry()

#: (question, token) rows that may be sent to all tasks.
QUESTION_TOKENS = 200_000


@R.add("WITH " + MENTIONS + "SELECT surface, passage, doc_id, source FROM men JOIN (SELECT doc_id, source, 'passage-' || md5(text) AS passage FROM documents) USING (passage) WHERE regexp_matches(surface, '^then')")
def surface_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces by pattern, their passages and documents."""
    p = passages(spark, sf_dir).select("passage", F.col("page").alias("doc_id"), F.col("file_id").alias("source"))
    return evidence.passages_of_surface(mentions(spark, sf_dir), p, "^then").select("surface", "passage", "doc_id", "source")


PAIRS_SQL = (
    "WITH "
    + SENTENCES
    + r""", m AS (SELECT DISTINCT doc_id, pos, lower(unnest(regexp_extract_all(sentence, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM sent),
d AS (SELECT doc_id, pos, count(*) AS k FROM m GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12),
pr AS (SELECT a.surface AS a, b.surface AS b, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.surface <> b.surface
JOIN d ON a.doc_id = d.doc_id AND a.pos = d.pos GROUP BY 1, 2)
"""
)


@R.add(PAIRS_SQL + "SELECT a AS surface, b AS partner, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM pr) WHERE rank <= 5")
def top_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five surfaces that each surface meets most."""
    from folioscope.operators.order import top_per_group

    s = sentence_rows(spark, sf_dir).select(F.concat_ws(":", "doc_id", "pos").alias("place"), F.explode(F.array_distinct(X.surfaces(F.col("sentence")))).alias("surface"))
    both = evidence.partners(graph.cooccurrence(s, "place", "surface"))
    return top_per_group(both, ["surface"], [F.desc("n"), F.asc("partner")], 5)


@R.add("WITH " + MENTIONS + "SELECT DISTINCT surface FROM men WHERE surface NOT IN (SELECT surface FROM men GROUP BY 1 HAVING count(*) >= 40)")
def stop_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces but those in forty passages or more, which stand for stop words here."""
    m = mentions(spark, sf_dir)
    stop = m.groupBy("surface").count().filter("count >= 40").select(F.col("surface").alias("word"))
    return evidence.admitted(m.select("surface", F.lit(0.5).alias("score")).distinct(), stop).select("surface")


CLUSTERED = "WITH RECURSIVE " + MENTIONS + "," + ALIASES + ", ed AS (SELECT surface, passage, n / sum(n) OVER (PARTITION BY passage) AS w FROM men)"


@R.add(
    CLUSTERED
    + """ SELECT cluster, count(DISTINCT passage) AS passages, round(sum(w), 6) AS weight, count(DISTINCT surface) AS size FROM ed JOIN cl USING (surface) GROUP BY 1"""
)
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, weight and size of alias clusters."""
    e = graph.entity_passage_edges(mentions(spark, sf_dir))
    return evidence.cluster_stats(e, alias_clusters(spark, sf_dir)).select("cluster", "passages", F.round("weight", 6).alias("weight"), "size")


@R.add(
    CLUSTERED
    + """, c AS (SELECT passage, cluster, round(sum(w), 6) AS weight, arg_max(surface, (w, surface)) AS heaviest FROM ed JOIN cl USING (surface) GROUP BY 1, 2)
SELECT passage, cluster, weight, heaviest, rank FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY weight DESC, cluster) AS rank FROM c) WHERE rank <= 3"""
)
def passage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest clusters of each passage."""
    e = graph.entity_passage_edges(mentions(spark, sf_dir))
    return evidence.passage_top_clusters(e, alias_clusters(spark, sf_dir), 3)


@R.add(
    r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM l)
SELECT doc_id, CAST(p AS INTEGER) AS line_no, md5(l[p]) AS line, regexp_matches(lower(l[p]), 'worthless') AS hit FROM x
WHERE regexp_matches(lower(l[p]), 'worthless') OR (p > 1 AND regexp_matches(lower(l[p - 1]), 'worthless')) OR (p < len(l) AND regexp_matches(lower(l[p + 1]), 'worthless'))"""
)
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word and the lines beside them."""
    g = evidence.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "worthless", 1)
    return g.select("doc_id", "line_no", F.md5("line").alias("line"), "hit")


@R.add(
    r"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT doc_id, string_split(t, 'the ') AS s FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS occurrence, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + 4 * (k - 1) AS INTEGER) AS start
FROM (SELECT doc_id, s, unnest(range(1, len(s))) AS k FROM p WHERE len(s) > 1)"""
)
def mention_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a surface in texts, case aside."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.mention_offsets(F.col("text"), F.lit("the "))).alias("k", "o"))
    return d.filter("o.start >= 0").select("doc_id", (F.col("k") + 1).alias("occurrence"), F.col("o.start").alias("start"))


@R.add(
    r"""
WITH s AS (SELECT 'passage-' || md5(text) AS passage, text FROM documents)
SELECT surface, count(*) AS passages FROM (
  SELECT DISTINCT passage, unnest(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')), ['idiot', 'clown', 'moron', 'worthless', 'pathetic'])) AS surface FROM s) GROUP BY 1"""
)
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with words of a small dictionary; `dictionary_surfaces` looks for a large one."""
    p = passages(spark, sf_dir).groupBy("passage").agg(F.first("text").alias("text"))
    words = spark.createDataFrame([(w,) for w in ("idiot", "clown", "moron", "worthless", "pathetic")], "surface string")
    return dictionary_join(p, words, "passage", "text").groupBy("surface").agg(F.count("*").alias("passages"))


@R.add(
    "WITH "
    + MENTIONS
    + r""", tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS surface FROM documents)
SELECT surface, count(DISTINCT doc_id) AS documents, count(*) AS n FROM tok WHERE surface IN (SELECT surface FROM men) GROUP BY 1"""
)
def dictionary_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All surfaces of all passages, looked for in all documents in any case: documents and occurrences."""
    words = mentions(spark, sf_dir).select("surface").distinct()
    hits = dictionary_join(table(spark, sf_dir, "documents"), words, "doc_id", "text")
    return hits.groupBy("surface").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))


@R.add(
    """
WITH t AS (SELECT DISTINCT doc_id, 0 AS z, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark),
i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 0.5)) AS idf FROM t GROUP BY 1),
a AS (SELECT item_id, token, idf FROM q JOIN i USING (token) WHERE idf > 2), b AS (SELECT doc_id, token, idf FROM t JOIN i USING (token) WHERE idf > 2),
c AS (SELECT item_id, doc_id, sum(a.idf) AS c FROM a JOIN b USING (token) GROUP BY ALL)
SELECT item_id AS a, doc_id AS b, round(c / (ta + tb - c), 6) AS overlap FROM c
JOIN (SELECT item_id, sum(idf) AS ta FROM a GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, sum(idf) AS tb FROM b GROUP BY 1) USING (doc_id)"""
)
def surface_idf_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted overlap of questions and documents in their rare words."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    t = evidence.tokens_of(d, "doc_id", "text")
    n = d.agg(F.count("*").alias("n"))
    idf = t.groupBy("token").agg(F.count("*").alias("df")).crossJoin(n).select("token", F.ln((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf")).filter("idf > 2")
    return evidence.idf_jaccard(evidence.tokens_of(q, "item_id", "text"), t, idf).select("a", "b", F.round("overlap", 6).alias("overlap"))


@R.add(
    """
WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark),
i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 0.5)) AS idf FROM t GROUP BY 1),
a AS (SELECT item_id, token, idf FROM q JOIN i USING (token)), b AS (SELECT doc_id, token, idf FROM t JOIN i USING (token)),
c AS (SELECT item_id, doc_id, sum(a.idf) AS c FROM a JOIN b USING (token) GROUP BY ALL)
SELECT item_id AS a, doc_id AS b, round(c / (ta + tb - c), 6) AS overlap FROM c
JOIN (SELECT item_id, sum(idf) AS ta FROM a GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, sum(idf) AS tb FROM b GROUP BY 1) USING (doc_id)"""
)
def idf_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted overlap of all questions and documents in all their words, frequent ones too."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    t = evidence.tokens_of(d, "doc_id", "text")
    n = d.agg(F.count("*").alias("n"))
    idf = t.groupBy("token").agg(F.count("*").alias("df")).crossJoin(n).select("token", F.ln((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf"))
    asked, idf = evidence.tokens_of(q, "item_id", "text").filter("key IS NOT NULL"), graph.written(idf, "idf")
    few = asked.limit(QUESTION_TOKENS + 1).count() <= QUESTION_TOKENS
    found = evidence.idf_jaccard_of_few(asked, t.filter("key IS NOT NULL"), idf) if few else evidence.idf_jaccard(asked, t, idf)
    return found.select("a", "b", F.round("overlap", 6).alias("overlap"))


@R.add(
    """
WITH e AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem), f AS (SELECT DISTINCT 'o' || o AS src, 'p' || p AS dst, CAST(1.0 AS DOUBLE) AS weight FROM e),
h AS (SELECT src, dst, weight, row_number() OVER (ORDER BY src, dst) AS k FROM f QUALIFY k <= 2500),
s AS (SELECT node, min(k) AS k FROM (SELECT src AS node, k FROM h UNION ALL SELECT dst, k FROM h) GROUP BY 1),
r AS (SELECT h.*, sum(coalesce(n, 0)) OVER (ORDER BY h.k) AS nodes FROM h LEFT JOIN (SELECT k, count(*) AS n FROM s GROUP BY 1) c ON c.k = h.k)
SELECT src, dst, weight FROM r WHERE nodes <= 50"""
)
def graph_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display sample of fifty nodes of the order-part graph."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return evidence.graph_sample(li.withColumn("weight", F.lit(1.0)), 50)


@R.add(
    "WITH "
    + SENTENCES
    + r""", m AS (SELECT DISTINCT surface, doc_id * 100000 + pos AS sentence FROM (SELECT doc_id, pos, lower(unnest(regexp_extract_all(sentence, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM sent)),
sim AS (SELECT sentence, 0.8 + (sentence % 13) / 100.0 AS sim FROM (SELECT DISTINCT sentence FROM m)),
f1 AS (SELECT DISTINCT surface, 1.0 AS score FROM m WHERE regexp_matches(surface, '^(then|reth)')),
b1 AS (SELECT surface, sentence, score * sim AS nx FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY sim DESC, sentence) AS k FROM f1 JOIN m USING (surface) JOIN sim USING (sentence)) WHERE k = 1 AND score * sim >= 0.5),
r1 AS (SELECT m.surface, nx FROM b1 JOIN m USING (sentence)),
f2 AS (SELECT surface, max(nx) AS score FROM r1 GROUP BY 1),
b2 AS (SELECT surface, sentence, score * sim AS nx FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY sim DESC, sentence) AS k FROM f2 JOIN m USING (surface) JOIN sim USING (sentence)
  WHERE sentence NOT IN (SELECT sentence FROM b1)) WHERE k = 1 AND score * sim >= 0.5),
r2 AS (SELECT m.surface, nx FROM b2 JOIN m USING (sentence)),
a AS (SELECT surface, score, 1 AS tier FROM f1 UNION ALL SELECT surface, nx, 2 FROM r1 UNION ALL SELECT surface, nx, 3 FROM r2)
SELECT surface, round(sum(score), 6) AS score, min(tier) AS tier FROM a GROUP BY 1"""
)
def entity_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds from seed surfaces through their best sentences; similarity is a stand-in made from the sentence's place."""
    s = sentence_rows(spark, sf_dir)
    m = s.select((F.col("doc_id") * 100000 + F.col("pos")).alias("sentence"), F.explode(F.array_distinct(X.surfaces(F.col("sentence")))).alias("surface"))
    sim = m.select("sentence").distinct().withColumn("sim", 0.8 + (F.col("sentence") % 13) / 100.0)
    seeds = m.filter(F.col("surface").rlike("^(then|reth)")).select("surface").distinct().withColumn("score", F.lit(1.0))
    return evidence.expand(seeds, m, sim).select("surface", F.round("score", 6).alias("score"), "tier")


@R.add(
    """
SELECT user_id, event_id, cost FROM (SELECT user_id, event_id, round((event_id % 1000 * 2 * CASE WHEN event_type = 'view' THEN 0.5 ELSE 2.0 END + event_id % 77 * 2 * CASE WHEN event_type = 'view' THEN 1.5 ELSE 6.0 END) / 1e6, 6) AS cost FROM events) WHERE cost > 0.0005"""
)
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by the first price key that a name holds."""
    u = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("model"), (F.col("event_id") % 1000 * 2).alias("tokens_in"), (F.col("event_id") % 77 * 2).alias("tokens_out"))
    return evidence.costs(u, [("view", 0.5, 1.5), ("", 2.0, 6.0)]).filter("cost > 0.0005").select("user_id", "event_id", "cost")


@R.add("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a filtered log, newest first."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("target"), F.col("ts").alias("at"), "user_id")
    return evidence.audit(log, "purchase", limit=20, offset=20).select(F.col("id").alias("event_id"), F.col("action").alias("event_type"), "user_id")


@R.add("SELECT page_id, CASE WHEN length(t) > 140 THEN substr(t, 1, 140) || '…' ELSE t END AS preview FROM (SELECT page_id, trim(regexp_replace(url || ' ' || html, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in 140 characters."""
    return table(spark, sf_dir, "pages").select("page_id", X.preview(F.concat_ws(" ", "url", "html")).alias("preview"))


#: All sentences with their surfaces in DuckDB, sentences by their hash.
SENTENCE_MENTIONS = r"""
m AS (SELECT DISTINCT md5(sentence) AS sentence, lower(unnest(regexp_extract_all(sentence, '\p{Lu}\p{Ll}{3,}'))) AS surface FROM sent)
"""


def _sentence_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentence (hash), surface: distinct."""
    s = sentence_rows(spark, sf_dir)
    return s.select(F.md5("sentence").alias("sentence"), F.explode(F.array_distinct(X.surfaces(F.col("sentence")))).alias("surface")).distinct()


@R.add("WITH " + SENTENCES + "," + SENTENCE_MENTIONS + "SELECT a.surface AS surface_a, b.surface AS surface_b, sentence FROM m a JOIN m b USING (sentence) WHERE a.surface < b.surface")
def pair_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that each two surfaces share."""
    return evidence.pair_sentences(_sentence_mentions(spark, sf_dir))


@R.add(
    CLUSTERED
    + """, t AS (SELECT cluster, surface, round(sum(w), 4) AS weight FROM ed JOIN cl USING (surface) GROUP BY 1, 2)
SELECT cluster, surface, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, surface) AS rank FROM t) WHERE rank <= 8"""
)
def cluster_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight heaviest surfaces of each cluster."""
    e = graph.entity_passage_edges(mentions(spark, sf_dir))
    return evidence.cluster_top_surfaces(e, alias_clusters(spark, sf_dir)).select("cluster", "surface", "weight", "rank")


@R.add(
    CLUSTERED
    + """, t AS (SELECT cluster, passage, round(sum(w), 4) AS weight, array_to_string(list_sort(list(DISTINCT surface))[1:3], ',') AS members FROM ed JOIN cl USING (surface) GROUP BY 1, 2)
SELECT cluster, passage, weight, members, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, passage) AS rank FROM t) WHERE rank <= 10"""
)
def cluster_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten passages that each cluster weighs most in, with three of its surfaces there."""
    e = graph.entity_passage_edges(mentions(spark, sf_dir))
    return evidence.cluster_top_passages(e, alias_clusters(spark, sf_dir)).select("cluster", "passage", "weight", F.array_join("members", ",").alias("members"), "rank")


@R.add(
    CLUSTERED
    + ","
    + SENTENCES
    + ","
    + SENTENCE_MENTIONS
    + """, mc AS (SELECT sentence, coalesce(cluster, surface) AS cluster FROM m LEFT JOIN cl USING (surface)),
x AS (SELECT a.cluster, b.cluster AS other, count(*) AS n FROM mc a JOIN mc b USING (sentence) WHERE a.cluster <> b.cluster GROUP BY 1, 2)
SELECT cluster, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, other) AS rank FROM x) WHERE rank <= 8"""
)
def cluster_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight clusters that each cluster shares most sentences with, summed over pairs of members."""
    m = _sentence_mentions(spark, sf_dir)
    pairs = evidence.pair_sentences(m).groupBy("surface_a", "surface_b").agg(F.count("*").alias("n"))
    return evidence.cluster_cooccurrences(pairs, alias_clusters(spark, sf_dir)).select("cluster", "other", "n", "rank")


@R.add(
    CLUSTERED
    + ","
    + SENTENCES
    + ","
    + SENTENCE_MENTIONS
    + r""", c AS (SELECT sentence, surface, coalesce(cluster, surface) AS cluster FROM m LEFT JOIN cl USING (surface)),
q AS (SELECT item_id AS query, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS words FROM benchmark WHERE item_id % 100 = 0),
s AS (SELECT sentence, any_value(list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'))) AS w FROM (SELECT md5(sentence) AS sentence, sentence AS t FROM sent) GROUP BY 1),
own AS (SELECT DISTINCT query, words, cluster AS tail, sentence FROM m JOIN cl USING (surface), q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, tail ORDER BY sim DESC, sentence) AS k
  FROM (SELECT query, tail, sentence, round(len(list_intersect(w, words)) / len(w), 6) AS sim FROM own JOIN s USING (sentence))),
seen AS (SELECT query, tail, cluster, sentence, sim, min(surface) AS surface FROM ranked JOIN c USING (sentence) WHERE k <= 32 AND cluster <> tail GROUP BY ALL),
f AS (SELECT query, tail, cluster, arg_min(surface, (-sim, surface)) AS surface, max(sim) AS top, round(avg(sim), 6) AS mean, count(*) AS support,
  array_to_string(list(sentence ORDER BY sim DESC, sentence)[1:8], ',') AS via FROM seen GROUP BY 1, 2, 3)
SELECT query, tail, cluster, surface, top, mean, support, via, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query, tail ORDER BY top DESC, mean DESC, support DESC, cluster) AS rank FROM f) WHERE rank <= 20"""
)
def sentence_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters beside each other one in the sentences nearest to each question of an id divisible by 100, by shared words."""
    m = _sentence_mentions(spark, sf_dir)
    cluster = alias_clusters(spark, sf_dir)
    own = sentence_rows(spark, sf_dir).filter(F.size(X.surfaces(F.col("sentence"))) > 0)
    own = own.select(F.md5("sentence").alias("sentence"), F.array_distinct(X.words(F.col("sentence"))).alias("w")).dropDuplicates(["sentence"])
    q = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query"), F.array_distinct(X.words(F.col("text"))).alias("words"))
    near = None
    for block in search.probe_blocks(q, "query"):
        part = own.join(F.broadcast(block)).select("query", "sentence", F.round(F.size(F.array_intersect("w", "words")) / F.size("w"), 6).alias("sim"))
        near = part if near is None else near.unionByName(part)
    tails = m.join(cluster.withColumnRenamed("node", "surface"), "surface").select("sentence", F.col("cluster").alias("tail")).join(near.select("query", "sentence"), "sentence").select("query", "tail")
    got = evidence.sentence_neighbours(tails, m, cluster, near)
    return got.select("query", "tail", "cluster", "surface", "top", "mean", "support", F.array_join("via", ",").alias("via"), "rank")


QUERIES, ORACLES = R.queries, R.oracles
