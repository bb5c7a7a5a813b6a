"""Lookups over surfaces, passages and clusters: the joins behind evidence tables and graph views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import WORD_PATTERN
from folioscope.operators.order import top_per_group

#: Pairs that a task holds at once, about.
CELLS = 2_000_000


def passages_of_surface(edges: DataFrame, passages: DataFrame, pattern: str) -> DataFrame:
    """(surface, passage, ...) of surfaces that match a pattern, case aside; the filter is on the narrow side."""
    hit = edges.filter(F.col("surface").rlike("(?i)" + pattern))
    return hit.join(passages, "passage")


def partners(pairs: DataFrame) -> DataFrame:
    """(surface, partner, n) in both directions of co-occurrence pairs (surface_a, surface_b, n)."""
    a = pairs.select(F.col("surface_a").alias("surface"), F.col("surface_b").alias("partner"), "n")
    return a.unionByName(pairs.select(F.col("surface_b").alias("surface"), F.col("surface_a").alias("partner"), "n"))


def admitted(mentions: DataFrame, stop_words: DataFrame, floor: float = 0.95) -> DataFrame:
    """Mentions (surface, score) but stop words (word) with a score under the floor."""
    stop = stop_words.select(F.lower(F.trim("word")).alias("_w")).distinct()
    return mentions.join(stop, (F.lower(F.trim("surface")) == F.col("_w")) & (F.coalesce("score", F.lit(0.0)) < floor), "left_anti")


def above_threshold(mentions: DataFrame, thresholds: dict[str, float], default: float = 0.3, temperature: float = 1.0) -> DataFrame:
    """Mentions whose score reaches their label's threshold, or the default one times the temperature."""
    own = F.lit(None).cast("double")
    for label, t in thresholds.items():
        own = F.when(F.col("label") == label, t).otherwise(own)
    return mentions.filter(F.col("score") >= F.coalesce(own, F.lit(default * temperature)))


def cluster_stats(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(cluster, size, passages, weight) over entity-passage edges (surface, passage, weight)."""
    size = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    e = edges.join(cluster.withColumnRenamed("node", "surface"), "surface").groupBy("cluster", "passage").agg(F.sum("weight").alias("w"))
    return e.groupBy("cluster").agg(F.count("*").alias("passages"), F.sum("w").alias("weight")).join(size, "cluster")


def passage_top_clusters(edges: DataFrame, cluster: DataFrame, k: int) -> DataFrame:
    """(passage, cluster, weight, heaviest, rank): clusters by weight, with their heaviest surface."""
    e = edges.join(cluster.withColumnRenamed("node", "surface"), "surface")
    per = e.groupBy("passage", "cluster").agg(F.round(F.sum("weight"), 6).alias("weight"), F.max_by("surface", F.struct("weight", "surface")).alias("heaviest"))
    return top_per_group(per, ["passage"], [F.desc("weight"), F.asc("cluster")], k)


def pair_sentences(mentions: DataFrame) -> DataFrame:
    """(surface_a, surface_b, sentence), a row for each sentence that two surfaces share, of rows (sentence, surface).

    The sentences of a pair stay rows: a frequent pair has any number of them.
    """
    m = mentions.select("sentence", "surface").distinct()
    a, b = m.withColumnRenamed("surface", "surface_a"), m.withColumnRenamed("surface", "surface_b")
    return a.join(b, "sentence").filter("surface_a < surface_b").select("surface_a", "surface_b", "sentence")


def cluster_top_surfaces(edges: DataFrame, cluster: DataFrame, k: int = 8) -> DataFrame:
    """(cluster, surface, weight, rank): the members of each cluster with the most weight of edges (surface, passage, weight)."""
    weight = edges.groupBy("surface").agg(F.round(F.sum("weight"), 4).alias("weight"))
    members = cluster.select("cluster", F.col("node").alias("surface")).join(weight, "surface")
    return top_per_group(members, ["cluster"], [F.desc("weight"), F.asc("surface")], k)


def cluster_top_passages(edges: DataFrame, cluster: DataFrame, k: int = 10, samples: int = 3) -> DataFrame:
    """(cluster, passage, weight, members, rank): passages by the weight of the cluster's surfaces, with the first of these by name."""
    e = edges.join(cluster.withColumnRenamed("node", "surface"), "surface")
    per = e.groupBy("cluster", "passage").agg(F.round(F.sum("weight"), 4).alias("weight"))
    best = top_per_group(per, ["cluster"], [F.desc("weight"), F.asc("passage")], k)
    named = top_per_group(e.join(best.select("cluster", "passage"), ["cluster", "passage"]).select("cluster", "passage", "surface").distinct(), ["cluster", "passage"], [F.asc("surface")], samples)
    named = named.groupBy("cluster", "passage").agg(F.array_sort(F.collect_list("surface")).alias("members"))
    return best.join(named, ["cluster", "passage"])


def cluster_cooccurrences(pairs: DataFrame, cluster: DataFrame, k: int = 8) -> DataFrame:
    """(cluster, other, n, rank): clusters whose members share most sentences, of pairs (surface_a, surface_b, n).

    A surface without a cluster is one by itself; pairs within a cluster don't count.
    """
    own = lambda df, c, name: df.join(cluster.select(F.col("node").alias(c), F.col("cluster").alias("_c")), c, "left").withColumn(name, F.coalesce("_c", c)).drop("_c")
    p = own(own(pairs, "surface_a", "surface"), "surface_b", "partner").filter("surface <> partner")
    folded = p.select(F.least("surface", "partner").alias("surface_a"), F.greatest("surface", "partner").alias("surface_b"), "n").groupBy("surface_a", "surface_b").agg(F.sum("n").alias("n"))
    return top_per_group(partners(folded).toDF("cluster", "other", "n"), ["cluster"], [F.desc("n"), F.asc("other")], k)


def sentence_neighbours(tails: DataFrame, mentions: DataFrame, cluster: DataFrame, similarity: DataFrame, sentences: int = 32, k: int = 20, via: int = 8) -> DataFrame:
    """(query, tail, cluster, surface, top, mean, support, via, rank): what the best sentences of a tail's cluster mention beside it.

    Of the sentences that mention a member of the cluster tail (tails: query, tail) the most similar to the query
    (similarity: query, sentence, sim) are kept; the surfaces they mention (sentence, surface) are folded to
    clusters, each sentence once, and ranked by largest and mean similarity and number of sentences. A surface
    without a cluster is one by itself; the tail's own cluster is left out.
    """
    m = mentions.join(cluster.withColumnRenamed("node", "surface"), "surface", "left").withColumn("cluster", F.coalesce("cluster", "surface"))
    m = m.select("sentence", "surface", "cluster").distinct()
    own = m.select(F.col("cluster").alias("tail"), "sentence").distinct().join(tails.select("query", "tail").distinct(), "tail")
    best = top_per_group(own.join(similarity, ["query", "sentence"]), ["query", "tail"], [F.desc("sim"), F.asc("sentence")], sentences).select("query", "tail", "sentence", "sim")
    seen = best.join(m, "sentence").filter("cluster <> tail").groupBy("query", "tail", "cluster", "sentence").agg(F.first("sim").alias("sim"), F.min("surface").alias("surface"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "sentence")))  # as many as sentences at most
    folded = seen.groupBy("query", "tail", "cluster").agg(
        F.min_by("surface", F.struct((-F.col("sim")).alias("s"), "surface")).alias("surface"),
        F.max("sim").alias("top"),
        F.round(F.avg("sim"), 6).alias("mean"),
        F.count("*").alias("support"),
        F.slice(F.transform(ordered, lambda x: x["sentence"]), 1, via).alias("via"),
    )
    return top_per_group(folded, ["query", "tail"], [F.desc("top"), F.desc("mean"), F.desc("support"), F.asc("cluster")], k)


def prompt_blocks(pages: DataFrame) -> DataFrame:
    """(query, legend, block): numbered pages (query, number, file_id, page_id, text) of each query as text for a prompt.

    Pages are those of a ranked answer, so a query has a bounded number of them. Pages without a number stand
    last and have no label, and the legend leaves them out.
    """
    label = F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]"))
    item = F.struct(
        F.col("number").isNull().alias("last"),
        "number",
        "file_id",
        "page_id",
        F.concat(F.lit("  "), label, F.lit(" file_id="), "file_id", F.lit(" page_number="), F.col("page_id").cast("string")).alias("line"),
        F.concat(F.lit("----- "), F.coalesce(F.concat(label, F.lit(" ")), F.lit("")), F.lit("Page file_id="), "file_id", F.lit(" page_id="), F.col("page_id").cast("string"), F.lit(" -----\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("part"),
    )
    per = pages.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("p"))
    lines = F.filter(F.transform("p", lambda x: x["line"]), lambda x: x.isNotNull())
    return per.select("query", F.array_join(lines, "\n").alias("legend"), F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("block"))


def alias_audit(alias: DataFrame) -> DataFrame:
    """One row: count, least and mean cosine, mean rerank score and edges by acceptor, from JSON features."""
    f = alias.select(F.from_json("features_json", "cos_sim double, rerank double, accepted_by string").alias("f")).select("f.cos_sim", "f.rerank", F.coalesce("f.accepted_by", F.lit("unknown")).alias("accepted_by"))
    by = f.groupBy("accepted_by").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("accepted_by", "n"))).alias("by_acceptor"))
    return f.agg(F.count("*").alias("n"), F.min("cos_sim").alias("least"), F.avg("cos_sim").alias("mean"), F.avg("rerank").alias("rerank")).crossJoin(by)


def overlay(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Alias edges (src, dst, weight) that no edge of either direction joins yet."""
    have = edges.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
    new = alias.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst")).dropDuplicates(["_a", "_b"])
    return new.join(have, ["_a", "_b"], "left_anti").drop("_a", "_b")


def split_cluster(alias: DataFrame, group: DataFrame) -> DataFrame:
    """Alias edges left after nodes are dealt to groups (node, part): edges across parts go."""
    a, b = group.select(F.col("node").alias("src"), F.col("part").alias("_a")), group.select(F.col("node").alias("dst"), F.col("part").alias("_b"))
    return alias.join(a, "src", "left").join(b, "dst", "left").filter(F.coalesce(F.col("_a") == F.col("_b"), F.lit(True))).drop("_a", "_b")


def expand(seeds: DataFrame, mentions: DataFrame, similarity: DataFrame, rounds: int = 2, threshold: float = 0.5) -> DataFrame:
    """(surface, score, tier): seeds and what their best sentences mention.

    In a round each frontier surface takes its most similar sentence not used in earlier rounds
    (similarity: sentence, sim); the sentence's surfaces get score times similarity if that reaches the
    threshold. Scores of one surface add up; its frontier score is the largest.
    """
    front = seeds.select("surface", "score")
    out = front.withColumn("tier", F.lit(1))
    used = None
    for tier in range(2, rounds + 2):
        near = front.join(mentions, "surface").join(similarity, "sentence")
        near = near if used is None else near.join(used, "sentence", "left_anti")
        best = top_per_group(near, ["surface"], [F.desc("sim"), F.asc("sentence")], 1).withColumn("next", F.col("score") * F.col("sim")).filter(F.col("next") >= threshold)
        reached = best.select("sentence", "next").join(mentions, "sentence")
        out = out.unionByName(reached.select("surface", F.col("next").alias("score"), F.lit(tier).alias("tier")))
        used = best.select("sentence").distinct() if used is None else used.unionByName(best.select("sentence")).distinct()
        front = reached.groupBy("surface").agg(F.max("next").alias("score"))
    return out.groupBy("surface").agg(F.sum("score").alias("score"), F.min("tier").alias("tier"))


def seed_search(probes: DataFrame, stored: DataFrame, k: int = 50, floor: float = 0.4, drop: float = 0.3) -> DataFrame:
    """(probe, node, sim, rank): nearest stored vectors (node, v) of stated probes (probe, q), down to a floor and a steep drop."""
    from folioscope.operators.order import gradient_cut
    from folioscope.operators.search import largest_products

    best = largest_products(stored.select("node", "v"), probes.select("probe", F.col("q").alias("_q")), "node", "v", k).withColumnRenamed("score", "sim")
    return gradient_cut(best, "probe", "sim", floor, drop)


def idf_jaccard(left: DataFrame, right: DataFrame, idf: DataFrame, hint: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(a, b, overlap): weight of common tokens over weight of all, for pairs with a common token. Rows (key, token).

    hint is put on the left rows where they meet the right ones.
    """
    weigh = lambda df: df.distinct().join(idf, "token")
    a, b = weigh(left).withColumnRenamed("key", "a"), weigh(right).withColumnRenamed("key", "b")
    total_a, total_b = a.groupBy("a").agg(F.sum("idf").alias("_ta")), b.groupBy("b").agg(F.sum("idf").alias("_tb"))
    common = b.drop("idf").join(hint(a), "token").groupBy("a", "b").agg(F.sum("idf").alias("_c"))
    j = common.join(total_a, "a").join(total_b, "b")
    return j.select("a", "b", (F.col("_c") / (F.col("_ta") + F.col("_tb") - F.col("_c"))).alias("overlap"))


def idf_jaccard_of_few(left: DataFrame, right: DataFrame, idf: DataFrame) -> DataFrame:
    """idf_jaccard for left rows that are counted to be few: they are sent to the tasks, and the right ones are shuffled once by token and once by key.

    A right key brings its total weight and the numbers of its tokens that any left key has; common weights are summed in
    arrays, so no row is made for each token of a pair.
    """
    asked = left.distinct().join(idf, "token").select("key", "token", "idf").collect()
    keys, words = sorted({r["key"] for r in asked}), sorted({r["token"] for r in asked})
    of_key, of_word = {k: i for i, k in enumerate(keys)}, {w: i for i, w in enumerate(words)}
    held, weight, total = [[] for _ in words], np.zeros(len(words)), np.zeros(len(keys))
    for r in asked:
        held[of_word[r["token"]]].append(of_key[r["key"]])
        weight[of_word[r["token"]]] = r["idf"]
        total[of_key[r["key"]]] += r["idf"]
    n = np.array([len(h) for h in held], dtype=np.int64)
    first, flat = np.cumsum(n) - n, np.array([k for h in held for k in h], dtype=np.int64)
    names = np.array(keys)

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(keys)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b, own, lists = (c for c in batch.slice(at, step).columns)
                w, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
                k = n[w]
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[w], k)
                cell = np.repeat(rows, k) * len(keys) + flat[place]
                size = len(b) * len(keys)
                common = np.bincount(cell, np.repeat(weight[w], k), size)
                hit = np.flatnonzero(np.bincount(cell, minlength=size))
                i, j = hit // len(keys), hit % len(keys)
                c = common[hit]
                yield pa.RecordBatch.from_arrays([pa.array(names[j]), b.take(pa.array(i)), pa.array(c / (total[j] + own.to_numpy(zero_copy_only=False)[i] - c))], names=["a", "b", "overlap"])

    kinds = [df.schema["key"].dataType.simpleString() for df in (left, right)]
    spark = right.sparkSession
    if not asked:
        return right.filter("false").select(F.lit(None).cast(kinds[0]).alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("overlap"))
    numbers = F.broadcast(spark.createDataFrame(list(of_word.items()), "token string, _w int"))
    rows = right.select("key", "token").repartition("token").distinct().join(idf, "token").join(numbers, "token", "left")
    per = rows.groupBy("key").agg(F.sum("idf").alias("_tb"), F.collect_list("_w").alias("_words")).filter(F.size("_words") > 0)
    return per.mapInArrow(overlaps, f"a {kinds[0]}, b {kinds[1]}, overlap double")


def merge_sources(pool: DataFrame) -> DataFrame:
    """One row a URL of (url, redirect, seq, title, snippet): a redirect counts as its target, the first filled value stays."""
    rows = pool.withColumn("url", F.coalesce("redirect", "url"))
    first = lambda c: F.min_by(c, F.when(F.length(c) > 0, F.col("seq"))).alias(c)
    return rows.groupBy("url").agg(first("title"), first("snippet"), F.min("seq").alias("seq"))


def numbered_legend(legend: DataFrame, pool: DataFrame) -> DataFrame:
    """(number, url, title) of a legend (number, url), titles from the pool, the URL where there is none."""
    return legend.join(pool.select("url", "title"), "url", "left").select("number", "url", F.coalesce("title", "url").alias("title"))


def risk_view(active: DataFrame, passages: DataFrame, edges: DataFrame, top_entities: int = 10, top_passages: int = 10) -> DataFrame:
    """(source, target, weight): edges from top active entities (id, score) to top passages (hash_id, score), and a uniform first layer.

    Only entities with an edge to a top passage count.
    """
    p = passages.orderBy(F.desc("score"), "hash_id").limit(top_passages).select(F.col("hash_id").alias("passage"))
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    hit = both.join(p, F.col("target") == F.col("passage"), "left_semi").join(active.select(F.col("id").alias("source"), "score"), "source")
    kept = hit.groupBy("source").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "source").limit(top_entities)
    second = hit.drop("score").join(kept.select("source"), "source", "left_semi").select(F.concat(F.lit("rf_"), "source").alias("source"), "target", "weight")
    n = kept.agg(F.count("*").alias("n"))
    first = kept.crossJoin(n).select(F.lit("customer").alias("source"), F.concat(F.lit("rf_"), "source").alias("target"), (1.0 / F.col("n")).alias("weight"))
    return first.unionByName(second)


def grep(docs: DataFrame, id_col: str, text_col: str, pattern: str, around: int = 0) -> DataFrame:
    """(id, line_no, line, hit): lines that match, case aside, and lines around them; array work within the row."""
    lines = F.split(text_col, "\n")
    hit = F.transform(lines, lambda x: x.rlike("(?i)" + pattern))
    d = docs.select(id_col, lines.alias("_l"), hit.alias("_h")).filter(F.exists("_h", lambda x: x))
    rows = d.select(id_col, "_h", F.posexplode("_l").alias("_p", "line"))
    window = F.slice("_h", F.greatest(F.col("_p") + 1 - around, F.lit(1)), F.least(F.col("_p") + 1, F.lit(around + 1)) + around)
    return rows.filter(F.exists(window, lambda x: x)).select(id_col, (F.col("_p") + 1).alias("line_no"), "line", F.element_at("_h", F.col("_p") + 1).alias("hit"))


def units(table: DataFrame, kind: str, scope: DataFrame | None = None) -> DataFrame:
    """Sorted ids of files, sections, pages, passages or table rows, of the scope's files (file_id) only if there is one."""
    names = {"file": "file_id", "section": "section_id", "page": "page_id", "passage": "passage_id", "table_row": "table_row_id"}
    if kind not in names:
        raise ValueError(f"unknown unit {kind}")
    rows = table if scope is None else table.join(scope.select("file_id").distinct(), "file_id", "left_semi")
    return rows.select(names[kind]).distinct().orderBy(names[kind])


def audit(log: DataFrame, action: str | None = None, target: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of log rows (id, action, target, at), newest first."""
    if action is not None:
        log = log.filter(F.col("action") == action)
    if target is not None:
        log = log.filter(F.col("target") == target)
    return log.orderBy(F.desc("at"), F.desc("id")).offset(offset).limit(limit)


def settings(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value) with overrides; all or none: an unknown key is an error."""
    odd = overrides.join(defaults, "key", "left_anti").limit(1).collect()
    if odd:
        raise ValueError(f"unknown setting {odd[0]['key']}")
    return defaults.join(overrides.withColumnRenamed("value", "_v"), "key", "left").select("key", F.coalesce("_v", "value").alias("value"))


def costs(usage: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """usage (model, tokens_in, tokens_out) with its cost: price per million of the first key that the model's name holds."""
    price_in, price_out = F.lit(0.0), F.lit(0.0)
    for key, a, b in reversed(prices):
        hit = F.contains(F.lower("model"), F.lit(key.lower()))
        price_in, price_out = F.when(hit, a).otherwise(price_in), F.when(hit, b).otherwise(price_out)
    return usage.withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 6))


def graph_sample(edges: DataFrame, n: int) -> DataFrame:
    """The first edges, in order of (src, dst), that touch at most n nodes: a small view for display, n from 10 to 500.

    The edges needed are at most those among n nodes in order; they are found on a bounded, ordered head.
    """
    n = min(max(n, 10), 500)
    head = edges.select("src", "dst", "weight").orderBy("src", "dst").limit(n * n)
    w = Window.orderBy("src", "dst")
    ends = head.withColumn("_k", F.row_number().over(w))
    seen = ends.select(F.explode(F.array("src", "dst")).alias("node"), "_k").groupBy("node").agg(F.min("_k").alias("_k"))
    new = seen.groupBy("_k").agg(F.count("*").alias("_new"))
    run = ends.join(new, "_k", "left").withColumn("_nodes", F.sum(F.coalesce("_new", F.lit(0))).over(Window.orderBy("_k")))
    return run.filter(F.col("_nodes") <= n).select("src", "dst", "weight")


def tokens_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)))).alias("token"))
