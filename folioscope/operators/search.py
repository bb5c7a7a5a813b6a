"""Ranking channels and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scores, vectors
from folioscope.functions import text as X
from folioscope.operators.graph import written
from folioscope.operators.order import top_per_group

#: Rows of a query table that may be broadcast; larger ones are joined by a shuffle.
QUERY_ROWS = 10_000

#: Probes that are sent to the tasks at once.
PROBES = 10_000
#: Numbers of one block of vectors, and scores that a task holds at once, about.
VALUES, CELLS = 6_400_000, 4_000_000


def small(df: DataFrame, rows: int = QUERY_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(query_id, <id_col>, score, rank): the k best documents of each query (query_id, text).

    Only words of queries are counted by document; lengths come from one narrow pass. Words of queries
    are few and reach the documents by a broadcast if they are counted to be.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
    words = terms.select("word").distinct()
    few = F.broadcast if words.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS else lambda x: x
    listed = docs.select(id_col, X.words(F.col(text_col)).alias("_words"))
    totals = listed.agg(F.count("*").alias("n_docs"), F.avg(F.size("_words").cast("double")).alias("mean"))
    tf = listed.select(id_col, F.size("_words").alias("length"), F.explode("_words").alias("word")).join(few(words), "word")
    tf = tf.groupBy(id_col, "word").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(totals)).select("word", "mean", scores.bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    hit = tf.join(few(idf), "word").join(small(terms), "word")  # idf has no more rows than words
    total = hit.groupBy("query_id", id_col).agg(F.round(F.sum(scores.bm25(F.col("tf"), F.col("length"), F.col("mean"), F.col("idf"))), 6).alias("score"))
    return top_per_group(total, ["query_id"], [F.desc("score"), F.asc(id_col)], k)


def dense(vectors_df: DataFrame, probes: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(probe, <id_col>, score, rank): the k rows of largest inner product for each stated probe, its own row aside."""
    rows = vectors_df.select(id_col, vector_col).filter(F.col(id_col).isNotNull())
    asked = probes.select(F.col(id_col).alias("probe"), F.col(vector_col).alias("_q")).filter("probe IS NOT NULL")
    return largest_products(rows, asked, id_col, vector_col, k, F.col("probe") != F.col(id_col))


def largest_products(rows: DataFrame, probes: DataFrame, id_col: str, vector_col: str, k: int, other: Column | None = None) -> DataFrame:
    """(probe, <id_col>, score, rank): the k rows of largest inner product for each probe (probe, _q).

    other, if given, says that a row is not the probe's own, which is left out. Rows are dealt to blocks of about VALUES
    numbers, written once. The probes, counted and sent to the tasks in blocks of about PROBES, meet each block of rows as
    two matrices; of each pair of blocks only rows that can be among the k best come out, with their exact scores.
    Vectors with nulls, infinities or a length of their own are compared one by one.
    """
    r, p = rows.select(id_col, vector_col), probes.select("probe", "_q")
    numbers = r.schema[vector_col].dataType.elementType.simpleString()
    kind = f"array<{numbers if numbers in ('float', 'double') else 'double'}>"
    long = r.agg(F.count("*").alias("n"), F.mode(F.when(F.col(vector_col).isNotNull(), F.size(vector_col))).alias("size")).first()
    solid = lambda v: F.coalesce((F.size(v) == (long.size or 0)) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    parallel = min(r.sparkSession.sparkContext.defaultParallelism, long.n // 1_000)
    blocks = max(long.n * (long.size or 0) // VALUES + 1, parallel)
    packed = r.filter(solid(F.col(vector_col))).groupBy(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("_block"))
    packed = written(packed.agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"))).alias("_rows")).select("_rows"), "dense-rows")
    types = [df.schema[c].dataType.simpleString() for df, c in ((p, "probe"), (r, id_col))]
    own = other is not None
    found = []
    for block in probe_blocks(p.filter(solid(F.col("_q"))), "probe"):
        asked = block.agg(F.collect_list(F.struct(F.col("probe").alias("id"), F.col("_q").cast(kind).alias("v"))).alias("_probes"))
        both = packed.join(F.broadcast(asked), F.size("_probes") > 0)
        found.append(both.mapInArrow(lambda batches: _best_of_blocks(batches, k, own), f"probe {types[0]}, {id_col} {types[1]}, _s double"))
    odd_rows, odd_probes = r.filter(~solid(F.col(vector_col))), p.filter(~solid(F.col("_q")))
    pairs = [(odd_rows, p)] if odd_rows.limit(1).count() else []
    pairs += [(r.filter(solid(F.col(vector_col))), odd_probes)] if odd_probes.limit(1).count() else []
    for some, asked in pairs:
        for block in probe_blocks(asked, "probe"):
            both = some.join(F.broadcast(block), F.lit(True) if other is None else other)
            found.append(both.select("probe", id_col, vectors.dot(F.col(vector_col), F.col("_q")).alias("_s")))
    out = None
    for part in found:
        best = top_per_group(part.select("probe", id_col, F.round("_s", 6).alias("score")), ["probe"], [F.desc("score"), F.asc(id_col)], k)
        out = best if out is None else out.unionByName(best)
    return out if not pairs else top_per_group(out.drop("rank"), ["probe"], [F.desc("score"), F.asc(id_col)], k)


def _best_of_blocks(batches: Iterator[pa.RecordBatch], k: int, own: bool) -> Iterator[pa.RecordBatch]:
    """(probe, id, exact inner product) of the rows of a block that can be among a probe's k best of rounded score."""
    for batch in batches:
        for i in range(batch.num_rows):
            (ids, x), (asked, q) = _matrix(batch.column(0)[i]), _matrix(batch.column(1)[i])
            plain = lambda a: a.to_pandas(integer_object_nulls=True).to_numpy()
            codes = pd.factorize(np.concatenate([plain(ids), plain(asked)]) if own else plain(ids), sort=True)[0]
            order = np.argsort(codes[: len(x)], kind="stable")
            first, last = (np.searchsorted(codes[order], codes[len(x) :], side) for side in ("left", "right"))
            without = [order[a:b] for a, b in zip(first, last, strict=True)]
            step = max(1, CELLS // len(x))
            for at in range(0, len(q), step):
                near = q[at : at + step] @ x.T
                for row, same in zip(near, without[at : at + step], strict=False):  # without is empty if no row is a probe's own
                    row[same] = -np.inf
                y, j, s = candidates(x, q[at : at + step], near, k)
                y, j, s = front(y, j, s, codes[j], k)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(y + at)), ids.take(pa.array(j)), pa.array(s)], names=["probe", "id", "_s"])


def _matrix(cell: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
    rows = cell.values
    v = rows.field("v")
    return rows.field("id"), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def candidates(x: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of probes and rows, and scores: all rows that by near, their matrix product, are about as near as the k-th or nearer.

    The largest scores of k or more runs of rows give a bound for the k-th; the sums are then made in the vectors' order.
    least, if given, is a bound that each probe has already. Rows at -inf are left out.
    """
    run = max(1, min(64, len(x) // (4 * k)))
    whole = len(x) // run * run
    tops = np.c_[near[:, :whole].reshape(len(q), -1, run).max(2), near[:, whole:]]
    bound = np.partition(tops, tops.shape[1] - k, 1)[:, tops.shape[1] - k] if tops.shape[1] > k else np.full(len(q), -np.inf)
    if least is not None:
        bound = np.maximum(bound, least)
    slack = 2e-6 + 1e-12 * np.linalg.norm(q, axis=1) * np.sqrt((x * x).sum(1).max())
    y, j = np.nonzero((near >= (bound - slack)[:, None]) & (near > -np.inf))
    s = np.zeros(len(y))
    for at in range(0, len(y), 100_000):
        a, b = q[y[at : at + 100_000]], x[j[at : at + 100_000]]
        for d in range(x.shape[1]):
            s[at : at + 100_000] += b[:, d] * a[:, d]
    return y, j, s


def front(y: np.ndarray, j: np.ndarray, s: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What can be among a probe's k best once scores are rounded to six places: of one score the k least ids at most."""
    by = np.lexsort((code, -s, y))
    y, j, s = y[by], j[by], s[by]
    at = np.arange(len(y))
    new = np.r_[True, y[1:] != y[:-1]][: len(y)]
    start = np.maximum.accumulate(np.where(new, at, 0))
    kth = np.full(int(y.max()) + 1 if len(y) else 0, -np.inf)
    edge = at - start == k - 1
    kth[y[edge]] = s[edge]
    run = np.maximum.accumulate(np.where(new | np.r_[True, s[1:] != s[:-1]][: len(y)], at, 0))
    keep = (s >= kth[y] - 2e-6) & (at - run < k)
    return y[keep], j[keep], s[keep]


def probe_blocks(probes: DataFrame, key: str) -> list[DataFrame]:
    """The probes in blocks of about PROBES, dealt by the hash of the key."""
    parts = probes.count() // PROBES + 1
    return [probes if parts == 1 else probes.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


def page_scores(hits: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Hits folded to pages by the saturating score, best hit kept."""
    out = hits.groupBy(*keys).agg(F.round(scores.saturating(F.col("score")), 6).alias("score"), F.count("*").alias("n_hits"), F.max("score").alias("best"))
    return out if k is None else out.orderBy(F.desc("score"), *keys).limit(k)


def fuse(channels: DataFrame, keys: list[str], k: int = scores.RRF_K, top: int = 30, query: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (channel, keys, rank); with query columns, the best of each query and their rank."""
    if query:
        out = fused(channels, [*query, *keys], k)
        return top_per_group(out, query, [F.desc("score"), *map(F.asc, keys)], top)
    return fused(channels, keys, k).orderBy(F.desc("score"), *keys).limit(top)


def fused(channels: DataFrame, keys: list[str], k: int = scores.RRF_K) -> DataFrame:
    """(keys, score, n_channels) of all rows (channel, keys, rank)."""
    return channels.groupBy(*keys).agg(F.round(F.sum(scores.reciprocal_rank(F.col("rank"), k)), 9).alias("score"), F.count_distinct("channel").alias("n_channels"))


def regex_hits(docs: DataFrame, patterns: list[tuple[str, str, float]], id_col: str, text_col: str, per_page: int = 5) -> DataFrame:
    """(pattern, id, match, score, rank): matches of weighted patterns, the best few of each page.

    Patterns are a driver-side list; each becomes an expression over the text, so the scan stays in one pass.
    """
    found = F.array(
        *[F.struct(F.lit(name).alias("pattern"), F.lit(w).alias("weight"), F.lit(rx).alias("rx"), F.regexp_extract_all(F.col(text_col), F.lit(rx), F.lit(0)).alias("hits")) for name, rx, w in patterns]
    )
    per = docs.select(id_col, F.length(text_col).alias("_len"), F.explode(found).alias("f")).select(id_col, "_len", "f.*").filter(F.size("hits") > 0)
    n = docs.agg(F.count("*").alias("n_docs"))
    df = per.groupBy("pattern").agg(F.count("*").alias("df")).crossJoin(n)
    one = per.select(id_col, "_len", "pattern", "weight", "rx", F.explode(F.array_distinct(F.transform("hits", F.lower))).alias("match"))
    one = one.join(F.broadcast(df), "pattern")  # one row for each pattern of the list
    plain = F.col("match").rlike(r"^[\p{N}\p{P} ]+$")
    score = scores.regex_score(F.col("weight"), F.col("n_docs"), F.col("df"), F.length("match") / F.lit(10.0), plain, X.is_broad(F.col("rx")))
    scored = one.select(id_col, "pattern", "match", F.round(score, 6).alias("score"))
    return top_per_group(scored, [id_col], [F.desc("score"), F.asc("pattern"), F.asc("match")], per_page)


def within_scope(df: DataFrame, files: list[str] | None = None, pages: tuple[int, int] | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Scope as AND of a file set, a page range and a union of section spans; null pages fail ranges."""
    if files:
        df = df.filter(F.col("file_id").isin([f.removesuffix(".pdf") for f in files]))
    if pages:
        if not 1 <= pages[0] <= pages[1]:
            raise ValueError(f"page range {pages}")
        df = df.filter(F.col("page").between(*pages))
    if sections is not None:
        s = sections.select(F.col("file_id").alias("_f"), "page_start", "page_end")
        df = df.join(s, (F.col("file_id") == F.col("_f")) & F.col("page").between(F.col("page_start"), F.col("page_end")), "left_semi")
    return df


def where_equal(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """AND of equalities; a column that isn't there gives no rows."""
    for name, value in wanted.items():
        df = df.filter(F.col(name) == F.lit(value)) if name in df.columns else df.filter(F.lit(False))
    return df


def columns_or_null(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def needle_score(text: Column, needles: list[str]) -> Column:
    """How often words of two letters or more stand in a text, case aside."""
    low = F.lower(text)
    out = F.lit(0)
    for x in needles:
        if len(x) >= 2:
            out = out + F.regexp_count(low, F.lit(r"\Q" + x.lower() + r"\E"))
    return out
