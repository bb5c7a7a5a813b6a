"""Groups of spelling variants: words one edit apart, each pointed at a much more frequent neighbour.

Two words of at most M code points, at least one of them of M, are one edit apart exactly if their common prefix and
common suffix together reach M - 1. They are found in dense tiles: words are laid out as padded matrices of code
points, from the left and from the right, blocks of rows are compared with one another whole, and prefix and suffix
lengths are read off the comparison.

Only blocks that can hold such pairs meet. A pair of length M whose common prefix has lo <= p < hi code points agrees
in the first lo and in the last M - hi: words are dealt out by (M, lo, hi) and those two pieces, starting from the
left and the right half. Each pair has one p, so it is met in one window only. A group of more than GROUP words is
dealt out anew by the two halves of its window, until its groups are small; in a window of one place words can
differ in one code point only, so every group ends small. Nothing is capped.

Tiles send on, for each word, the number of its neighbours and the best of them, not the pairs.

Words are maximal runs of Latin letters of which only A-Z are lower-cased; `corrupt` may take one code point out of a
run first. Defined cases: a null text has no words; a null id is read as an empty one; ties of frequency go to the
smaller word in code-point order; repeated rows count each; very long texts are read whole and very long words
are compared in blocks of fewer rows; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import crc32_sql, id_and_text, record_batch, small_batches, stored, table

LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
#: One run in so many, by checksum, loses a code point before it is counted.
CORRUPT = 97
#: Distinct words that a task counts before it passes the counts on.
HELD = 200_000
#: Words of a group that is compared without being dealt out anew.
GROUP = 2048
#: Rows of a block, and cells (rows x rows x width) that are compared at a time.
BLOCK = 64
CELLS = 1 << 22

_LOWER = {c: c + 32 for c in range(65, 91)}
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt: int = CORRUPT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least least_length code points that occur at least least_count times."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall((text or "").translate(_LOWER))).items():
                    if len(run) >= least_length:
                        if corrupt and (h := zlib.crc32(run.encode(), before)) % corrupt == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        held[run] += n
                if len(held) >= HELD:
                    yield record_batch(schema, word=list(held.keys()), n=list(held.values()))
                    held.clear()
        yield record_batch(schema, word=list(held.keys()), n=list(held.values()))

    source = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = source.mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


def _piece(lo, hi):
    """A key of what words of a window (m, lo, hi) have in common: the first lo and the last m - hi code points."""
    return F.xxhash64(F.col("m"), lo, hi, F.substring("word", F.lit(1), lo), F.when(F.col("m") > hi, F.right("word", F.col("m") - hi)).otherwise(""))


def _windows(words: DataFrame) -> DataFrame:
    """Each row (word, n, m, lo, hi) in the two halves of its window, with the keys of their groups."""
    mid = F.col("lo") + F.ceil((F.col("hi") - F.col("lo")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))).alias("w")
    found = words.select("word", "n", "m", halves).select("word", "n", "m", "w.lo", "w.hi").filter("lo < hi")
    return found.withColumn("key", _piece(F.col("lo"), F.col("hi")))


def _tile(schema: pa.Schema):
    """Compares rows of one m that stand in the order of their keys; yields (word, near, best_n, best)."""

    def matrices(words: list[str], length: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Code points from the left and, backwards, from the right, padded with what is no code point."""
        size = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        row = np.repeat(np.arange(size), length)
        place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
        left, right = np.full((size, m), -1, np.int32), np.full((size, m), -1, np.int32)
        left[row, place] = points
        right[row, np.repeat(length, length) - 1 - place] = points
        return left, right

    def compared(m: int, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[str], n: np.ndarray) -> pa.RecordBatch | None:
        size = len(words)
        length = np.fromiter(map(len, words), np.int64, size)
        a_all, b_all = [], []
        height = min(BLOCK, max(1, int((CELLS // m) ** 0.5)))
        for i in range(0, size, height):
            x = slice(i, i + height)
            last = key[min(size, i + height) - 1]
            one = matrices(words[x], length[x], m)
            for j in range(i, size, height):
                if j > i and key[j] != last:
                    break
                y = slice(j, j + height)
                may = (key[x, None] == key[None, y]) & (length[x, None] + length[None, y] >= 2 * m - 1)
                if i == j:
                    may = np.triu(may, 1)
                if not may.any():
                    continue
                two = one if i == j else matrices(words[y], length[y], m)
                prefix, suffix = ((p[:, None, :] != q[None, :, :]).argmax(2) for p, q in zip(one, two, strict=True))
                may &= (prefix + suffix >= m - 1) & (prefix >= lo[x, None]) & (prefix < hi[x, None])
                a, b = np.nonzero(may)
                a_all.append(a + i)
                b_all.append(b + j)
        if not a_all or not sum(map(len, a_all)):
            return None
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        rank = np.empty(size, np.int64)
        rank[np.array(sorted(range(size), key=words.__getitem__))] = np.arange(size)
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        at = np.flatnonzero(first)
        near = np.diff(np.append(at, len(a)))
        best = b[at]
        return record_batch(schema, word=[words[k] for k in a[at].tolist()], near=near, best_n=n[best], best=[words[k] for k in best.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], [], []]  # m, key, lo, hi, word, n
        def flush(to: int):
            m, key, lo, hi, words, n = (c[:to] for c in held)
            for c in held:
                del c[:to]
            at = 0
            while at < to:  # rows of one m at a time
                end = at + m[at:].count(m[at])
                made = compared(m[at], np.array(key[at:end]), np.array(lo[at:end]), np.array(hi[at:end]), words[at:end], np.array(n[at:end], np.int64))
                if made is not None:
                    yield made
                at = end

        for batch in batches:
            for k, c in enumerate(batch.columns):
                held[k].extend(c.to_pylist())
            # The last group may go on in the next batch.
            whole = len(held[1])
            while whole and held[1][whole - 1] == held[1][-1] and held[0][whole - 1] == held[0][-1]:
                whole -= 1
            cells = held[0][-1] * len(held[0]) if held[0] else 0
            if whole and (whole >= 4 * BLOCK or cells >= CELLS):
                yield from flush(whole)
        yield from flush(len(held[1]))

    return run


def neighbours(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best) for each of the distinct words (word, n) that has a neighbour one edit away.

    best is the neighbour of the largest n, in ties the smallest word.
    """
    length = F.char_length("word")
    lengths = F.explode(F.array(length, length + 1)).alias("m")  # as the longer or as long, and as the shorter one
    now = _windows(words.select("word", "n", lengths).select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi")))
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    found = None
    while now is not None:
        now = stored(now, "spelling-windows")
        sizes = now.groupBy("m", "key").agg(F.count("*").alias("size"), F.max(F.char_length("word")).alias("long"), F.max(F.col("hi") - F.col("lo")).alias("wide"))
        # A group without a word of the full length has pairs of another length only; one of a single word has none.
        large = stored(sizes.filter((F.col("size") > group) & (F.col("wide") > 1)).select("m", "key", "long"), "spelling-large")
        n_large = large.count()
        rows = now if not n_large else now.join(large.select("m", "key"), ["m", "key"], "left_anti")
        dealt = rows.repartition("m", "key").sortWithinPartitions("m", "key").select("m", "key", "lo", "hi", "word", "n")
        tiles = stored(dealt.mapInArrow(_tile(schema), "word string, near bigint, best_n bigint, best string"), "spelling-tiles")
        found = tiles if found is None else found.unionByName(tiles)
        now = _windows(now.join(large.filter("long = m").select("m", "key"), ["m", "key"]).drop("key")) if n_large else None
    best = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", (-F.col("b.down")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the chain of forms, found by doubling steps.

    A form is more frequent by a factor than its word, so chains end and are short.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = joined.select("word", "root")
        if not joined.filter("moved").limit(1).count():
            return now


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt: int = CORRUPT, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word that is frequent enough.

    form is the most frequent neighbour, if it is at least `times` as frequent.
    """
    words = stored(word_counts(docs, id_col, text_col, corrupt, least_length, least_count), "spelling-words")
    near = neighbours(words)
    good = F.col("best_n") >= times * F.col("n")
    named = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")
    )
    named = stored(named, "spelling-forms")
    ends = roots(named.filter("form IS NOT NULL"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = (
    r"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  GROUP BY ALL
),
hashed AS MATERIALIZED (SELECT run, n, CRC AS h FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS name FROM runs WHERE length(run) >= 5)),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5
  GROUP BY word HAVING sum(n) >= 3
),
cuts AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut, i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM pairs GROUP BY word),
named AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
chain(word, last) AS (
  SELECT word, word FROM named
  UNION ALL
  SELECT c.word, m.form FROM chain c JOIN named m ON c.last = m.word WHERE m.form IS NOT NULL
)
SELECT word, form, last AS root, n, n_near, form_n
FROM chain JOIN named USING (word)
WHERE last IN (SELECT word FROM named WHERE form IS NULL)
""".replace("CRC", crc32_sql("name"))
)
