"""Importance resampling towards a target distribution.

Features are runs of 1 to 3 consecutive words, hashed into BUCKETS buckets. Two passes read the texts: the first
counts buckets of the source and of the target, the second scores every row by the gains of its features in one
array look-up. Row scores get Gumbel noise drawn from the id, so that the highest scores are a sample without
replacement in proportion to the importance weights, and the same one in every run.

Exact ranks come from parallel sorting by regular sampling: each task sorts its rows into runs, a regular sample of
the runs gives splitters, the runs are cut at the splitters and exchanged, each segment merges its pieces, and
prefix counts of the segments turn places into ranks. The order is (score down, id up, row), and every row has its
own number, so equal scores or ids can't crowd a segment.

CRC-32 of a run of words is combined from those of its words: appending n bytes is a linear map of the checksum, held
as four tables of 256 entries for each n.

Defined cases: a null or empty text has no words, weight 0 and no rank; a null id is drawn as an empty one and comes last
among equal scores; repeated rows are each scored and ranked; a long text is read a piece at a time, whole; an
empty target has T = 0; an empty source gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import crc32_sql, id_and_text, record_batch, small_batches, stored, table

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Words that are hashed at a time.
GROUP_WORDS = 1 << 15
#: Rows of a sorted run, of a segment at least, and regular samples in all.
RUN_ROWS = 1 << 19
SEGMENT_ROWS = 1 << 19
SAMPLES = 1 << 18

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Shift:
    """crc(a + b) = shift(crc(a), len(b)) ^ crc(b), over arrays of checksums and lengths."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
        self.byte = step
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.powers = [(bits >> np.uint32(8)) ^ step[bits & np.uint32(255)]]  # of one byte: images of the 32 bits
        self.row = np.full(64, -1, np.int64)  # by length: its place in tables
        self.tables = np.empty(0, np.uint32)  # 4 tables of 256 entries for each length

    def _image(self, matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for b in range(32):
            out ^= np.where(x >> np.uint32(b) & np.uint32(1), matrix[b], np.uint32(0))
        return out

    def _add(self, length: int) -> None:
        now, left, k = np.uint32(1) << np.arange(32, dtype=np.uint32), length, 0
        while left:
            if k == len(self.powers):
                self.powers.append(self._image(self.powers[-1], self.powers[-1]))
            if left & 1:
                now = self._image(self.powers[k], now)
            left, k = left >> 1, k + 1
        made = np.stack([self._image(now, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
        if length >= len(self.row):
            self.row = np.concatenate([self.row, np.full(length * 2 - len(self.row), -1, np.int64)])
        self.row[length] = len(self.tables)
        self.tables = np.concatenate([self.tables, made.ravel()])

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(crc):
            return crc
        if lengths.max() >= len(self.row) or self.row.take(lengths).min() < 0:
            for n in np.unique(lengths).tolist():
                if n >= len(self.row) or self.row[n] < 0:
                    self._add(n)
        at = self.row.take(lengths)
        out = self.tables.take(at + (crc & np.uint32(255)))
        for i in range(1, 4):
            at += 256
            out ^= self.tables.take(at + (crc >> np.uint32(8 * i) & np.uint32(255)))
        return out


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in UTF-8, some of them at a time."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + PIECE)
        held = raw[at:end].translate(_WORD_BYTES)
        if end < n:
            # The last word may go on: it is left to the next piece, or grown where it fills this one.
            cut = held.rfind(b" ", 1)
            while cut < 0 and end < n:
                more = raw[end : end + PIECE].translate(_WORD_BYTES)
                end += len(more)
                cut = more.find(b" ")
                held += more
                cut = cut if cut < 0 else len(held) - len(more) + cut
            if cut >= 0:
                held, end = held[:cut], at + cut
        at = end
        if words := held.split():
            yield words


class Hasher:
    """Bucket numbers of the features of texts; lives in one task."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest, self.shift = buckets, longest, Shift()

    def __call__(self, raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of its text for each word, the same for each feature, buckets of the features), many words at a time."""
        words: list[bytes] = []
        spans: list[tuple[int, int, int]] = []  # place of the text, words that are there again, words
        for k, raw in enumerate(raws):
            before: list[bytes] = []
            for own in pieces(raw or b""):
                spans.append((k, len(before), len(before) + len(own)))
                words += before
                words += own
                # Runs may begin in the piece before: its last words come again.
                before = (before + own)[-(self.longest - 1) :] if self.longest > 1 else []
                if len(words) >= GROUP_WORDS:
                    yield self._hashed(words, spans)
                    words, spans = [], []
        if words:
            yield self._hashed(words, spans)

    def _hashed(self, words: list[bytes], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, again, size = np.array(spans, np.int64).T
        first = np.cumsum(size) - size
        span = np.repeat(np.arange(len(spans)), size)
        new = np.arange(len(words)) - first[span] >= again[span]
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        spaced = self.shift(np.full(len(words), zlib.crc32(b" "), np.uint32), length) ^ crc
        length += 1
        own = span[new]
        found, texts, run = [crc[new]], [text[own]], crc
        for n in range(2, self.longest + 1):
            run = self.shift(run[:-1], length[n - 1 :]) ^ spaced[n - 1 :]
            whole = (span[: len(run)] == span[n - 1 :]) & new[n - 1 :]
            found.append(run[whole])
            texts.append(text[span[n - 1 :][whole]])
        return texts[0], np.concatenate(texts), np.concatenate(found) % np.uint32(self.buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task sends its sums once."""
    small_batches(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in hasher(batch.column(0).to_pylist()):
                total += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(total)
        yield record_batch(schema, bucket=own.astype(np.int32), n=total[own])

    found = texts.select(F.encode(text_col, "UTF-8").alias("raw")).mapInArrow(counted, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's shares), one long a bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """floor(1000 times a Gumbel draw) from the id; rounded as the score is."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row."""
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    number = source.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    kind, arrow = ("bigint", pa.int64()) if number else ("string", pa.string())
    names = ("n_words", "n_features", "weight", "score")
    schema = pa.schema([("doc_id", arrow), *((x, pa.int64()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(gain), longest)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words, features, weight = np.zeros((3, len(ids)), np.int64)
            for of_words, of_features, found in hasher(batch.column(1).to_pylist()):
                words += np.bincount(of_words, minlength=len(ids))
                features += np.bincount(of_features, minlength=len(ids))
                weight += np.bincount(of_features, gain[found], len(ids)).astype(np.int64)  # sums of longs far below 2**53
            score = weight + np.array([noise(x, seed) for x in ids], np.int64)
            yield record_batch(schema, doc_id=ids, n_words=words, n_features=features, weight=weight, score=score)

    texts = source.select(F.col("doc_id").cast(kind).alias("doc_id"), F.encode("text", "UTF-8").alias("raw"))
    return texts.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} bigint" for x in names))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The task's rows as sorted runs of at most RUN_ROWS and one batch."""

    def cut(held: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(held).sort_by([("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= RUN_ROWS:
            yield cut(held)
            held, n = [], 0
    if n:
        yield cut(held)


def _order(x: tuple) -> tuple:
    """The sort key of (score, doc_id, row), null ids last."""
    return (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])


def ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, score, row and more columns) with exact ranks 1, 2, 3 ... by score down, doc_id up, row up.

    row has to be unique. A segment holds about n / segments rows whatever the scores are.
    """
    spark = rows.sparkSession
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS))
    step = max(1, n // max(1, min(SAMPLES, 64 * parts)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            yield from run.select(["score", "doc_id", "row"]).take(pa.array(np.arange(step // 2, run.num_rows, step))).combine_chunks().to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    samples = sorted(map(tuple, rows.mapInArrow(sampled, f"score bigint, doc_id {kind}, row bigint").collect()), key=_order)
    splitters = [samples[len(samples) * k // parts] for k in range(1, parts)] if len(samples) >= parts else samples
    splitters = sorted(set(splitters), key=_order)
    kept = rows.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            score, ids, row = (run.column(c).to_pylist() for c in ("score", "doc_id", "row"))
            ends = []
            for s in splitters:  # the run is sorted: each splitter is sought in it, not each row among the splitters
                low, high = ends[-1] if ends else 0, len(score)
                key = _order(s)
                while low < high:
                    mid = (low + high) // 2
                    if _order((score[mid], ids[mid], row[mid])) < key:
                        low = mid + 1
                    else:
                        high = mid
                ends.append(low)
            sizes = np.diff([0, *ends, len(score)])
            segment = pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
            yield from run.append_column("_segment", segment).combine_chunks().to_batches(max_chunksize=100_000)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).sort_by([("_segment", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
            segment = whole.column("_segment").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1])
            place = np.arange(len(segment)) - np.repeat(first, np.diff(np.append(first, len(segment))))
            yield from whole.append_column("_place", pa.array(place, pa.int64())).combine_chunks().to_batches(max_chunksize=100_000)

    dealt = rows.mapInArrow(cut, types + ", _segment int").repartitionById(parts, "_segment")
    segments = stored(dealt.mapInArrow(merged, types + ", _segment int, _place bigint"), "ranked-segments")
    before, total = [], 0
    sizes = {r["_segment"]: r["count"] for r in segments.groupBy("_segment").count().collect()}  # one row a segment
    for k in range(len(splitters) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offsets = F.broadcast(spark.createDataFrame(list(enumerate(before)), "_segment int, _before bigint"))
    return segments.join(offsets, "_segment").select(*kept, (F.col("_before") + F.col("_place") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row; rank is null for rows that aren't drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = stored(scored(docs, gain, id_col, text_col, seed).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    order = ranked(enough)
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return order.unionByName(rest).drop("row")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = (
    r"""
WITH words AS MATERIALIZED (
  SELECT 'd' AS side, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (),
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
),
grams AS MATERIALIZED (
  SELECT side, id, array_to_string(w[i : i + n - 1], ' ') AS g, count(*) AS n
  FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS n)) AS x
  GROUP BY ALL
),
names AS MATERIALIZED (
  SELECT g, CRC % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams)
),
sums AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM grams JOIN names USING (g) GROUP BY bucket),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t_all FROM grams),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS v
  FROM sums, totals
),
weights AS (SELECT id, sum(n * v)::BIGINT AS weight FROM grams JOIN names USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT id AS doc_id, len(w) AS n_words, (len(w) + greatest(0, len(w) - 1) + greatest(0, len(w) - 2))::BIGINT AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'
),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)
""".replace("CRC", crc32_sql("g"))
)
