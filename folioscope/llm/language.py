"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte n-grams of two to four bytes within words, word ends included, are hashed to BUCKETS embeddings.
A text is the mean of its n-grams' embeddings; a softmax over a linear map of it gives the languages.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. A part of
the sample is kept for calibration: a temperature makes the scores probabilities, and the lowest score at
which no more than ERROR_RATE of the accepted rows are wrong becomes the rejection threshold.

Bound of the fit: PER_LANGUAGE rows for each language, those of the least hashes of id and text. Every document
is predicted over its whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without lang are not
learned from; with no labelled row all is `und`; repeated rows are predicted alike; of languages with equal scores
the first by name is taken; long texts are read in slices, which changes no result; an empty input gives no rows;
other columns are ignored.
Ids serve for the split and the sample only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import crc_mod, id_and_text, record_batch, small_batches, stored, table

BUCKETS = 1 << 16
WIDTH = 16
PER_LANGUAGE = 500
#: Languages whose sampling thresholds are broadcast at most.
BROADCAST_LANGUAGES = 100_000
EPOCHS = 8
BATCH = 32
RATE = 20.0
ERROR_RATE = 0.01
#: Bytes whose n-grams are hashed at once.
SLICE = 2_000_000

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def ngram_buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of the lower-cased text; no n-gram has a blank inside."""
    raw = b" " + (text or "").lower().encode().translate(_LETTERS) + b" "
    out = []
    for at in range(0, len(raw), SLICE):
        b = np.frombuffer(raw[at : at + SLICE + 3], np.uint8).astype(np.uint32)
        blank = b == 0x20
        h = b.copy()
        inside = np.zeros(len(b), bool)
        for n in (2, 3, 4):
            if len(b) < n:
                break
            keep = len(b) - n + 1
            h = h[:keep] * np.uint32(0x9E3779B1) + b[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
            inside = inside[:keep] | (blank[n - 2 : n - 2 + keep] if n > 2 else blank[:keep] & blank[1:])
            # The last slice's overlap belongs to the next one.
            end = min(keep, SLICE)
            out.append((h[:end][~inside[:end]] * np.uint32(0xC2B2AE35)) >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the linear map
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str | None) -> np.ndarray:
        h = ngram_buckets(text)
        if not len(h):
            return self.bias
        return np.array([np.take(column, h).mean(dtype=np.float64) for column in self.table.T]) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(histograms: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> Model:
    """histograms: (distinct buckets, shares of the text's n-grams) of each row."""
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_cal = len(y) // 5
    cal, fit_rows = order[:n_cal], order[n_cal:]
    emb = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    lin = np.zeros((WIDTH, len(names)), np.float32)
    bias = np.zeros(len(names))
    steps, done = max(1, EPOCHS * -(-len(fit_rows) // BATCH)), 0
    for _ in range(EPOCHS):
        for at in range(0, len(fit_rows), BATCH):
            rows = rng.permutation(fit_rows)[:BATCH] if at == 0 else fit_rows[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = np.stack([histograms[r][1].astype(np.float32) @ emb[histograms[r][0]] for r in rows])
            g = _softmax(mean @ lin + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ lin.T
            lin -= (rate * 0.5) * (mean.T @ g).astype(np.float32)
            bias -= 0.01 * g.sum(axis=0)
            for k, r in enumerate(rows):
                emb[histograms[r][0]] -= rate * np.outer(histograms[r][1], back[k]).astype(np.float32)
        rng.shuffle(fit_rows)
    folded = np.ascontiguousarray((emb @ lin).astype(np.float32))
    check = cal if len(cal) else fit_rows
    z = np.stack([histograms[r][1] @ folded[histograms[r][0]] + bias for r in check])
    # The temperature with the least loss on the calibration rows.
    grid = np.geomspace(0.02, 5, 60)
    # Targets are (n + 1) / (n + 2), so that a run of right answers doesn't make the model boundless.
    target = (len(check) + 1) / (len(check) + 2)
    own = [np.clip(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12, 1 - 1e-12) for t in grid]
    temperature = float(grid[int(np.argmin([-(target * np.log(q) + (1 - target) * np.log(1 - q)).mean() for q in own]))])
    p = _softmax(z / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    by = np.argsort(-score)
    wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
    fine = np.flatnonzero(wrong <= ERROR_RATE)
    return Model(names, folded, bias, temperature, float(score[by][fine[-1]]) if len(fine) else 1.0)


def last_draws(draws: DataFrame) -> DataFrame:
    """(lang, last): the draw of rank PER_LANGUAGE of each language, or its largest, of rows (lang, draw).

    A language's ranks are taken on one task, so its rows are cut first to a share of the draws' range in which twice
    PER_LANGUAGE of them are expected. Where fewer than needed lie there, as with many equal draws, nothing is cut:
    the ranks are the same with and without the cut.
    """
    sizes = draws.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.col("draw").cast("double") / F.lit(2.0**64) + 0.5
    share = F.lit(2.0 * PER_LANGUAGE) / F.col("n")
    sized = draws.join(_counted_small(sizes, draws), "lang")
    low = sized.groupBy("lang", "n").agg(F.sum((place < share).cast("long")).alias("low"))
    shares = stored(low.select("lang", F.when(F.col("low") >= F.least("n", F.lit(PER_LANGUAGE)), share).alias("share")), "language-shares")
    cut = draws.join(_counted_small(shares, shares), "lang").filter(F.col("share").isNull() | (place < F.col("share")))
    # The rank is cut in each task before the shuffle, too, and no text takes part in it.
    ranked = cut.select("lang", "draw", F.row_number().over(Window.partitionBy("lang").orderBy("draw")).alias("rank"))
    return ranked.filter(F.col("rank") <= PER_LANGUAGE).groupBy("lang").agg(F.max("draw").alias("last"))


def _counted_small(by_language: DataFrame, counted: DataFrame) -> DataFrame:
    """by_language with a broadcast hint if counted has at most BROADCAST_LANGUAGES languages."""
    few = counted.select("lang").distinct().limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    return F.broadcast(by_language) if few else by_language


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits a model to the labelled rows given; None if there are none."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text", F.lit("language")))
    last = stored(last_draws(stored(rows.select("lang", "draw"), "language-draws")), "language-last")
    languages = last.count()
    if not languages:
        return None
    last = F.broadcast(last) if languages <= BROADCAST_LANGUAGES else last
    chosen = rows.join(last, "lang").filter(F.col("draw") <= F.col("last")).select("doc_id", "lang", "text")

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])
        for batch in batches:
            at, n = [], []
            for text in batch.column(2).to_pylist():
                a, c = np.unique(ngram_buckets(text), return_counts=True)
                at.append(a.astype(np.int32))
                n.append((c / max(1, c.sum())).astype(np.float32))
            yield record_batch(schema, id=[str(x) for x in batch.column(0).to_pylist()], lang=batch.column(1), at=at, n=n)

    found = chosen.mapInArrow(histograms, "id string, lang string, at array<int>, n array<float>")
    # Order by id: the fit doesn't depend on how rows are dealt out. The limit cuts rows that are alike, if any.
    sample = found.limit(2 * PER_LANGUAGE * languages).toArrow()
    rows_ = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), _lists(sample.column(2)), _lists(sample.column(3)), strict=True), key=lambda x: (x[0], x[1]))
    return fit([(a, n) for _, _, a, n in rows_ if len(a)], [x for _, x, a, _ in rows_ if len(a)]) if any(len(r[2]) for r in rows_) else None


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        flat, ends = chunk.flatten().to_numpy(zero_copy_only=False), chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
        out.extend(flat[i:j] for i, j in zip(ends, ends[1:], strict=False))
    return out


def predict_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    if kind != "bigint":
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    source = source.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            made = [
                held.predict(t) if ok and held is not None else ("und", 0.0)
                for t, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            rejected = [held is None or x == "und" or p < held.threshold for x, p in made]
            yield record_batch(schema, doc_id=batch.column(0), lang_pred=[x for x, _ in made], score=[p for _, p in made], rejected=rejected)

    return source.mapInArrow(run, f"doc_id {'bigint' if kind == 'bigint' else 'string'}, lang_pred string, score double, rejected boolean")


def held_out(col: str = "doc_id"):
    return F.coalesce(crc_mod(col, 4) == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_documents(docs, train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
