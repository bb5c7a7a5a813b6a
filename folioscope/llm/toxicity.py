"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, unlabelled as they are, stands
for the mixture. A linear classifier over the presence of words and word beginnings is trained in numpy
on the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with logistic loss. Where the second term turns negative, its gradient is reversed, which keeps the
classifier from fitting the positives by heart. The prior is the share of toxic rows among the labelled
training rows.

Bounds of the fit: at most POSITIVES confirmed and UNLABELLED other rows, those of the least hashes of id and
text, and LEANING + COMMON weights. Every document is scored over its whole text.

Defined cases: a null or empty text is scored by the bias alone; null labels count as unlabelled; without
any confirmed row every score is the prior; repeated rows are scored alike; a score of exactly 0.5 is predicted
toxic; features that lean alike are chosen in the order of their names; a long text counts each feature once; an
empty input gives no rows; other columns are ignored. Ids serve for the split and the sample only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import crc_mod, id_and_text, record_batch, release_memory, small_batches, stored, table

POSITIVES = 3000
UNLABELLED = 9000
#: Weights: features that lean most towards the confirmed rows, and the commonest ones of the mixture.
LEANING = 1000
COMMON = 400
#: Confirmed rows that must hold a feature.
LEAST_ROWS = 3
BEGINNINGS = (4, 5, 6)
ROUNDS = 300
#: Prior where no row is labelled.
PRIOR = 0.1

WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> set[str]:
    """The text's lower-cased words, and their beginnings marked with a hyphen."""
    found = set(WORD.findall((text or "").lower()))
    for n in BEGINNINGS:
        found |= {w[:n] + "-" for w in found if len(w) > n and w[-1] != "-"}
    return found


#: Words whose known features a task remembers.
REMEMBERED = 200_000


class Known:
    """Finds the features of a text that are among those known; the result of each word is remembered."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.held: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        own = [w, *(w[:n] + "-" for n in BEGINNINGS if len(w) > n)]
        found = tuple(self.number[x] for x in own if x in self.number)
        if len(self.held) >= REMEMBERED:
            self.held.clear()
        self.held[w] = found
        return found

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        get = self.held.get
        for w in set(WORD.findall((text or "").lower())):
            found = get(w)
            if found is None:
                found = self.word(w)
            if found:
                out.update(found)
        return out


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from a text to its score."""
        known = Known({x: k for k, x in enumerate(self.features)})
        weights, bias = self.weights.tolist(), self.bias

        def score(text: str | None) -> float:
            z = bias + math.fsum(weights[k] for k in known(text))
            return 1.0 / (1.0 + math.exp(-min(max(z, -60.0), 60.0)))

        return score


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, rounds: int = ROUNDS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; rows and cols list the present features, positive marks confirmed rows."""
    n = len(positive)
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    w = np.zeros(n_features)
    bias = float(np.log(prior / (1 - prior)))
    if not n_pos or not n_unl:
        return w, bias
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, rounds + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + bias
        p = sigmoid(z)
        low = np.logaddexp(0, z)  # the loss of calling a row toxic free
        rest = low[~positive].mean() - prior * low[positive].mean()
        g = np.zeros(n)
        if rest >= 0:
            g[positive] = prior * (p[positive] - 1) / n_pos - prior * p[positive] / n_pos
            g[~positive] = p[~positive] / n_unl
        else:
            g[positive] = prior * p[positive] / n_pos
            g[~positive] = -p[~positive] / n_unl
        gw = np.bincount(cols, weights=g[rows], minlength=n_features) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.1 * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.1 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return w, float(bias)


def _sampled(rows: DataFrame, bound: int) -> DataFrame:
    """The rows of the bound least hashes of id and text; all rows where there are no more.

    The choice depends on the rows alone, not on how they are dealt out. Only rows alike in every hashed
    column can exceed the bound.
    """
    draw = F.xxhash64(*rows.columns, F.lit("sample"))
    last = rows.select(draw.alias("draw")).orderBy("draw").limit(bound).agg(F.count("*").alias("n"), F.max("draw").alias("last")).first()
    return rows if last["n"] < bound else rows.filter(draw <= F.lit(last["last"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model to the rows given; leave out held-out rows before the call."""
    spark = docs.sparkSession
    small_batches(spark)
    source = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.join(source.select("doc_id").distinct(), "doc_id", "left_semi")
    n_toxic, n_known = known.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    prior = min(max((n_toxic or 0) / n_known, 0.001), 0.9) if n_known else PRIOR

    # The limits cut rows that are alike, if any, and bound what is broadcast.
    confirmed = _sampled(known.filter("toxic = 1").select("doc_id").distinct(), POSITIVES).limit(POSITIVES)
    positive = source.join(F.broadcast(confirmed), "doc_id").select(F.lit(True).alias("positive"), "text")
    mixture = _sampled(source, UNLABELLED).limit(2 * UNLABELLED).select(F.lit(False).alias("positive"), "text")
    texts = stored(positive.unionByName(mixture), "toxicity-sample")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("positive", pa.bool_()), ("feature", pa.string()), ("n", pa.int64())])
        for batch in batches:
            count: dict[tuple[bool, str], int] = {}
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in features(text):
                    count[mark, x] = count.get((mark, x), 0) + 1
            yield record_batch(schema, positive=[k[0] for k in count], feature=[k[1] for k in count], n=list(count.values()))

    n_pos, n_unl = texts.agg(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).first()
    counts = texts.mapInArrow(listed, "positive boolean, feature string, n bigint").groupBy("feature")
    counts = counts.agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("u"))
    lean = (F.log((F.col("p") + 0.5) / ((n_pos or 0) + 1)) - F.log((F.col("u") + 0.5) / ((n_unl or 0) + 1))) * F.sqrt("p")
    leaning = counts.filter(F.col("p") >= LEAST_ROWS).orderBy(lean.desc(), "feature").limit(LEANING)
    common = counts.orderBy(F.desc("u"), "feature").limit(COMMON)
    chosen = sorted({r["feature"] for r in leaning.select("feature").union(common.select("feature")).collect()})
    number = {x: k for k, x in enumerate(chosen)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("positive", pa.bool_()), ("cols", pa.list_(pa.int32()))])
        for batch in batches:
            known = Known(number)
            cols = [sorted(known(t)) for t in batch.column(1).to_pylist()]
            yield record_batch(schema, positive=batch.column(0), cols=cols)

    sample = texts.mapInArrow(numbered, "positive boolean, cols array<int>").toArrow()
    cols = [np.array(x, np.int64) for x in sample.column("cols").to_pylist()]
    marks = np.array(sample.column("positive").to_pylist(), bool)
    rows = np.repeat(np.arange(len(marks)), [len(x) for x in cols])
    flat = np.concatenate(cols) if cols else np.empty(0, np.int64)
    w, bias = fit_nnpu(rows, flat, marks, len(chosen), prior)
    return Model(chosen, w, bias)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    if kind != "bigint":
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield record_batch(schema, doc_id=batch.column(0), score=[score(t) for t in batch.column(1).to_pylist()])

    return source.mapInArrow(run, f"doc_id {'bigint' if kind == 'bigint' else 'string'}, score double")


def held_out(col: str = "doc_id"):
    return F.coalesce(crc_mod(col, 5) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from rows that aren't held out."""
    model = train(docs.filter(~held_out()), labels.filter(~held_out()))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; every column stays. Rows are scored where they are: no join, no shuffle."""
    model = train(docs.filter(~held_out()), labels.filter(~held_out()))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in parts:
            yield texts.map(lambda t: score(t if isinstance(t, str) else None)).astype(float)
        del score
        release_memory()

    return docs.filter(scored("text") < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
