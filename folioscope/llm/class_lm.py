"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions.

    P(w | h) = P(class(w) | class(h)) * P(w | class(w))

All words of all training texts are counted by Spark. The DICTIONARY most frequent words, and the end of a
text, are units of their own; any rarer word belongs to one of SHAPES units by its length and ending. Texts
are written once as unit numbers, from which all further counts and the scores are made.

Classes come from exchange clustering in two steps. Among the LEXICON most frequent words and the shapes of
all others, units move one by one between CLASSES classes as long as the likelihood of the class bigrams
rises. Then, SWEEPS_ALL times, every unit's neighbours are counted by class over the whole corpus, and every
unit of LEAST_PLACED tokens at once goes to the class under which its neighbours are likeliest.

A class emits a known word by its share of the class's tokens. As many tokens as the class has words seen
once (half a token at least) are set aside for one unknown word. Transitions are smoothed with the
classes' own shares. Both sum to one.

Counts of all words don't fit a broadcast as the corpus grows. The most frequent words, DICTIONARY at
most, are sent to the tasks; the rarer words of each text are joined with the counts by a shuffle. Either
way the counts are exact.

Defined cases: a null text is empty and has the end as its only token; with no training rows nothing is
known, N and V are 0 and the model gives every token the same odds as one unknown word; repeated rows are
scored alike; words of equal counts are ranked by their bytes, and all words of the least count that doesn't fit
the dictionary are left to the shapes; long texts are scored whole; an empty input gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import crc_mod, id_and_text, record_batch, small_batches, stored, table

LEXICON = 1000
SHAPES = 256
CLASSES = 48
SWEEPS = 8
#: Rounds in which every unit is placed by the classes of all its neighbours.
SWEEPS_ALL = 2
#: Tokens from which a unit is placed by its own neighbours: a word seen once keeps the class of its shape.
LEAST_PLACED = 2
#: Words that are sent to the tasks, with their counts, and are units of their own.
DICTIONARY = 150_000
#: Tokens of prior weight that smooth the transitions out of a class.
TRANSITION_PRIOR = 20.0
#: Distinct words or pairs that a task holds before it passes them on.
HELD = 400_000
#: Cells of neighbour counts that a task gathers before it sums them up and, if over half of them are left, passes
#: them on; tokens for each block of units.
HELD_CELLS = 2_000_000
BLOCK_TOKENS = 2_000_000
#: Tasks whose counts are summed up together first.
TASKS = 64

#: The end of a text, which no word equals.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and then the end."""
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) > HELD:
                yield record_batch(schema, word=list(held), c=list(held.values()))
                held = Counter()
        yield record_batch(schema, word=list(held), c=list(held.values()))

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Units:
    """Numbers of units: the end, the dictionary's words from the most frequent on, then shapes."""

    lexicon: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.lexicon) + SHAPES

    @staticmethod
    def shape(word: bytes) -> int:
        return zlib.crc32(word[-2:] + bytes([min(len(word), 9)])) % SHAPES

    def of(self, word: bytes) -> int:
        found = self.lexicon.get(word)
        return len(self.lexicon) + self.shape(word) if found is None else found

    def core(self) -> np.ndarray:
        """Of each unit the number among the end, the LEXICON first words and the shapes, which stand for all others."""
        out = np.concatenate([np.arange(len(self.lexicon)), 1 + LEXICON + np.arange(SHAPES)])
        for word, k in self.lexicon.items():
            if k > LEXICON:
                out[k] = 1 + LEXICON + self.shape(word)
        return out


class Remembered(dict):
    """word -> unit, remembered for a bounded number of words."""

    def __init__(self, units: Units):
        super().__init__()
        self.units = units

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        found = self[word] = self.units.of(word)
        return found


RARE = pa.struct([("word", pa.binary()), ("n", pa.int64()), ("shape", pa.int32())])


def coded(docs: DataFrame, units: Units) -> DataFrame:
    """(row, doc_id, ids, rare): each text's units as 32-bit numbers, and its words outside the dictionary; stored."""
    number = docs.schema["doc_id"].dataType.simpleString() == "bigint"
    if not number:
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(units)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64() if number else pa.string()), ("ids", pa.binary()), ("rare", pa.list_(RARE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = shared.value
        unit, known = Remembered(u), len(u.lexicon)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, rare = [], []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                x = np.fromiter(map(unit.__getitem__, words), np.int32, len(words))
                ids.append(x.tobytes())
                left = Counter(words[i] for i in np.flatnonzero(x >= known).tolist())
                rare.append([{"word": w, "n": n, "shape": unit[w] - known} for w, n in left.items()])
            yield record_batch(schema, row=np.arange(row, row + len(ids)), doc_id=batch.column(0), ids=ids, rare=rare)
            row += len(ids)

    kind = "bigint" if number else "string"
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, ids binary, rare array<struct<word:binary,n:bigint,shape:int>>"), "lm-coded")


def _units_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.int32).astype(np.int64)


def pair_counts(texts: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """How often units of one group follow those of another, in coded texts; a text begins after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        count = np.zeros(size * size, np.int64)
        for batch in batches:
            x = group[np.concatenate([[0], _units_of(batch, 0)])]
            count += np.bincount(x[:-1] * size + x[1:], minlength=size * size)
        at = np.flatnonzero(count)
        for k in range(0, len(at), HELD):
            yield record_batch(schema, pair=at[k : k + HELD], n=count[at[k : k + HELD]])

    found = texts.select("ids").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(size * size)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return pairs.reshape(size, size)


CELLS = pa.schema([("block", pa.int32()), ("part", pa.int64()), ("cell", pa.binary()), ("n", pa.binary())])
CELLS_DDL = "block int, part bigint, cell binary, n binary"


def _summed(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and the sums of their counts."""
    by = np.argsort(cell, kind="stable")
    cell, n = cell[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    return cell[first], np.add.reduceat(n, first) if len(first) else n


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    cell, n = (np.frombuffer(b"".join(group.column(x).to_pylist()), np.int64) for x in ("cell", "n"))
    return _summed(cell, n)


def _sum_cells(group: pa.Table) -> pa.Table:
    cell, n = _gathered(group)
    return pa.table({"block": group.column("block")[:1], "part": group.column("part")[:1], "cell": [cell.tobytes()], "n": [n.tobytes()]}, schema=CELLS)


def place_all(texts: DataFrame, cls: np.ndarray, joint: np.ndarray, tokens_: int) -> np.ndarray:
    """New classes: each unit goes where its neighbours are likeliest, given the class bigrams (joint) so far.

    A cell is a unit, a side and a class: how often a neighbour of that class stands on that side. Tasks sum up
    their cells, then groups of TASKS tasks do, then each block of units has its sums.
    """
    size, classes = len(cls), len(joint)
    blocks = min(size, tokens_ // BLOCK_TOKENS + 8)
    after = np.log(joint + 0.1) - np.log(joint.sum(axis=1, keepdims=True) + 1)  # of a class: the class that follows
    before = np.log(joint + 0.1) - np.log(joint.sum(axis=0, keepdims=True) + 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() // TASKS

        def packed(cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            block = cell // (2 * classes) % blocks
            by = np.argsort(block, kind="stable")
            edge = np.searchsorted(block[by], np.arange(blocks + 1))
            some = np.flatnonzero(np.diff(edge)).tolist()
            pick = [by[edge[b] : edge[b + 1]] for b in some]
            return record_batch(CELLS, block=some, part=[part] * len(some), cell=[cell[i].tobytes() for i in pick], n=[n[i].tobytes() for i in pick])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        gathered = 0
        for batch in batches:
            x = np.concatenate([[0], _units_of(batch, 0)])
            c = cls[x]
            cell = np.concatenate([x[:-1] * (2 * classes) + c[1:], x[1:] * (2 * classes) + classes + c[:-1]])
            held.append(_summed(cell, np.ones(len(cell), np.int64)))
            gathered += len(held[-1][0])
            if gathered > HELD_CELLS:
                held = [_summed(*(np.concatenate(v) for v in zip(*held, strict=True)))]
                gathered = len(held[0][0])
                if gathered > HELD_CELLS // 2:
                    yield packed(*held[0])
                    held, gathered = [], 0
        if not held:
            return
        yield packed(*_summed(*(np.concatenate(v) for v in zip(*held, strict=True))))

    def choose(group: pa.Table) -> pa.Table:
        cell, n = _gathered(group)
        units, at = np.unique(cell // (2 * classes), return_inverse=True)
        counts = np.zeros((len(units), 2 * classes))
        counts[at, cell % (2 * classes)] = n
        enough = counts[:, classes:].sum(axis=1) >= LEAST_PLACED  # each token has one neighbour before it
        units, counts = units[enough], counts[enough]
        gain = counts[:, :classes] @ after.T + counts[:, classes:] @ before
        gain[:, 0] = -np.inf  # the end is alone in its class
        return pa.table({"unit": units, "cls": gain.argmax(axis=1)}, schema=pa.schema([("unit", pa.int64()), ("cls", pa.int64())]))

    found = texts.select("ids").mapInArrow(cells, CELLS_DDL).groupBy("block", "part").applyInArrow(_sum_cells, CELLS_DDL)
    chosen = found.groupBy("block").applyInArrow(choose, "unit bigint, cls bigint").toArrow()
    new = cls.copy()
    new[chosen.column("unit").to_numpy()] = chosen.column("cls").to_numpy()
    new[0] = 0
    return new


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. pairs: counts of neighbouring units; unit 0, the end, keeps class 0 alone.

    Units begin spread over the classes by frequency. In a sweep each unit in turn goes to the class
    that raises sum n(c, d) log n(c, d) - sum n(c, .) log n(c, .) - sum n(., d) log n(., d) most.
    """
    n = len(pairs)
    order = np.argsort(-(pairs.sum(axis=1) + pairs.sum(axis=0)), kind="stable")
    order = order[order != 0]
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1.0
    joint = member.T @ pairs @ member
    right, left = pairs @ member, (member.T @ pairs).T  # of each unit: counts with following and preceding classes

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    active = [w for w in order.tolist() if pairs[w].any() or pairs[:, w].any()]
    for _ in range(sweeps):
        moved = 0
        for w in active:
            a = cls[w]
            own = pairs[w, w]
            r, p = right[w].copy(), left[w].copy()
            r[a] -= own
            p[a] -= own
            joint[a] -= r
            joint[:, a] -= p
            joint[a, a] -= own
            rows, cols = joint.sum(axis=1), joint.sum(axis=0)
            gain = (f(joint + r) - f(joint)).sum(axis=1) + (f(joint + p[:, None]) - f(joint)).sum(axis=0)
            own_cell = joint.diagonal()
            gain += f(own_cell + r + p + own) - f(own_cell) - (f(own_cell + r) - f(own_cell)) - (f(own_cell + p) - f(own_cell))
            gain -= f(rows + r.sum() + own) - f(rows) + f(cols + p.sum() + own) - f(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += r
            joint[:, b] += p
            joint[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return cls


@dataclass
class Model:
    units: Units
    cls: np.ndarray  # class of each unit
    transition: np.ndarray  # log10 P(next class | class)
    log_size: np.ndarray  # log10 of a class's tokens and what is set aside
    log_unknown: np.ndarray  # log10 of what is set aside
    count: np.ndarray  # tokens of each word of the dictionary; 0 for shapes
    n: int
    v: int


def dictionary(docs: DataFrame) -> tuple[DataFrame, Units, np.ndarray]:
    """The table of all word counts, the units, and the counts of those that are words."""
    counts = stored(word_counts(docs), "lm-counts")
    # The least count at which no more than DICTIONARY words are left, from the number of words of each count.
    least, room = 1 << 62, DICTIONARY
    for row in counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(DICTIONARY).toLocalIterator():
        room -= row["words"]
        if room < 0:
            break
        least = row["c"]
    # The end is a unit even if no word fits.
    top = counts.filter((F.col("c") >= least) | (F.octet_length("word") == 0)).toArrow()
    count = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    ranked = [END, *sorted((w for w in count if w != END), key=lambda w: (-count[w], w))]
    units = Units({w: k for k, w in enumerate(ranked)})
    return counts, units, np.array([count.get(w, 0) for w in ranked] + [0] * SHAPES, np.float64)


def learn(texts: DataFrame, counts: DataFrame, units: Units, count: np.ndarray) -> Model:
    """The model of coded texts."""
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    core = units.core()
    pairs = pair_counts(texts, core, 1 + LEXICON + SHAPES)
    placed = exchange(pairs, CLASSES)
    member = np.zeros((len(pairs), CLASSES))
    member[np.arange(len(pairs)), placed] = 1.0
    cls, joint = placed[core], member.T @ pairs @ member
    for _ in range(SWEEPS_ALL):
        cls = place_all(texts, cls, joint, n)
        joint = pair_counts(texts, cls, CLASSES)

    shared = texts.sparkSession.sparkContext.broadcast(units)

    def of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("once", pa.int64())])
        total, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            k = cls[np.fromiter(map(shared.value.of, batch.column(0).to_pylist()), np.int64, batch.num_rows)]
            c = batch.column(1).to_numpy()
            np.add.at(total, k, c)
            np.add.at(once, k, c == 1)
        yield record_batch(schema, cls=np.arange(CLASSES), n=total, once=once)

    per = counts.mapInArrow(of_units, "cls bigint, n bigint, once bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("once").alias("once"))
    total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in per.collect():
        total[row["cls"]], once[row["cls"]] = row["n"], row["once"]
    aside = np.maximum(once, 0.5)
    share = (total + 1.0) / (total + 1.0).sum()
    transition = (joint + TRANSITION_PRIOR * share) / (joint.sum(axis=1, keepdims=True) + TRANSITION_PRIOR)
    return Model(units, cls, np.log10(transition), np.log10(total + aside), np.log10(aside), count, n, v)


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts (doc_id, text), and the table of all word counts."""
    counts, units, count = dictionary(docs)
    return learn(coded(docs, units), counts, units, count), counts


def score_coded(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of coded texts."""
    number = texts.schema["doc_id"].dataType.simpleString() == "bigint"
    whole = math.log10(model.n + model.v + 1)
    cls, transition = model.cls, model.transition
    known = model.count > 0
    count = np.where(known, model.count, 1.0)
    # Rare words count as unknown here; what their counts change is added after the join.
    base_of = np.where(known, np.log10(count + 1), 0.0) - whole
    emitted = np.where(known, np.log10(count), model.log_unknown[cls]) - model.log_size[cls]
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64() if number else pa.string()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _units_of(batch, 2)
            # Every text ends with an end and begins after one.
            size = np.array([len(i) // 4 for i in batch.column(2).to_pylist()])
            first = np.cumsum(size) - size
            c = cls[x]
            step = transition[np.concatenate([[0], c[:-1]]), c] + emitted[x]
            sums = {k: np.add.reduceat(v, first) for k, v in (("n_known", known[x].astype(np.int64)), ("base", base_of[x]), ("score", step))}
            yield record_batch(schema, row=batch.column(0), doc_id=batch.column(1), n_tokens=size, **sums)

    kind = "bigint" if number else "string"
    made = texts.select("row", "doc_id", "ids").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double")
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n", "r.shape")
    unknown = F.element_at(F.array(*[F.lit(float(x)) for x in model.log_unknown[cls[len(model.units.lexicon) :]]]), F.col("shape") + 1)
    more = (
        rare.join(counts, "word")
        .groupBy("row")
        .agg(
            F.sum("n").alias("more_known"),
            F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"),
            F.sum(F.col("n") * (F.log10(F.col("c").cast("double")) - unknown)).alias("more_score"),
        )
    )
    zero = F.lit(0.0)
    return made.join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of doc_id, text."""
    return score_coded(coded(docs, model.units), model, counts)


def held_out(col: str = "doc_id"):
    return F.coalesce(crc_mod(col, 7) == 2, F.lit(False))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = id_and_text(table(spark, sf_dir, "documents"))
    counts, units, count = dictionary(docs.filter(~held_out()))
    texts = coded(docs, units)
    found = score_coded(texts, learn(texts.filter(~held_out()), counts, units, count), counts)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
