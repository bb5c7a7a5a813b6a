"""Quality rules over a line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate. What it sees of a line
are shares of symbols, capitals, digits and exclamation marks, its length and ending, whether it repeats an earlier
line and how many of its words stand in repeated windows. Viterbi decoding finds the best sequence of marks of the
whole text, and a document stays if content lines hold at least SHARE of its word characters. Two base rules come
first: too few words, or too many words in windows of WINDOW words that occur again.

The field is trained in numpy by gradient steps on the exact log-likelihood (forward and backward sums in log space)
of silver marks: lines of documents labelled as bad are boilerplate, lines of good ones content unless they repeat
an earlier line. Bounds of the fit: FITTED labelled documents, those of the least hashes of id and text, that have at
most FIT_LINES lines; chains are cut into pieces of CHAIN lines for training only. Every document is judged over its
whole text.

Defined cases: a null or empty text has no words and fails the base rules; lines without words count for no
share; a text is content where both marks are equally good; without any labelled row, or without both kinds,
every line is content; null labels are left out; repeated rows are judged alike; an empty input gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import crc_mod, id_and_text, record_batch, small_batches, stored, table

LEAST_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
SHARE = 0.5
FITTED = 2000
FIT_LINES = 2000
CHAIN = 64
ROUNDS = 120
DECAY = 1e-3
CONTENT, BOILERPLATE = 0, 1

MIX = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_CAPITALS = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_DIGITS = b"0123456789"

#: What a line is seen by: (name, upper bounds of its steps); a value beyond the last bound is a step of its own.
STEPS = [
    ("words", (0, 2, 5, 10, 30)),
    ("symbols a word", (0, 0.1, 0.3)),
    ("exclamations a word", (0, 0.1, 0.3)),
    ("share of capitals", (0.1, 0.5)),
    ("share of digits", (0, 0.2)),
    ("share of repeated words", (0, 0.5)),
    ("repeats a line", (0,)),
    ("ends a sentence", (0,)),
]
AGAIN = 6
_FIRST = np.cumsum([0] + [len(s) + 1 for _, s in STEPS]).tolist()
N_FEATURES = _FIRST[-1]


def repeated_words(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window that occurs twice or more. Windows are named exactly, by doubling."""
    n = len(words)
    out = np.zeros(n, bool)
    if n <= window:
        return out
    # Windows of different hashes differ: mostly that settles it.
    name, size = np.fromiter(map(hash, words), np.int64, n), 1
    while size < window:
        step = min(size, window - size)
        name, size = name[: n - size - step + 1] * MIX + name[step : n - size + 1], size + step
    name.sort()
    if (name[1:] != name[:-1]).all():
        return out
    number: dict[bytes, int] = {}
    base = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    name, size = base, 1
    while size < window:
        step = min(size, window - size)  # overlapping halves where the window is no power of two
        pair = name[: n - size - step + 1] * (int(name.max()) + 1) + name[step : n - size + 1]
        name, size = np.unique(pair, return_inverse=True)[1], size + step
    again = np.bincount(name)[name] > 1
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark[:-1]) > 0


@dataclass
class Lines:
    """A text's counts and its lines that have words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: list[tuple[int, ...]]
    chars: list[int]


def _step(k: int, value: float) -> int:
    for i, bound in enumerate(STEPS[k][1]):
        if value <= bound:
            return _FIRST[k] + i
    return _FIRST[k + 1] - 1


def read_lines(raw: bytes | None) -> Lines:
    raw = raw or b""
    words = raw.split()
    repeated = repeated_words(words)
    before = np.concatenate([[0], np.cumsum(repeated)]).tolist()
    features, chars, seen, at, dup = [], [], set(), 0, 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        size = len(line)
        bare = line.translate(None, _BLANKS)
        again = line in seen
        dup += again
        seen.add(line)
        letters = size - len(line.translate(None, _LETTERS))
        values = (
            n,
            (size - len(line.translate(None, SYMBOLS))) / n,
            line.count(b"!") / n,
            (size - len(line.translate(None, _CAPITALS))) / letters if letters else 0,
            (size - len(line.translate(None, _DIGITS))) / len(bare),
            (before[at + n] - before[at]) / n,
            again,
            bare[-1:] in b".!?:\"'",
        )
        features.append(tuple(_step(k, v) for k, v in enumerate(values)))
        chars.append(len(bare.decode()))
        at += n
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return Lines(len(words), sum(chars), n_symbols, dup, before[-1], features, chars)


@dataclass
class Field:
    """Weights of a linear chain over two marks: emissions (features, 2), transitions (2, 2) and start (2)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def decoder(self):
        """A function from a text's features to its best marks (Viterbi); ties go to content."""
        emit, start = self.emit, self.start.tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        held: dict[tuple[int, ...], tuple[float, float]] = {}

        def decode(features: list[tuple[int, ...]]) -> list[int]:
            back: list[tuple[int, int]] = []
            content = boiler = 0.0
            for k, f in enumerate(features):
                e = held.get(f)
                if e is None:
                    e = held[f] = tuple(emit[list(f)].sum(axis=0).tolist())
                if not k:
                    content, boiler = start[0] + e[0], start[1] + e[1]
                    continue
                to_c, to_b = boiler + bc > content + cc, boiler + bb > content + cb
                back.append((to_c, to_b))
                content, boiler = (boiler + bc if to_c else content + cc) + e[0], (boiler + bb if to_b else content + cb) + e[1]
            if not features:
                return []
            marks = [int(boiler > content)]
            for step in reversed(back):
                marks.append(int(step[marks[-1]]))
            return marks[::-1]

        return decode


def _log_sums(emit: np.ndarray, move: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log-partition (n), marginals (n, length, 2) and expected moves (2, 2) of padded chains of the given sizes."""
    n, length, _ = emit.shape
    fore, back = np.empty_like(emit), np.zeros_like(emit)
    fore[:, 0] = start + emit[:, 0]
    for t in range(1, length):
        fore[:, t] = np.logaddexp(fore[:, t - 1, 0, None] + move[0], fore[:, t - 1, 1, None] + move[1]) + emit[:, t]
    for t in range(length - 2, -1, -1):
        ahead = emit[:, t + 1] + back[:, t + 1]
        made = np.logaddexp(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1])
        back[:, t] = np.where((t + 1 < size)[:, None], made, 0.0)
    last = fore[np.arange(n), size - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    live = (np.arange(length) < size[:, None])[:, :, None]
    marginal = np.where(live, np.exp(np.where(live, fore + back - total[:, None, None], 0)), 0)
    moves = np.zeros((2, 2))
    if length > 1:
        pair = (np.arange(1, length) < size[:, None])[:, :, None, None]
        joint = fore[:, :-1, :, None] + move + (emit + back)[:, 1:, None, :] - total[:, None, None, None]
        moves = np.where(pair, np.exp(np.where(pair, joint, 0)), 0).sum(axis=(0, 1))
    return total, marginal, moves


def fit_field(chains: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = ROUNDS, decay: float = DECAY) -> Field:
    """A field fitted by Adam to chains of (features, marks) of at most CHAIN lines."""
    field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    if len({m for _, marks in chains for m in marks}) < 2:
        return field
    chains = sorted(chains, key=lambda c: len(c[1]))
    width = len(STEPS)
    lines = sum(len(m) for _, m in chains)
    parts = []  # short chains apart from long ones, so that little is padded
    low = 0
    for high in (4, 8, 16, CHAIN):
        own = [c for c in chains if low < len(c[1]) <= high]
        low = high
        if own:
            size = np.array([len(m) for _, m in own])
            which = np.repeat(np.arange(len(own)), size)
            place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            feats = np.array([f for features, _ in own for f in features]).reshape(-1, width)
            marks = np.array([m for _, own_marks in own for m in own_marks])
            parts.append((size, which, place, feats, marks))
    seen_emit, seen_moves, seen_start = np.zeros_like(field.emit), np.zeros((2, 2)), np.zeros(2)
    for _, _, place, feats, marks in parts:
        np.add.at(seen_emit, (feats, marks[:, None]), 1)
        inside = place[1:] > 0
        np.add.at(seen_moves, (marks[:-1][inside], marks[1:][inside]), 1)
        np.add.at(seen_start, marks[place == 0], 1)
    params = [field.emit, field.move, field.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        g_emit, moves, start = -seen_emit, -seen_moves, -seen_start
        for size, which, place, feats, _ in parts:
            emit = np.zeros((len(size), int(size.max()), 2))
            emit[which, place] = field.emit[feats].sum(axis=1)
            _, marginal, own_moves = _log_sums(emit, field.move, field.start, size)
            own = marginal[which, place]
            g_emit = g_emit + np.stack([np.bincount(feats.ravel(), weights=np.repeat(own[:, k], width), minlength=N_FEATURES) for k in (0, 1)], axis=1)
            moves, start = moves + own_moves, start + marginal[:, 0].sum(axis=0)
        grads = [g_emit, moves, start]
        for p, g, mm, vv in zip(params, grads, m, v, strict=True):
            g = g / lines + decay * p
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            p -= 0.1 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fits a field to the labelled rows given; leave out held-out rows before the call."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").distinct()
    source = id_and_text(docs, id_col, text_col).filter(F.size(F.split("text", "\n")) <= FIT_LINES)
    known = known.join(source.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", "quality").limit(FITTED)
    picked = source.join(F.broadcast(chosen), "doc_id").select("quality", F.encode("text", "UTF-8").alias("raw"))
    schema = pa.schema([("marks", pa.list_(pa.int8())), ("features", pa.list_(pa.int16()))])

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = _FIRST[AGAIN + 1] - 1
        for batch in batches:
            marks, features = [], []
            for quality, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = read_lines(raw).features
                for k in range(0, len(own), CHAIN):
                    cut = own[k : k + CHAIN]
                    marks.append([BOILERPLATE if quality == 0 or f[AGAIN] == again else CONTENT for f in cut])
                    features.append([x for f in cut for x in f])
            yield record_batch(schema, marks=marks, features=features)

    # Copies of a labelled row count once each; the limit binds where ids repeat.
    found = stored(picked.mapInArrow(chains, "marks array<tinyint>, features array<smallint>"), "line-chains")
    rows = found.orderBy("features", "marks").limit(FITTED * (FIT_LINES // CHAIN + 1)).toArrow()
    width = len(STEPS)
    fitted = []
    for marks, flat in zip(rows.column("marks").to_pylist(), rows.column("features").to_pylist(), strict=True):
        fitted.append(([tuple(flat[i : i + width]) for i in range(0, len(flat), width)], marks))
    return fit_field(fitted)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, content_share, kept) for every row."""
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    number = source.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    kind, arrow = ("bigint", pa.int64()) if number else ("string", pa.string())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", arrow), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("n_lines", pa.int64()), ("content_share", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = field.decoder()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = read_lines(raw)
                failed = own.n_words < LEAST_WORDS or 100 * own.n_repeat_words > REPEATED_PERCENT * own.n_words
                content = sum(c for c, m in zip(own.chars, decode(own.features), strict=True) if m == CONTENT)
                part = content / own.word_chars if own.word_chars else 0.0
                values = (doc_id, *(getattr(own, c) for c in counts), failed, len(own.features), part, not failed and part >= share)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            yield record_batch(schema, **out)

    texts = source.select(F.col("doc_id").cast(kind).alias("doc_id"), F.encode("text", "UTF-8").alias("raw"))
    return texts.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", base_failed boolean, n_lines bigint, content_share double, kept boolean")


def held_out(col: str = "doc_id"):
    return F.coalesce(crc_mod(col, 5) == 0, F.lit(False))


def line_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row judged by a field that learns from labelled rows whose id isn't held out."""
    field = train(docs.filter(~held_out()), labels.filter(~held_out()))
    return judge(docs, field)


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
