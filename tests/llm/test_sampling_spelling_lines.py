"""Resampling, spelling variants and line quality against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import line_quality, resampling, spelling
from tests.compare import connect, rows

SF = "/root/testdata/sf0.001"
TEXTS = [
    (1, "Alpha beta gamma, delta; alpha beta! " * 9),
    (2, None),
    (3, ""),
    (4, " \n\t , ;"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3),
    (6, "ÀÉ9 Één ünïcode tëxt 日本語 🙂 word " * 8),
    (7, "x" * 3000 + " one two three " * 12),
    (None, "row without an id has enough words to be drawn " * 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that the operators use themselves."""
    made = [(i, t, 1, 2, "c", 3) for i, t in TEXTS]
    return spark.createDataFrame(made, "doc_id long, text string, row int, rank int, word string, n int")


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(source, target):
    s, t = Counter(), Counter()
    for _, text in source:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    for place, (i, text) in enumerate(source):
        found = buckets_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)), place])
    enough = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    rank = {id(r): k + 1 for k, r in enumerate(enough)}
    return [(*r[:4], rank.get(id(r))) for r in out], len(enough)


def listed(df, *cols):
    return sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))


def test_oracles(spark):
    con = connect(SF)
    for name, query, sql in (("op11", resampling.op11_resampling, resampling.ORACLE), ("op12", spelling.op12_spelling, spelling.ORACLE)):
        got, want = query(spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want), name


def test_resampling_cases(spark, docs):
    target = ["alpha beta gamma delta", None, "één ünïcode"]
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=100)
    want, n = resampled(TEXTS, target)
    assert n == 6
    assert listed(found, "doc_id", "n_features", "weight", "score", "rank") == sorted(map(str, want))
    half = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=50)
    assert sorted(r["rank"] for r in half.collect() if r["rank"]) == [1, 2, 3]
    assert resampling.resample(docs.limit(0), docs.select("text")).count() == 0
    nothing = resampling.resample(docs, docs.select("text").limit(0), percent=100)
    assert listed(nothing, "doc_id", "n_features", "weight", "score", "rank") == sorted(map(str, resampled(TEXTS, [])[0]))
    text_ids = resampling.resample(docs.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), docs.select("text"))
    assert text_ids.count() == len(TEXTS)


def test_resampling_pieces(monkeypatch):
    text = ("The quick-brown fox, étude 42 " * 50 + "w" * 300 + " end").encode()
    whole = Counter(np.concatenate([f for _, _, f in resampling.Hasher()([text])]).tolist())
    assert whole == Counter(buckets_of(text.decode()))
    monkeypatch.setattr(resampling, "PIECE", 37)
    monkeypatch.setattr(resampling, "GROUP_WORDS", 5)
    found = list(resampling.Hasher()([None, text, b"", text]))
    for k in (1, 3):
        assert Counter(b for _, of, f in found for x, b in zip(of.tolist(), f.tolist(), strict=True) if x == k) == whole
    assert sum(int((w == 1).sum()) for w, _, _ in found) == len(words_of(text.decode()))


def test_ranks_by_regular_sampling(spark, monkeypatch):
    """Few distinct scores and repeated ids, many runs and segments: every row has its own exact rank and segments are even."""
    rng = random.Random(1)
    made = [(rng.choice([1, 2, 2, 2, 2, 3, 9]), rng.choice([None, 5, 5, 5, *range(40)]), k) for k in range(6000)]
    monkeypatch.setattr(resampling, "RUN_ROWS", 500)
    df = spark.createDataFrame(made, "score long, doc_id long, row long").repartition(7)
    found = {r["row"]: r["rank"] for r in resampling.ranked(df).collect()}
    order = sorted(made, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert found == {r[2]: k + 1 for k, r in enumerate(order)}


def test_ranks_are_dealt_evenly(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(7).cast("long").alias("score"), F.col("id").alias("doc_id"), F.col("id").alias("row")).repartition(5)
    found = resampling.ranked(df).withColumn("part", F.spark_partition_id())
    assert found.filter("rank <> doc_id + 1").count() == 0


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(counts):
    out = {}
    for w, n in counts.items():
        near = sorted(((-m, v) for v, m in counts.items() if one_edit(w, v)))
        good = near and -near[0][0] >= 2 * n
        out[w] = (n, len(near), near[0][1] if good else None, -near[0][0] if good else None)
    full = {}
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        full[w] = (w, n, k, form, form_n, root)
    return full


@pytest.mark.parametrize("group", [1, 4, 2048])
def test_neighbours_of_close_words(spark, group):
    """Words of two letters, whose groups are crowded, dealt out anew to the last place."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(500)} | {"a" * k for k in range(1, 12)}
    words |= {"long" * 300, "long" * 300 + "x", "lung" + "long" * 299}
    counts = {w: rng.choice([3, 3, 6, 12, 24, 50]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.neighbours(df, group).collect()}
    want = {}
    for w in counts:
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        if near:
            want[w] = (len(near), -near[0][0], near[0][1])
    assert got == want


def test_spelling_cases(spark, docs):
    text = "colour colour colour colour colour colour COLOUR color Color COLOR colours colours colours colouré colouré colouré ÀÉÉÈ× ÀÉÉÈ× ÀÉÉÈ×"
    made = [(i, t, 1) for i, t in [*TEXTS, (50, text), (50, text), (51, "colored " * 3)]]
    df = spark.createDataFrame(made, "doc_id long, text string, n int")
    for corrupt in (0, 3):
        counts = Counter()
        for i, t, _ in made:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if corrupt and h % corrupt == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
        counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
        found = spelling.variants(df, corrupt=corrupt)
        assert listed(found, "word", "n", "n_near", "form", "form_n", "root") == sorted(map(str, variants_of(counts).values()))
    assert spelling.variants(docs.limit(0)).count() == 0


def test_roots_of_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [(f"v{k}", "w30") for k in range(200)]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert set(got.values()) == {"w37"} and len(got) == len(chain)


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(words) < 20 or 100 * len(again) > 30 * len(words)


def test_line_counts(spark, table, docs):
    rng = random.Random(3)
    made = [t for _, t in table] + [t for _, t in TEXTS]
    made += ["\n".join(rng.choice(["a b c", "d e", "", "  ", "a b c\r", "x # $ y\xa0z|"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    made += ["a b " * 30, "a " * 8, "a " * 9, "one two three four five six seven eight " * 2]
    for text in made:
        own = line_quality.read_lines(None if text is None else text.encode())
        failed = own.n_words < 20 or 100 * own.n_repeat_words > 30 * own.n_words
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words, failed) == base_counts(text)
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = line_quality.line_quality(docs, labels)
    want = sorted(str((i, *base_counts(t))) for i, t in TEXTS)
    assert listed(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("base_failed AND kept").count() == 0
    assert line_quality.line_quality(docs.limit(0), labels).count() == 0
    bare = line_quality.line_quality(docs, labels.limit(0))
    assert bare.filter("NOT base_failed AND NOT kept").count() == 0


def test_viterbi_and_sums_against_all_sequences():
    """The best sequence, the partition and the marginals of short chains, by listing all of them."""
    rng = np.random.default_rng(4)
    field = line_quality.Field(rng.normal(size=(line_quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    width = len(line_quality.STEPS)
    for length in (1, 2, 5):
        features = [tuple(int(line_quality._FIRST[k] + rng.integers(len(line_quality.STEPS[k][1]) + 1)) for k in range(width)) for _ in range(length)]
        emit = np.array([field.emit[list(f)].sum(axis=0) for f in features])
        score = {}
        for code in range(2**length):
            marks = [code >> t & 1 for t in range(length)]
            score[tuple(marks)] = field.start[marks[0]] + sum(emit[t, m] for t, m in enumerate(marks)) + sum(field.move[a, b] for a, b in zip(marks, marks[1:], strict=False))
        assert tuple(field.decoder()(features)) == max(score, key=score.get)
        padded = np.concatenate([emit, np.zeros((7 - length, 2))])[None]
        total, marginal, moves = line_quality._log_sums(padded, field.move, field.start, np.array([length]))
        assert total[0] == pytest.approx(np.logaddexp.reduce(list(score.values())))
        want = sum(math.exp(s - total[0]) for m, s in score.items() if m[-1] == 1)
        assert marginal[0, length - 1, 1] == pytest.approx(want)
        assert marginal[0, length:].sum() == 0 and moves.sum() == pytest.approx(length - 1)


def test_line_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    found = line_quality.line_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter(line_quality.held_out())
    good = found.filter("quality = 1 AND n_words >= 20").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = found.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95 and bad < 0.25
