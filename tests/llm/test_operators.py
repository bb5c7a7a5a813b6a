"""The training-data operators against brute force, on small tables with nulls, ties, copies and long texts."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import archives, bpe, class_lm, decontaminate, exact_dedup, language, simhash, suffix_dedup, token_counts, toxicity
from tests.compare import connect, rows

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog and then some more words come " * 400
COPY = "Shared passage of words that stands in many documents, long enough to count as a repeat of one hundred bytes and more. "
TEXTS = [
    (1, "Alpha beta gamma delta. " + COPY),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, COPY + "tail"),
    (6, COPY + "tail"),
    (7, LONG),
    (8, LONG + "end"),
    (9, "Één ünïcode tëxt 日本語 🙂 <|endoftext|> x"),
    (10, "x" * 3000),
    (11, "a"),
    (12, ""),
    (None, "row without an id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that the operators use themselves."""
    made = [(i, t, "en", "s", 0, "clash", 1) for i, t in TEXTS]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, digest string, key int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_oracles(spark):
    from folioscope.llm.queries import oracle_sql, queries

    con = connect(SF)
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        assert rows(got[want.columns]) == rows(want), name


def test_exact_groups(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(got) == len(TEXTS) and exact_dedup.exact_groups(empty).count() == 0
    for i, t in TEXTS:
        same = [j for j, u in TEXTS if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        assert got[i].keep_id == (max(ids) if ids else None) and got[i].group_size == len(same)
        assert got[i].kept == (i is not None and i == got[i].keep_id)
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "9", "10", "11", "12", "None"])


def test_stages_remove_rows_and_not_ids(spark):
    """Two texts of one id are two rows; equal rows of the winner's id leave one."""
    far = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(1, COPY), (2, COPY), (1, far), (2, COPY), (None, COPY), (None, "only here"), (None, "only here"), (3, "quite another text of some words")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, place int")
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("2", COPY), ("1", far), ("None", "only here"), ("None", "only here"), ("3", texts[7][1])])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    want = [("1", COPY), ("1", far), ("None", COPY), ("None", "only here"), ("None", "only here"), ("3", texts[7][1])]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(want)


def test_exact_hot_group_and_index(spark):
    many = spark.createDataFrame([(i, "copy" if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string")
    got = exact_dedup.exact_groups(many).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 1001, False: 1999}
    from folioscope.llm.common import work_dir

    index = exact_dedup.DigestIndex(spark, work_dir(spark, "index"))
    first = exact_dedup.digests(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    index.append(first)
    again = exact_dedup.digests(spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id long, text string"))
    assert [r.keep_id for r in index.fresh(again).collect()] == [11]
    index.append(again)
    opened = exact_dedup.DigestIndex(spark, index.path)
    assert sorted(r.keep_id for r in opened.rows().collect()) == [2, 3, 11]
    assert "SortMergeJoin" in index.fresh(again)._jdf.queryExecution().toString()


def test_exact_index_keeps_its_layout(spark):
    """Reopened under another number of shuffle partitions it knows all digests; a repeated batch adds nothing."""
    from folioscope.llm.common import work_dir

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    batch = exact_dedup.digests(spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")))
    path = work_dir(spark, "index")
    try:
        spark.conf.set(key, "4")
        exact_dedup.DigestIndex(spark, path).append(batch)
        spark.conf.set(key, "7")
        opened = exact_dedup.DigestIndex(spark, path)
        assert opened.buckets == 4 and opened.id_type == "bigint"
        assert opened.fresh(batch).count() == 0
        opened.append(batch)
        spark.conf.set(key, "3")
        again = exact_dedup.DigestIndex(spark, path)
        again.append(batch)
        assert again.rows().count() == 100 and again.rows().select("digest").distinct().count() == 100
    finally:
        spark.conf.set(key, before)
    for wrong in ({"buckets": 7}, {"id_type": "string"}):
        with pytest.raises(ValueError, match="4 buckets"):
            exact_dedup.DigestIndex(spark, path, **wrong)


def test_exact_groups_of_text_ids(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("10", "x"), (None, "y"), ("c", None), ("d", "")], "doc_id string, text string")
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in exact_dedup.exact_groups(df).collect())
    want = [("a", "b", 3, False), ("b", "b", 3, True), ("10", "b", 3, False), (None, None, 1, False), ("c", "d", 2, False), ("d", "d", 2, True)]
    assert got == sorted(map(str, want))
    assert sorted(str(r.doc_id) for r in exact_dedup.keep_one(df).collect()) == ["None", "b", "d"]


def test_bpe_equals_the_library(docs, empty, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["\r\n\r\n x \t\t y \x0b z\x00 " * 99, ("ab c" * 400 + "<|endoftext|> q ") * 3, "it's  we'll   don't '" * 200, "　  a  b " * 300, "１２３ ４５ é́ " * 200]
    encoder = bpe.ChunkEncoder(bpe.default_vocabulary(), bpe.default_pattern())
    for t in [*(t or "" for _, t in table), *odd, LONG, LONG]:
        want = ref.encode(t, add_special_tokens=False).ids
        ids = encoder.encode(t)
        assert ids.tolist() == want and encoder.decode(ids) == ref.decode(want, skip_special_tokens=False)
    assert encoder.made < encoder.asked
    got = {r.doc_id: r for r in bpe.token_digests(bpe.encode_documents(docs)).collect()}
    for i, t in TEXTS:
        want = ref.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0


def test_bpe_borders_fit_any_text():
    random.seed(2)
    encoder = bpe.ChunkEncoder(bpe.default_vocabulary(), bpe.default_pattern())
    for _ in range(150):
        t = "".join(random.choice(["a", " ", "  ", "\n", "é", "1", "'s", ".", "日", "<|endoftext|>", "word"]) for _ in range(random.randint(1, 3000)))
        assert encoder.encode(t).tolist() == encoder.bpe.encode(t, allowed_special="all")


def test_bpe_joins_agree_on_long_runs_and_any_script():
    """Runs of one kind over many chunks, texts without a blank, cut contractions and late scripts equal the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = bpe.ChunkEncoder(bpe.default_vocabulary(), bpe.default_pattern())
    for t in (" " * 5_000_000, "\n" * 2_000_000, "x" + " \t" * 400_000 + "y", "日本語" * 90_000, "ab" * 200_000, "'" * 90_000 + "'re" * 50_000):
        before = encoder.widened
        assert encoder.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids
        assert encoder.widened > before
    random.seed(3)
    for kind in (["'", "r", "e", " ", "v", "l", "\u2019"], ["\u0558", "\u08bf", "a", " ", "\ua7ce", "1", "\u3000"], ["a", " ", "\n", "'s", "é", "日", "<|endoftext|>"]):
        for _ in range(60):
            t = "".join(random.choices(kind, k=random.randint(1, 4000)))
            assert encoder.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids
    assert encoder.joins > 100


def brute_hits(text, items):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for item, t in items:
        x = decontaminate.words(t)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [16_000_000, 60])
def test_decontamination(spark, docs, empty, block_bytes):
    items = [("b1", "Lazy dog and THEN some more words come the quick brown fox!"), ("b2", "gamma delta"), ("b3", None), ("b4", "!!"), ("b10", "lazy dog"), ("b10", "lazy dog")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.find_benchmark(docs, bench, block_bytes=block_bytes).collect()}
    for i, t in TEXTS:
        n, hit, found = brute_hits(t, items)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, hit, found), i
    assert decontaminate.find_benchmark(empty, bench).count() == 0
    assert decontaminate.find_benchmark(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, bench, block_bytes=block_bytes).collect()}
    assert cut[1] == "Alpha beta . " + COPY and cut[2] is None and cut[9] == dict(TEXTS)[9] and "lazy dog" not in cut[7] and len(cut) == len(TEXTS)


def test_decontamination_blocks_keep_rows_apart(spark):
    """Rows of one id, or of none, get the same with many blocks as with one."""
    texts = [(1, "gamma delta stays here"), (1, "déjà vu gamma delta"), (1, "clean text, nothing in it"), (None, "lazy dog öh"), (None, "ö ö ö clean"), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(f"b{k}", t) for k, t in enumerate(["gamma delta", "lazy dog", "delta stays", "x y z " * 20])], "item_id string, text string")
    assert decontaminate._blocks(bench, "item_id", "text", 20)[0] > 1
    for make in (decontaminate.find_benchmark, decontaminate.cut_spans):
        one, many = (sorted(map(str, make(docs, bench, block_bytes=n).collect())) for n in (16_000_000, 20))
        assert len(one) == len(texts) and one == many
    assert {r.text for r in decontaminate.cut_spans(docs, bench, block_bytes=20).collect()} == {" here", "déjà vu ", "clean text, nothing in it", " öh", "ö ö ö clean", None}


def test_fm_index():
    rng = np.random.default_rng(4)
    for _ in range(60):
        runs = [rng.integers(1, 5, rng.integers(1, 60)) for _ in range(rng.integers(1, 6))]
        seq = np.concatenate([[0], *(np.concatenate([r, [0]]) for r in runs)])
        index = decontaminate.FMIndex(seq, 5)
        for n in (1, 2, 4):
            p = rng.integers(1, 5, n)
            low, high = index.search(p[None], np.array([n]))
            at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert at == [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]


def test_cut_spans_with_clashing_columns(spark):
    """Columns named like the block path's own stay as they are."""
    from folioscope.llm.decontaminate import cut_spans

    phrase = " ".join(f"w{k}" for k in range(10))
    rows = [(1, f"before {phrase} after", "x", 5), (2, "clean", None, None), (3, None, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut_spans string, _cut_row long")
    items = spark.createDataFrame([(k, phrase if k == 3 else f"other {k}") for k in range(8)], "item_id long, text string")
    want = [(1, "before  after", "x", 5), (2, "clean", None, None), (3, None, "z", 7)]
    for size in (40, 1 << 24):
        assert sorted(tuple(r) for r in cut_spans(docs, items, block_bytes=size).collect()) == want


def test_packed_runs_find_their_buckets(spark):
    """A bucket's row holds its runs and no others, whether most buckets are empty or none."""
    import pyarrow as pa

    from folioscope.llm import suffix_dedup as S

    class Shared:
        value = np.empty(0, np.uint64)

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh "), 3000)) for _ in range(4)] + ["same " * 100, "same " * 100]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    wanted = None
    for buckets in (1, 40, 4_000_000):
        rows = [r for out in S._deal_runs(buckets, 100, 24, Shared)(iter([batch])) for r in out.to_pylist()]
        assert len({r["bucket"] for r in rows}) == len(rows)
        runs = []
        for r in rows:
            grams = np.frombuffer(r["gram"], np.uint64)
            assert r["bucket"] < 0 or set((grams % np.uint64(buckets)).tolist()) == {r["bucket"]}
            runs += zip(np.frombuffer(r["key"], np.int64).tolist(), np.frombuffer(r["at"], np.int64).tolist(), grams.tolist(), strict=True)
        wanted = wanted or sorted(runs)
        assert sorted(runs) == wanted


def test_simhash(docs, empty):
    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        import xxhash

        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    fp = {i: brute(t) for i, t in TEXTS}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    ids = list(fp)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if bin(fp[a] ^ fp[b]).count("1") <= 3:
                    label[a] = label[b] = min((x for x in (label[a], label[b]) if x is not None), default=None)
    assert {i: r.component_id for i, r in got.items()} == label
    assert simhash.near_groups(empty).count() == 0


def test_covering_finds_every_pair(spark):
    random.seed(8)
    base = [random.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 6))) for b in base for _ in range(12)})
    masks = simhash.covering_masks(list(range(64)), 3, 1)
    for _ in range(300):
        assert any(not any(m >> k & 1 for k in ks) for ks in [random.sample(range(64), 3)] for m in masks)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for split in (2, 20_000):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), split=split)
        root = {r.node: r.root for r in simhash.components(found).collect()}
        want = {x: x for x in signed}
        changed = True
        while changed:
            changed = False
            for a, u in zip(signed, fps, strict=True):
                for b, v in zip(signed, fps, strict=True):
                    if bin(u ^ v).count("1") <= 3 and want[a] != want[b]:
                        want[a] = want[b] = min(want[a], want[b])
                        changed = True
        assert {x: root.get(x, x) for x in signed} == want


def brute_removed(texts, length):
    seen, out = set(), []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                mark[p : p + length] = True
            seen.add(w)
        out.append(mark)
    return out


def check_removed(made, source, length):
    order = sorted(source, key=lambda x: (x[0] is None, x[0] or 0))
    got = {r.doc_id: r for r in made.collect()}
    for (i, t), mark in zip(order, brute_removed([(t or "").encode() for _, t in order], length), strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], mark.astype(int)])) == 1))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(raw), int(mark.sum()), spans, raw[~mark].tobytes()), i


def test_suffix_dedup(docs, empty, spark):
    check_removed(suffix_dedup.remove_repeats(docs), TEXTS, 100)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = docs.unionByName(docs.filter("doc_id = 7"))
    assert sorted(r.n_removed == r.n_bytes for r in suffix_dedup.remove_repeats(twice).filter("doc_id = 7").collect()) == [False, True]


def test_suffix_dedup_hot_grams(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**9)
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefgh ", k=random.randint(20, 90)))
    made = [(i, word() + COPY + word() + (COPY[20:] if i % 3 else "") + word()) for i in range(60)]
    check_removed(suffix_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string")), made, 100)
    check_removed(suffix_dedup.remove_repeats(docs), TEXTS, 100)


def test_suffix_dedup_deals_out_runs_of_a_hot_gram(spark, monkeypatch):
    """A gram with very many different runs is spread over all buckets, and what is removed stays the same."""
    random.seed(4)
    word = lambda n: "".join(random.choices("abcdefghijklmnop ", k=n))
    made = [(i, word(80) + COPY[:60] + word(80) + (COPY if i % 9 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    rows_ = suffix_dedup.keyed(df)[0].select("key", "text")
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5000)
    total = sum(len(t) for _, t in made)

    def heaviest():
        hot = suffix_dedup.hot_grams(rows_, total, 100, 32)
        shared = spark.sparkContext.broadcast(hot)
        deal = suffix_dedup._deal_runs(16, 100, 32, shared)
        dealt = rows_.mapInArrow(deal, "bucket int, gram binary, cover binary, key binary, at binary, n binary").filter("bucket >= 0")
        sizes = [r.n for r in dealt.groupBy("bucket").agg(F.sum(F.length("key") / 8).alias("n")).collect()]
        return len(hot), max(sizes) / np.median(sizes)

    none, before = heaviest()
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 100)
    some, after = heaviest()
    assert none == 0 and some > 0 and after < 2 < before
    check_removed(suffix_dedup.remove_repeats(df), made, 100)


def test_suffix_dedup_of_texts_longer_than_a_slice(spark):
    rng = random.Random(11)
    a = rng.randbytes(450_000).hex()
    edge = suffix_dedup.SLICE
    texts = [(1, a + rng.randbytes(100_000).hex()), (2, rng.randbytes(2000).hex() + a[edge - 900_000 : edge - 900_000 + 5000] + "z" + rng.randbytes(300).hex()), (3, "q" + a[-70_000:] + "q" * 150)]
    texts[0] = (1, texts[0][1] + texts[0][1][edge - 300 : edge + 300])
    assert len(texts[0][1]) > edge
    check_removed(suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")), texts, 100)


def test_suffix_dedup_on_the_table(spark, table):
    some = [(i, t) for i, t in table if len(t) < 6000][:120]
    df = spark.createDataFrame(some, "doc_id long, text string")
    check_removed(suffix_dedup.remove_repeats(df), some, 100)


def test_suffix_order():
    random.seed(6)
    for length in (5, 16, 23, 100):
        for small in (2, 2048):
            suffix_dedup.SMALL = small
            data = b"".join(random.choice([b"ab", b"abc", b"abcabcabcabcabcabc", b"zz"]) for _ in range(120))
            starts = np.arange(len(data) - length)
            s = suffix_dedup.Suffixes(data, starts, length)
            order, first, end = s.classes()
            cut = [data[i : i + length] for i in starts[order].tolist()]
            assert cut == sorted(cut)
            same = Counter(cut)
            assert sorted((end - first).tolist()) == sorted(n for n in same.values() if n > 1)


def test_language(spark, docs, empty):
    def score(model):
        return {r.doc_id: r for r in language.predict_documents(docs, model).collect()}

    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(source.filter(~language.held_out()))
    found = language.predict_documents(source.filter(language.held_out()), model).join(source.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.rejected for r in found]) < 0.2
    got = score(model)
    assert [got[i].lang_pred for i in (2, 3, 4, 12)] == ["und"] * 4 and got[7].lang_pred in model.languages
    assert language.predict_documents(empty, model).count() == 0
    none = language.train(source.limit(0))
    assert none is None and {r.lang_pred for r in score(none).values()} == {"und"}
    long = "ab cd " * 900_000
    assert len(language.ngram_buckets(long)) == len(language.ngram_buckets("ab cd " * 900)) // 900 * 900_000 + len(language.ngram_buckets("ab cd " * 900)) % 900


def test_toxicity(spark, docs, empty):
    clean = ["rain", "tree", "house", "river", "stone", "cloud", "light", "grass"]
    random.seed(1)
    made = [(i, " ".join(random.choices(clean, k=30)) + (" rotten" if i % 7 == 0 else ""), "en") for i in range(600)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 600, 2)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == 600 and np.mean([r.predicted == int(r.doc_id % 7 == 0) for r in got]) > 0.97
    for r in got[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert toxicity.toxicity(docs, labels).count() == len(TEXTS) and toxicity.toxicity(empty, labels).count() == 0
    none = toxicity.toxicity(df, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.1}
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() < 600


def test_toxicity_scores_by_hand(spark):
    """Scores follow from features and weights; the sample doesn't depend on the layout; held-out rows are told apart."""
    source, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    clean, marks = source.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out())
    model = toxicity.train(clean, marks)
    again = toxicity.train(clean.repartition(7, "text"), marks.repartition(3))
    assert model.features == again.features and np.allclose(model.weights, again.weights, atol=1e-6)
    weight = dict(zip(model.features, model.weights.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in source.collect()}
    long = [(-1, "word " * 400_000 + (max(weight, key=weight.get).rstrip("-") + "xyz ") * 3), (-2, None)]
    scored = toxicity.score_documents(source.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string")), model)
    got = {r.doc_id: r.score for r in scored.collect()}
    for i, t in {**texts, **dict(long)}.items():
        words = set(re.findall(r"[^\W_]+", (t or "").lower()))
        found = words | {w[:n] + "-" for w in words for n in toxicity.BEGINNINGS if len(w) > n}
        z = model.bias + sum(weight.get(x, 0.0) for x in found)
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9, abs_tol=1e-12), i
    asked = [(r.toxic, got[r.doc_id]) for r in labels.filter(toxicity.held_out()).collect() if r.doc_id in got]
    pairs = [(a > b) + (a == b) / 2 for x, a in asked for y, b in asked if x == 1 and y == 0]
    assert np.mean(pairs) > 0.85


def test_toxicity_sample_is_bound(spark):
    rows_ = spark.range(2000).selectExpr("id % 1500 AS doc_id")
    one, two = (sorted(r.doc_id for r in toxicity._sampled(x, 100).collect()) for x in (rows_, rows_.repartition(9, "doc_id")))
    assert one == two and 100 <= len(one) <= 101 and toxicity._sampled(rows_, 5000).count() == 2000


def test_language_scores_by_hand(spark):
    """Predictions follow from n-grams one by one; no language is left out; the sample doesn't depend on the layout."""
    kinds = [f"l{k:03d}" for k in range(230)]
    made = [(10 * k + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("qu", "zor", "mi", "talu")) + f" {j}", lang) for k, lang in enumerate(kinds) for j in range(6)]
    df = spark.createDataFrame([*made, (None, "no language", None), (99_999, None, "l000")], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == kinds
    again = language.train(df.repartition(5, "doc_id"))
    assert np.allclose(model.table, again.table, atol=1e-5)
    m = 0xFFFFFFFF
    for text in ("Aaqu bbzor 12 é", "x", "日本 zor", "aaqu " * 3):
        raw = b" " + text.lower().encode().translate(language._LETTERS) + b" "
        found = []
        for i in range(len(raw)):
            h = raw[i]
            for n in (2, 3, 4):
                if i + n > len(raw):
                    break
                gram = raw[i : i + n]
                h = (h * 0x9E3779B1 + gram[-1] * 0x85EBCA6B + n) & m
                if gram != b"  " and b" " not in gram[1:-1]:
                    found.append(((h * 0xC2B2AE35) & m) >> 16)
        assert sorted(found) == sorted(language.ngram_buckets(text).tolist())
        logits = model.table[found].astype(float).mean(axis=0) + model.bias
        p = np.exp(logits / model.temperature - (logits / model.temperature).max())
        p /= p.sum()
        name, score = model.predict(text)
        assert name == kinds[int(p.argmax())] and math.isclose(score, p.max(), rel_tol=1e-4)
    assert language.train(df.filter("lang IS NULL")) is None


def test_anti_join_stays_above_the_aggregate(spark):
    """Copies are combined before they are dealt out by digest."""
    from folioscope.llm.common import work_dir

    index = exact_dedup.DigestIndex(spark, work_dir(spark, "index"))
    marks = spark.read.parquet(f"{SF}/documents.parquet").transform(exact_dedup.digests)
    plan = index.fresh(marks)._jdf.queryExecution().executedPlan().toString()
    join, aggregate, exchange = (plan.index(x) for x in ("SortMergeJoin", "partial_max", "Exchange hashpartitioning(digest"))
    assert join < exchange < aggregate


def test_rows_are_removed_without_moving_texts(spark, docs):
    kept = exact_dedup.keep_one(docs.filter("doc_id IS NOT NULL"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in kept and "hashpartitioning(doc_id" not in kept


def test_risk_stays_whole():
    """With the mixture's second term negative the gradient turns: confirmed rows are not fitted by heart."""
    rows_, cols = np.arange(40), np.arange(40)
    mark = np.arange(40) < 20
    w, bias = toxicity.fit_nnpu(rows_, cols, mark, 40, 0.5, rounds=400, decay=0.0)
    p = 1 / (1 + np.exp(-(w + bias)))
    risk = 0.5 * -np.log(p[mark]).mean() + max(0.0, -np.log(1 - p[~mark]).mean() - 0.5 * -np.log(1 - p[mark]).mean())
    assert np.isfinite(risk) and abs(w).max() < 60


def test_token_counts(docs, empty):
    def brute(pieces, w):
        i = n = 0
        while i < len(w):
            j = len(w)
            while j > i and tuple(w[i:j]) not in pieces:
                j -= 1
            if j == i:
                return -1
            i, n = j, n + 1
        return n

    random.seed(3)
    for _ in range(400):
        pieces = {tuple(random.choices((0, 1, 2), k=random.randint(1, 5))) for _ in range(random.randint(1, 9))}
        m = token_counts.LongestMatch(pieces)
        for _ in range(10):
            w = random.choices((0, 1, 2), k=random.randint(1, 12))
            assert m.count(w) == brute(pieces, w)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    assert got[2] == got[3] == got[4] == (0, 0) and got[11] == (1, 1)
    with open(token_counts.default_vocabulary()) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    number = {b: c for c, b in token_counts.byte_symbols().items()}

    def spelled(word):
        s = "".join(number[b] for b in word.encode())
        i = n = 0
        while i < len(s):
            j = next(j for j in range(len(s), i, -1) if (s[i:j] + "</w>" if j == len(s) else s[i:j]) in vocabulary)
            i, n = j, n + 1
        return n

    counter = token_counts.Counter(token_counts.default_vocabulary())
    for i in (1, 9, 10):
        text = dict(TEXTS)[i]
        assert got[i] == (len(counter.words(text.lower())), sum(spelled(w) for w in counter.words(text.lower())))
    assert token_counts.token_counts(empty).count() == 0


def test_class_model(spark, docs, empty, table):
    for size, source in ((10, docs), (150_000, docs)):
        class_lm.DICTIONARY = size
        model, counts = class_lm.fit(source.select("doc_id", "text"))
        got = class_lm.score_documents(source.select("doc_id", "text"), model, counts).collect()
        c = Counter(w for _, t in TEXTS for w in class_lm.tokens(t))
        n, v = sum(c.values()), len(c)
        assert len(got) == len(TEXTS)
        for r in got:
            w = class_lm.tokens(dict(TEXTS)[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), len(w), n)
            assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        # The model's odds after any class sum to one over all words and one unknown word of each class.
        total = np.zeros(class_lm.CLASSES)
        for w, k in c.items():
            total[model.cls[model.units.of(w)]] += k
        emitted = (total + 10**model.log_unknown) / 10**model.log_size
        assert np.allclose(emitted, 1) and np.allclose((10**model.transition).sum(axis=1), 1)
        # One score by hand.
        r = next(r for r in got if r.doc_id == 1)
        h, want = 0, 0.0
        for w in class_lm.tokens(dict(TEXTS)[1]):
            k = model.cls[model.units.of(w)]
            want += model.transition[h, k] + math.log10(c[w]) - model.log_size[k]
            h = k
        assert math.isclose(r.score, want, rel_tol=1e-9)
    class_lm.DICTIONARY = 150_000
    model, counts = class_lm.fit(empty.select("doc_id", "text"))
    got = class_lm.score_documents(docs.select("doc_id", "text"), model, counts).collect()
    assert len(got) == len(TEXTS) and all(r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert class_lm.score_documents(empty.select("doc_id", "text"), model, counts).count() == 0


def test_class_model_beats_words_alone(spark):
    got = class_lm.op10_class_lm(spark, SF).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_every_unit_is_placed_by_all_its_neighbours(spark, monkeypatch):
    """Classes, transitions and scores as a plain loop over the texts makes them; rare words are scored by the same classes."""
    monkeypatch.setattr(class_lm, "LEXICON", 5)
    monkeypatch.setattr(class_lm, "DICTIONARY", 40)
    monkeypatch.setattr(class_lm, "HELD_CELLS", 100)
    monkeypatch.setattr(class_lm, "TASKS", 2)
    random.seed(5)
    kinds = [[f"{a}{k}" for k in range(20)] for a in ("det", "adj", "noun")]
    texts = [(i, " ".join(random.choice(kinds[k % 3]) for k in range(random.randint(0, 40)))) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    counts, units, count = class_lm.dictionary(docs)
    model = class_lm.learn(class_lm.coded(docs, units), counts, units, count)
    flat = [0]
    for _, t in texts:
        flat.extend(units.of(w) for w in class_lm.tokens(t))
    core = units.core()
    size, c = 1 + class_lm.LEXICON + class_lm.SHAPES, class_lm.CLASSES
    pairs = np.zeros((size, size))
    for a, b in zip(flat, flat[1:]):
        pairs[core[a], core[b]] += 1
    cls = class_lm.exchange(pairs, c)[core]
    for _ in range(class_lm.SWEEPS_ALL):
        joint = np.zeros((c, c))
        for a, b in zip(flat, flat[1:]):
            joint[cls[a], cls[b]] += 1
        after = np.log(joint + 0.1) - np.log(joint.sum(axis=1, keepdims=True) + 1)
        before = np.log(joint + 0.1) - np.log(joint.sum(axis=0, keepdims=True) + 1)
        new = cls.copy()
        for u in sorted({u for u, k in Counter(flat[1:]).items() if u and k >= class_lm.LEAST_PLACED}):
            gain = np.zeros(c)
            for a, b in zip(flat, flat[1:]):
                if a == u:
                    gain += after[:, cls[b]]
                if b == u:
                    gain += before[cls[a]]
            gain[0] = -np.inf
            new[u] = gain.argmax()
        cls = new
    assert (cls == model.cls).all() and len({cls[units.of(f"noun{k}".encode())] for k in range(20)} & {cls[units.of(f"det{k}".encode())] for k in range(20)}) <= 3
    total = Counter(w for _, t in texts for w in class_lm.tokens(t))
    got = {r.doc_id: r for r in class_lm.score_documents(docs, model, counts).collect()}
    for i, t in texts:
        h, want = 0, 0.0
        for w in class_lm.tokens(t):
            k = cls[units.of(w)]
            want += model.transition[h, k] + math.log10(total[w]) - model.log_size[k]
            h = k
        assert math.isclose(got[i].score, want, rel_tol=1e-9) and got[i].n_known == got[i].n_tokens


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    n = 25
    group = np.array([0] + [1 + k % 2 for k in range(n - 1)])
    pairs = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            pairs[a, b] = rng.poisson(1 if group[a] == group[b] else 30)
    cls = class_lm.exchange(pairs, classes=3)
    assert cls[0] == 0 and len({(g, c) for g, c in zip(group[1:].tolist(), cls[1:].tolist(), strict=True)}) == 2


def test_arc_to_warc(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 7\r\n\r\n\xff\x00WARC/1"
    records = [
        archives.ArcRecord("http://a.example/", "1.2.3.4", "20010203", "text/html", body),
        archives.ArcRecord("dns:a.example", "1.2.3.4", "20010203040506", "text/dns with blanks", b"WARC/1.0\r\n\r\n\n\n"),
        archives.ArcRecord("http://b.example/", "1.2.3.4", "20010203040506", "text/html", b""),
    ]
    for version in (1, 2):
        data = archives.write_arc(records, version)
        assert [(r.url, r.date, r.kind, r.body) for r in archives.parse_arc(data)] == [(r.url, r.date, r.kind, r.body) for r in records]
        assert list(archives.parse_arc(gzip.compress(data))) == list(archives.parse_arc(data))
        short = list(archives.parse_arc(data[:-30]))
        assert len(short) <= 3 and all(not r.truncated for r in short[:-1])
        (tmp_path / "arc").mkdir(exist_ok=True)
        (tmp_path / f"arc/v{version}.arc").write_bytes(data)
    (tmp_path / "arc/broken.arc").write_bytes(b"no archive at all\n")
    archives.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = archives.read_warc(spark, str(tmp_path / "warc")).collect()
    assert Counter(r.record_type for r in got) == {"response": 2, "resource": 4, "unknown": 1}
    first = next(r for r in got if r.url == "http://a.example/")
    assert first.date == "2001-02-03T00:00:00Z" and first.payload_bytes == 8
    assert first.payload_digest == base64.b32encode(hashlib.sha1(b"\xff\x00WARC/1").digest()).decode()


def test_converted_archives_describe_themselves(spark, tmp_path):
    records = [archives.ArcRecord("http://a.example/", "1.2.3.4", "20010203", "text/html", b"HTTP/1.1 200 OK\r\n\r\nx" * 3)]
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        (tmp_path / f"arc/v{version}.arc").write_bytes(archives.write_arc(records, version, f"v{version}.arc"))
    archives.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = archives.read_warc(spark, str(tmp_path / "warc"), info=True).collect()
    assert Counter(r.record_type for r in got) == {"warcinfo": 2, "response": 2} and {r.state for r in got} == {"whole"}
    assert len({r.record_id for r in got if r.record_type == "warcinfo"}) == 2
    # One gzip member a record, each readable by itself.
    data = next(f.read_bytes() for f in (tmp_path / "warc").glob("part-*") if f.stat().st_size)
    whole = list(archives.members(data))
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in whole) and gzip.decompress(data) == b"".join(whole)


def test_damaged_archives(spark, tmp_path):
    made = [archives.to_warc(archives.ArcRecord(f"http://{k}.example/", "0.0.0.0", "2001", "text/plain", f"body {k} ".encode() * 50)) for k in range(4)]
    plain = b"".join(r + b"\r\n\r\n" for r in made)
    packed = b"".join(archives.gzip_member(r) for r in made)
    (tmp_path / "w").mkdir()

    def states(data):
        (tmp_path / "w/x").write_bytes(data)
        return [(r.record_type, r.state) for r in archives.read_warc(spark, str(tmp_path / "w")).collect()]

    good = [("resource", "whole")] * 4
    assert states(plain) == states(packed) == good
    assert states(plain[:-100]) == [*good[:3], ("resource", "truncated")]
    assert states(packed[: len(packed) - 20])[:3] == good[:3]
    assert states(plain.replace(b"body 2 body", b"bodY 2 body", 1)) == [*good[:2], ("resource", "digest mismatch"), good[3]]
    assert states(made[0] + b"\r\n\r\n" + made[1].replace(b"Content-Length", b"Content-Size")) == [good[0], ("resource", "unreadable")]
    assert states(b"nothing of the kind") == [("unknown", "unreadable")] and states(b"") == []
    arc = gzip.compress(archives.write_arc([archives.ArcRecord("http://a/", "0.0.0.0", "2001", "text/html", random.Random(1).randbytes(200_000))], 1))
    cut = list(archives.parse_arc(arc[: len(arc) // 2]))
    assert len(cut) == 1 and cut[0].truncated and 1000 < len(cut[0].body) < 200_000


def test_pages_of_one_id_and_hot_payloads(spark, tmp_path, monkeypatch):
    """Every different record has an identifier of its own; payloads of many rows give what others give."""
    pages = [(1, "u", "one"), (1, "u", "two"), (2, "v", "one"), (2, "w", "two"), (3, "u", "one"), (4, "x", "other")] + [(10 + k, f"e{k}", None) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = []
    for share in (1000, 20):
        monkeypatch.setattr(archives, "HOT_SHARE", share)
        path = str(tmp_path / f"w{share}")
        archives.archive_pages(df, path)
        got = archives.page_records(archives.read_warc(spark, path)).collect()
        assert len({r.record_id for r in got}) == len(pages) == len(got)
        found.append(sorted((r.page_id, r.url, r.payload_digest, r.record_type, r.refers_to or "") for r in got))
    assert found[0] == found[1]
    for page, _, digest, kind, to in found[0]:
        same = max(int(p) for p, _, d, _, _ in found[0] if d == digest)
        assert (kind, to) == (("response", "") if int(page) == same else ("revisit", str(same)))


def test_pages_round_trip(spark, tmp_path):
    pages = [(1, "http://x/ y", "same"), (2, None, "same"), (3, "http://z", None), (4, "u", ""), (5, "v", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1 é"), (6, "w", "x" * 300_000), (None, "n", "same"), (7, "r", "own"), (7, "r", "own")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    archives.archive_pages(df, str(tmp_path / "w"))
    got = archives.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    for r in got:
        html = next((h or "") for i, _, h in pages if str(i) == (r.page_id if r.page_id != "null" else "None"))
        same = [i for i, _, h in pages if (h or "") == html and i is not None]
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r.record_type == ("response" if r.page_id == str(max(same)) else "revisit")
    empty = df.limit(0)
    archives.archive_pages(empty, str(tmp_path / "e"))
    assert archives.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_names():
    import __spark_entry__ as entry

    found = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_language_draws(spark):
    """The cut before the ranks changes no threshold: many rows, few rows, and rows that are all alike."""
    import random

    r = random.Random(5)
    draws = [("many", r.randrange(-(2**63), 2**63)) for _ in range(6000)] + [("few", r.randrange(-(2**63), 2**63)) for _ in range(40)]
    draws += [("alike", 2**62)] * 3000 + [("edge", -(2**63)), ("edge", 2**63 - 1)]
    draws += [("low", -(2**63) + k) for k in range(2000)] + [("high", 2**63 - 1 - k) for k in range(2000)]
    got = {x.lang: x.last for x in language.last_draws(spark.createDataFrame(draws, "lang string, draw long").repartition(7)).collect()}
    want = {}
    for lang in {x for x, _ in draws}:
        own = sorted(d for x, d in draws if x == lang)
        want[lang] = own[min(len(own), language.PER_LANGUAGE) - 1]
    assert got == want
