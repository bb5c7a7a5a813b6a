"""The pipeline against a brute-force version of each stage."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from folioscope.llm import toxicity
from folioscope.llm.simhash import text_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    now, steps = docs, []
    for _, f in corpus_pipeline.STAGES:
        now = f(spark, now, SF).cache()
        steps.append(now)
    for s in steps[:-1]:
        assert s.columns == docs.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    given, clean, exact, near, cut = (text(x) for x in (docs, *steps[:4]))

    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert set(clean) == set(given) - rejected

    last = {}
    for i, t in clean.items():
        last[t] = max(i, last.get(t, i))
    assert set(exact) == set(last.values())

    ids = sorted(exact)
    fp = np.array([text_fingerprint(exact[i]) for i in ids], np.uint64)
    label = np.arange(len(ids))
    close = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
    for _ in ids:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            break
        label = new
    assert set(near) == {ids[k] for k in label}

    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    windows = set()
    for t in bench:
        w = word.findall(t.encode().lower())
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    for i, t in near.items():
        raw = t.encode()
        found = list(word.finditer(raw.lower()))
        w = [m.group() for m in found]
        hit = np.zeros(len(w), bool)
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = True
        kept, at, j = b"", 0, 0
        while j < len(w):
            if hit[j]:
                k = j
                while k + 1 < len(w) and hit[k + 1]:
                    k += 1
                kept += raw[at : found[j].start()]
                at, j = found[k].end(), k
            j += 1
        assert cut[i] == (kept + raw[at:]).decode()

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in steps[4].collect():
        want = ref.encode(cut[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
    assert {r.doc_id for r in steps[4].collect()} == set(near)


def test_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        none = f(spark, none, SF)
    assert none.count() == 0
