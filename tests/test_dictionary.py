"""The dictionary join against a plain search of every surface in every text."""

import random
import re

import pytest

from folioscope.operators import dictionary


def plain(texts, surfaces):
    out = {}
    for key, text in texts:
        low = (text or "").lower()
        for s in {x.lower() for x in surfaces if x and len(x) >= 4}:
            han = re.search("[一-鿿]", s)
            for m in re.finditer(f"(?={re.escape(s)})", low):
                a, b = m.start(), m.start() + len(s)
                solid = lambda c: c == "_" or c.isalnum()
                if han or not (a and solid(low[a - 1])) and not (b < len(low) and solid(low[b])):
                    out[key, s] = out.get((key, s), 0) + 1
    return out


@pytest.mark.parametrize("piece", [7, 512])
def test_dictionary_join(spark, monkeypatch, piece):
    monkeypatch.setattr(dictionary, "PIECE", piece)
    rng = random.Random(8)
    texts = [(k, "".join(rng.choice(["abcd", "ab", " ", "-", "é", "Apex Plan", "通保险公司", "aaaa", "_"]) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "abc"), (103, "apex plan" * 3 + " Apex  plan apex plan"), (103, "abcd"), (104, "x" * 2000 + " abcd")]
    surfaces = ["Apex Plan", "apex plan", "abcd", "aaaa", "aaaaaaaa", "abcdab", "通保险公", "保险公司通", None, "", "abc", "nowhere", "-abcd-", "é-ab", "x" * 2000, "ab ab"]
    d = spark.createDataFrame(texts, "id int, text string")
    s = spark.createDataFrame([(x,) for x in surfaces], "surface string")
    got = {(r["id"], r["surface"]): r["n"] for r in dictionary.dictionary_join(d, s, "id", "text").collect()}
    assert got == plain(texts, surfaces) and len(got) > 100
    assert dictionary.dictionary_join(d, s.limit(0), "id", "text").count() == 0
    assert dictionary.dictionary_join(d.limit(0), s, "id", "text").count() == 0


def test_words_are_looked_for_as_words(spark):
    """A dictionary of words alone reads no grams: a text's places are not rows; words in longer ones are none."""
    d = spark.createDataFrame([(1, "Apex apex_ apexes APEX-apex é_ab12 éclairs"), (1, "apex"), (2, None), (3, "nothing")], "id int, text string")
    s = spark.createDataFrame([("Apex",), ("é_ab12",), ("Éclair",), (None,), ("abc",)], "surface string")
    found = dictionary.dictionary_join(d, s, "id", "text")
    assert {(r["id"], r["surface"]): r["n"] for r in found.collect()} == {(1, "apex"): 4, (1, "é_ab12"): 1}
    assert "sequence(" not in found._jdf.queryExecution().toString()
