"""Text functions on literal cases."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import folding
from folioscope.functions import text as X


def column(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "given,wanted",
    [("万通危疾加护保(", "万通危疾加护保"), ("丰裕医疗保（", "丰裕医疗保"), ("万通危疾爱护保(phpj)", "万通危疾爱护保(phpj)"), ("中国平安,", "中国平安"), ("万通危疾加护保 保单。(", "万通危疾加护保 保单"), ("<b>Apex</b>  Plan.", "Apex Plan")],
)
def test_clean_surface(spark, given, wanted):
    assert column(spark, X.clean_surface, given) == [wanted]


def test_canonical_and_key(spark):
    assert column(spark, X.canonical, "The  Apex Plan", "AN Eclipse", "The 保险") == ["apex plan", "eclipse", "the 保险"]
    assert column(spark, X.surface_key, "HKD 300", "HKD300", "a", "123", "Nobel Prize,", None) == ["hkd 300", None, None, None, "nobel prize", None]


def test_predicates(spark):
    assert column(spark, X.is_composite, "美元、港元", "甲(乙)或丙(丁)", "Apex (Premium)") == [True, True, False]
    assert column(spark, X.is_broad, ".*", "ab", "abc", r"\d+abc") == [True, True, False, False]
    assert column(spark, X.is_misbound, "万通。保险", "Apex Plan", "x" * 60) == [True, False, True]


def test_small_functions(spark):
    assert column(spark, X.page_number, "p_0007", "7", "p_x") == [7, None, None]
    assert column(spark, X.language, "hello", "保险 x", None) == ["en", "zh", "en"]
    assert column(spark, X.one_line, "a\t\r\nb ") == ["a b"]
    assert column(spark, X.table_format, "<TABLE>", "a|b", "x") == ["html", "markdown", "none"]
    assert column(spark, lambda c: X.image_paths(c, "img/"), "![a](x.png) ![b](https://e/x.png)") == ["![a](img/x.png) ![b](https://e/x.png)"]
    assert column(spark, X.catalogue_parts, "美元、港元；人民币", "ABC, Inc.") == [["美元", "港元", "人民币"], ["ABC, Inc."]]
    assert column(spark, X.surface_tokens, "Apex 万通保") == [["w:apex", "h:万通", "h:通保"]]


def test_sentences(spark):
    text = "Einstein won the Nobel Prize. Curie also won the Nobel Prize!\n\nShort. The award is prestigious."
    assert column(spark, X.sentences, text, "", None) == [["Einstein won the Nobel Prize.", "Curie also won the Nobel Prize!", "The award is prestigious."], [], None]


def test_nfkc_of_all_code_points(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and c != 0xFEFF]  # a mark of byte order to the decoder
    df = spark.range(1, sys.maxunicode + 1).filter("NOT id BETWEEN 55296 AND 57343 AND id <> 65279").repartition(4)
    back = df.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = dict(back.select("id", folding.nfkc(F.concat(F.lit("a"), F.col("c"), F.lit("\u0301"))).alias("k")).toPandas().itertuples(index=False, name=None))
    assert got == {c: unicodedata.normalize("NFKC", f"a{chr(c)}\u0301") for c in points}


def test_repair_and_entities(spark):
    given = ["FranÃ§ois &amp; cafÃ©", "&eacute;t&eacute; &#8364;&#x41;", "Ã\x83Â©", "naïve É“ A&B", "â\x80\x99s â€™s", "e\u0301", "", None]
    assert column(spark, folding.decoded, *given) == ["François & café", "été €A", "é", "naïve É“ A&B", "’s ’s", "é", "", None]
    assert column(spark, X.surface_key, "ﬁnance", "The Ｃａｆé", "Caf&eacute; Ⅳ") == ["finance", "café", "café iv"]


def test_simplified_han(spark):
    pairs = folding.han_pairs(spark)
    assert len(pairs[0]) == len(pairs[1]) > 1000
    key = lambda c: X.surface_key(c, pairs)
    assert column(spark, key, "萬通保險", "富饒萬家儲蓄保險計劃", "万通保险", "盛利II", None) == ["万通保险", "富饶万家储蓄保险计划", "万通保险", "盛利ii", None]
    phrases = {"乾坤": "乾坤", "乾坤大": "乾坤·大", "頭髮": "头发"}
    fold = lambda c: folding.simplified(c, pairs, phrases)
    assert column(spark, fold, "乾坤與頭髮", "乾坤大", "萬", "", None) == ["乾坤与头发", "乾坤·大", "万", "", None]


def test_unique_surfaces(spark):
    from folioscope.operators.corpus import unique_surfaces

    rows = [(1, ["The Apex", "Nobel,", "apex", "usd300", None, "NOBEL"]), (2, []), (3, None)]
    got = unique_surfaces(spark.createDataFrame(rows, "id int, s array<string>"), "id", "s")
    assert {r.id: r.surfaces for r in got.collect()} == {1: ["apex", "nobel"], 2: [], 3: []}


def test_catalogue_parts_keep_their_digits(spark):
    assert column(spark, X.catalogue_parts, "0 zero 0、 10 one 1；2") == [["0 zero 0", "10 one 1", "2"]]
