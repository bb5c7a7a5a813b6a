"""Finds a large dictionary in texts by equi-joins: no dictionary in the driver, no automaton in a task.

A surface that is one word is looked for among the words of the texts, counted by text before they meet it. Any other, of
several words or with Han, is looked for at its rarest gram of Q code points, as counted in the texts. Texts are cut into pieces with
as much around them as the longest surface needs, grams of the pieces meet the surfaces that they stand for, and the
whole surface and its two ends are compared there. Every occurrence has one such gram, so it is found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.graph import written
from folioscope.operators.search import small

Q = 4
#: What stands in a word.
SOLID = r"[\p{L}\p{N}_]"
#: Code points of a piece, without what stands around it.
PIECE = 512
#: Keys that are sent to all tasks at most; more are joined by a shuffle, whose crowded partitions are split at run time.
KEYS = 200_000


def _grams(rows: DataFrame, text: str, first: Column, last: Column, keep: list[str]) -> DataFrame:
    """keep, at and gram for each place of `text` from first to last that begins a whole gram."""
    last = F.least(last, F.char_length(text) - (Q - 1))
    at = F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("at")
    return rows.select(*keep, at).withColumn("gram", F.substring(F.col(text), F.col("at"), F.lit(Q)))


def dictionary_join(docs: DataFrame, surfaces: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, surface, n): all occurrences of surfaces in texts, case aside, overlaps counted, whole words outside Han.

    Surfaces of fewer than Q code points, null surfaces and null texts are left out; repeated ids add up.
    """
    lower = surfaces.select(F.lower("surface").alias("surface")).filter(F.char_length("surface") >= Q).distinct()
    words = written(lower.withColumn("one", F.col("surface").rlike(f"^{SOLID}+\\z") & ~X.has_han(F.col("surface"))), "dictionary")
    found = _whole_words(docs, words.filter("one").select("surface"), id_col, text_col)
    others = words.filter(~F.col("one")).select("surface")
    return found if others.limit(1).count() == 0 else found.unionByName(_by_grams(docs, others, id_col, text_col))


def _whole_words(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, surface, n) of surfaces that are one word each: they stand in a text where they are a whole run of it."""
    runs = F.regexp_extract_all(F.lower(text_col), F.lit(f"{SOLID}{{{Q},}}"), F.lit(0))
    counted = docs.select(id_col, F.explode(runs).alias("surface"))
    few = small(words, KEYS)
    if few is not words:
        counted = counted.join(few, "surface", "left_semi")
    counted = counted.groupBy(id_col, "surface").agg(F.count("*").alias("n"))
    return counted if few is not words else counted.join(words, "surface", "left_semi").select(id_col, "surface", "n")


def _by_grams(docs: DataFrame, words: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, surface, n) of surfaces of any kind, each at its rarest gram."""
    longest = words.agg(F.coalesce(F.max(F.char_length("surface")), F.lit(0))).first()[0]
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("_low")).filter(F.char_length("_low") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.char_length("_low"), F.lit(PIECE))).alias("start")
    pieces = low.select("id", "_low", starts).withColumn("base", F.greatest(F.lit(1), F.col("start") - (longest + 1)))
    pieces = pieces.select("id", (F.col("start") - F.col("base") + 1).alias("first"), F.expr(f"substring(_low, base, start - base + {PIECE + longest + 1})").alias("piece"))
    at = _grams(pieces, "piece", F.col("first"), F.col("first") + (PIECE - 1), ["id", "piece"])

    own = _grams(words, "surface", F.lit(1), F.char_length("surface"), ["surface"])
    known = written(own.select("gram").distinct(), "dictionary-grams")
    count = at.select("gram").join(small(known, KEYS), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    # A surface with a gram that no text has is nowhere.
    rarest = own.join(count, "gram", "left").groupBy("surface").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram")).alias("k"))
    keys = written(rarest.filter("k.n > 0").select("surface", F.col("k.gram").alias("gram"), F.col("k.at").alias("off"), X.has_han(F.col("surface")).alias("han")), "dictionary-keys")

    found = at.join(small(keys, KEYS), "gram").withColumn("begin", F.col("at") - F.col("off") + 1)
    size = F.char_length("surface")
    whole = (F.col("begin") >= 1) & (F.substring(F.col("piece"), F.col("begin"), size) == F.col("surface"))
    solid = lambda place: F.substring(F.col("piece"), place, F.lit(1)).rlike(SOLID)
    ends = ~((F.col("begin") > 1) & solid(F.greatest(F.col("begin") - 1, F.lit(1)))) & ~solid(F.col("begin") + size)
    return found.filter(whole).filter(F.col("han") | ends).groupBy(F.col("id").alias(id_col), "surface").agg(F.count("*").alias("n"))
