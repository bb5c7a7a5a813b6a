"""Score formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank fusion, term weighting.
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75


def saturating(score: Column) -> Column:
    """Sum over the root of one more than the count."""
    return F.sum(score) / F.sqrt(F.count(score) + 1)


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return 1.0 / (k + rank)


def bm25_idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, mean: Column, idf: Column) -> Column:
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def surface_idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1) / (df + 0.5))


def regex_score(weight: Column, n: Column, df: Column, ratio: Column, plain: Column, broad: Column) -> Column:
    """Weight, rarity, length share between 0.1 and 1, and penalties for digits and broad patterns."""
    share = F.least(F.greatest(F.log1p(ratio), F.lit(0.1)), F.lit(1.0))
    return weight * F.ln((n + 1) / (df + 1)) * share * F.when(plain, 0.2).otherwise(1.0) * F.when(broad, 0.3).otherwise(1.0)


def hub_damping(weight: Column, df: Column, power: float = 0.5) -> Column:
    """Weights of nodes with more than one passage shrink by a power of their number."""
    return F.when(df > 1, weight * F.pow(df.cast("double"), F.lit(-power))).otherwise(weight)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 1.0).otherwise((x - low) / (high - low))
