"""Hooks for models: embedding, reranking and surface extraction run as Arrow functions over batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A retrieval channel: (session, context) -> rows (file_id, page, score).
Channel = Callable[..., DataFrame]

CHANNELS: dict[str, Channel] = {}


def channel(name: str) -> Callable[[Channel], Channel]:
    """Registers a channel under a name."""

    def keep(f: Channel) -> Channel:
        CHANNELS[name] = f
        return f

    return keep


def hashing_vector(text: str, width: int = 64) -> list[float]:
    """A unit vector of hashed words: the default where no model is given."""
    v = np.zeros(width)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % width] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embedder(encode: Callable[[list[str]], list[list[float]]] | None = None):
    """A column function from text to a vector; encode takes a batch of texts."""
    run = encode or (lambda texts: [hashing_vector(t) for t in texts])

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(run(texts.fillna("").tolist()))

    return embed


#: Fixed value: code points of a text that a reranking model is shown.
RERANK_LENGTH = 6000


def reranker(score: Callable[[list[str], list[str]], list[float]] | None = None, length: int | None = RERANK_LENGTH):
    """A column function from (query, text) to a score; without a model the share of query words in the text.

    Texts are shown up to `length` code points, whole if it is None.
    """

    def overlap(queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set(q.lower().split()), set(t.lower().split())
            out.append(len(a & b) / len(a) if a else 0.0)
        return out

    run = score or overlap

    @F.pandas_udf("double")
    def rerank(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(run(queries.fillna("").tolist(), texts.fillna("").str.slice(0, length).tolist()))

    return rerank
