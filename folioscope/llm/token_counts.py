"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, from the left, the longest vocabulary piece that fits. The automaton
is a trie of the pieces whose nodes have failure links: where a node has no child for the next symbol, a
prefix of what was read splits for certain, and the link leads to the node of what is left. How many
pieces that prefix has is stored with the link, so that a word is counted in one pass over its symbols,
with no piece ever built.

Symbols are bytes; a word's last byte is a symbol of its own, as the vocabulary tells word-final pieces
from others. Each task counts a distinct word once and remembers it, within REMEMBERED words.

Defined cases: null and empty texts, and texts of white space, have no words and no tokens; a word that
the vocabulary can't split counts as one unknown token; long texts are counted whole and repeated rows alike; an
empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import id_and_text, record_batch, small_batches, table

FINAL = 256
REMEMBERED = 500_000


class LongestMatch:
    """Counts greedy longest-match pieces of symbol sequences."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.child: dict[int, int] = {}
        ends = [False]
        parent, symbol, depth = [0], [0], [0]
        for piece in pieces:
            node = 0
            for s in piece:
                key = node << 9 | s
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(ends)
                    ends.append(False)
                    parent.append(node)
                    symbol.append(s)
                    depth.append(depth[node] + 1)
                node = nxt
            ends[node] = node != 0
        # Links by depth: -1 where no split is certain, which makes the word unknown.
        self.link = [-1] * len(ends)
        self.popped = [0] * len(ends)
        for node in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            up, popped = self.link[parent[node]], self.popped[parent[node]]
            while up >= 0 and (up << 9 | symbol[node]) not in self.child:
                popped += self.popped[up]
                up = self.link[up]
            if up >= 0:
                self.link[node], self.popped[node] = self.child[up << 9 | symbol[node]], popped

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of the sequence; -1 if it can't be split."""
        child, link, popped = self.child, self.link, self.popped
        node = total = 0
        for s in symbols:
            nxt = child.get(node << 9 | s)
            while nxt is None:
                total += popped[node]
                node = link[node]
                if node < 0 or node == 0 and (s not in child):
                    return -1
                nxt = child.get(node << 9 | s)
            node = nxt
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return total


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def load(vocabulary: str) -> tuple[LongestMatch, str]:
    """The automaton of a vocabulary file, and its pattern of words."""
    with open(vocabulary) as f:
        spec = json.load(f)
    suffix = spec["model"]["end_of_word_suffix"]
    number = byte_symbols()
    added = {x["content"] for x in spec["added_tokens"]}
    pieces = []
    for piece in spec["model"]["vocab"]:
        if piece in added:
            continue
        final = piece.endswith(suffix) and piece != suffix
        symbols = [number[c] for c in (piece.removesuffix(suffix) if final else piece)]
        pieces.append((*symbols[:-1], symbols[-1] + FINAL * final))
    pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    return LongestMatch(pieces), pattern


class Counter:
    """Words and tokens of texts."""

    def __init__(self, vocabulary: str):
        self.match, pattern = load(vocabulary)
        self.words = regex.compile(pattern).findall
        self.held: dict[str, int] = {}

    def word(self, w: str) -> int:
        raw = w.encode()
        n = self.match.count((*raw[:-1], raw[-1] + FINAL))
        if len(self.held) >= REMEMBERED:
            self.held.clear()
        self.held[w] = n = 1 if n < 0 else n
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        found = self.words(unicodedata.normalize("NFC", text).lower())
        get, total = self.held.get, 0
        for w in found:
            n = get(w)
            total += self.word(w) if n is None else n
        return len(found), total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row."""
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    vocabulary = vocabulary or default_vocabulary()
    number = source.schema["doc_id"].dataType.simpleString() == "bigint"
    if not number:
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = pa.schema([("doc_id", pa.int64() if number else pa.string()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            made = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield record_batch(schema, doc_id=batch.column(0), n_words=[x for x, _ in made], n_tokens=[x for _, x in made])

    return source.mapInArrow(run, f"doc_id {'bigint' if number else 'string'}, n_words bigint, n_tokens bigint")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
