"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the characters cuts each text into chunks whose borders depend on content alone, so
that passages shared by documents yield the same chunks. A chunk is encoded once per task, by itself, and
reused wherever it comes again. What an encoding of a chunk says about its end is only trusted up to the
last piece that further text couldn't change. From there the join is encoded anew in the whole text, in a
window that is widened until it agrees exactly with the next chunk: until one of its pieces ends where a
piece of that chunk's own encoding ends (or runs past the chunk, to the next one). The pattern that makes
pieces looks ahead, never back, so two splits that share a border agree from there on, and the ids equal
those of the whole text.

Reuse is per task, in stores bounded by CACHE_BYTES and PIECE_BYTES; nothing is shuffled.

Defined cases: a null text is empty and has no ids; an empty input gives no rows; repeated rows get the same
ids each; a very long run of one kind (letters, blanks, line feeds) is one piece over many chunks, at which
the window ends when it has reached its end; special tokens in a text stand between separately encoded
parts; a null id is passed on; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import id_and_text, record_batch, release_memory, small_batches, table

#: Chunks are cut where the top bits of the rolling hash are zero: 2**CUT_BITS characters on average.
CUT_BITS = 9
#: Characters of a chunk at least, and at most.
LEAST_CHUNK = 64
LONGEST_CHUNK = 1 << 16
#: Characters of a window over a join at first.
WINDOW = 48
#: Characters that the pattern looks at from a piece's start at most, besides the piece and the one after it.
AHEAD = 3
#: Characters whose hash is computed at once.
SLICE = 1 << 20
#: Bytes that a task's store of encoded chunks, and that of encoded pieces, may hold before it is emptied.
CACHE_BYTES = 48_000_000
PIECE_BYTES = 96_000_000
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def hash_cuts(c: np.ndarray) -> np.ndarray:
    """Positions where the hash of the 16 characters before them has CUT_BITS zero bits at the top."""
    if len(c) <= 16:
        return np.empty(0, np.int64)
    h = (c + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    factor = 0x01000193
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + np.uint32(factor) * h[:-step]
        factor = factor * factor & 0xFFFFFFFF
    return np.flatnonzero(h[16:] >> np.uint32(32 - CUT_BITS) == 0) + 17


def chunk_cuts(text: str) -> list[int]:
    """The text's ends and the borders of its chunks."""
    n = len(text)
    cuts = [0]
    for at in range(0, n, SLICE):
        part = np.frombuffer(text[max(0, at - 17) : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        for cut in (hash_cuts(part) + max(0, at - 17)).tolist():
            while cut - cuts[-1] > LONGEST_CHUNK:
                cuts.append(cuts[-1] + LONGEST_CHUNK)
            if cut - cuts[-1] >= LEAST_CHUNK and n - cut >= LEAST_CHUNK:
                cuts.append(cut)
    while n - cuts[-1] > LONGEST_CHUNK:
        cuts.append(cuts[-1] + LONGEST_CHUNK)
    return [*cuts, n]


@dataclass
class Chunk:
    """A chunk encoded by itself: its pieces' ends, the bytes of ids before each piece, and the ids of four bytes each."""

    ends: array
    before: array
    ids: bytes
    trusted: int  # pieces that no following text can change


class ChunkEncoder:
    """Encodes and decodes texts, keeping the chunks and pieces that it has encoded."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken
        from tokenizers import Regex, pre_tokenizers

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.pieces = [b""] * (max([SPECIAL_ID, *ranks.values()]) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.pieces[SPECIAL_ID] = SPECIAL.encode()
        self.findall = regex.compile(pattern).findall
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.chunks: dict[str, Chunk] = {}
        self.held: dict[str, bytes] = {}
        self.chunk_bytes = self.piece_bytes = 0
        self.asked = self.made = self.joins = self.widened = 0

    def split(self, text: str) -> list[str]:
        """The pieces of a text by itself. Later scripts go to the library's own splitter, whose Unicode tables may be older."""
        if text.isascii() or max(text) < "\u0500":
            return self.findall(text)
        return [text[i:j] for _, (i, j) in self.splitter.pre_tokenize_str(text)]

    def piece(self, piece: str) -> bytes:
        ids = self.held.get(piece)
        if ids is None:
            ids = array("I", self.bpe._encode_single_piece(piece)).tobytes()
            if len(piece) <= LONGEST_CHUNK:
                size = 220 + len(piece) + len(ids)
                self.piece_bytes += size
                if self.piece_bytes > PIECE_BYTES:
                    self.held.clear()
                    self.piece_bytes = size
                self.held[piece] = ids
        return ids

    def chunk(self, text: str) -> Chunk:
        self.asked += 1
        found = self.chunks.get(text)
        if found is None:
            self.made += 1
            pieces = self.split(text)
            get, make = self.held.get, self.piece
            ids = [get(p) or make(p) for p in pieces]
            ends = array("i", accumulate(map(len, pieces)))
            before = array("i", accumulate(map(len, ids), initial=0))
            found = Chunk(ends, before, b"".join(ids), bisect_right(ends, len(text) - AHEAD))
            size = 600 + len(text) + 8 * len(ends) + before[-1]
            self.chunk_bytes += size
            if self.chunk_bytes > CACHE_BYTES:
                self.chunks.clear()
                self.chunk_bytes = size
            self.chunks[text] = found
        return found

    def join(self, text: str, cuts: list[int], parts: list[Chunk], at: int, k: int) -> tuple[bytearray, int, int]:
        """Encodes from a border of chunk k until the pieces agree with those of a later chunk.

        Gives the ids, that chunk's number and the number of its pieces that lie before the common border;
        past the last chunk where the text ended first.
        """
        self.joins += 1
        n, size, j, out = len(text), WINDOW, k, bytearray()
        while at < n:
            stop = min(n, at + size)
            last = stop if stop == n else stop - AHEAD
            began = at
            for p in self.split(text[at:stop]):
                if at + len(p) > last:
                    break
                at += len(p)
                out += self.piece(p)
                while j + 1 < len(parts) and at >= cuts[j + 1]:
                    j += 1
                if j > k:
                    inside = at - cuts[j]
                    if not inside:
                        return out, j, 0
                    ends = parts[j].ends
                    i = bisect_left(ends, inside)
                    if i < len(ends) and ends[i] == inside:
                        return out, j, i + 1
            if at == began:
                size *= 2
                self.widened += 1
        return out, len(parts), 0

    def encode_part(self, text: str) -> Iterator[bytes | bytearray]:
        """The ids of a text without special tokens, chunk by chunk."""
        cuts = chunk_cuts(text)
        parts = [self.chunk(text[i:j]) for i, j in zip(cuts, cuts[1:])]
        k = first = 0
        while k < len(parts):
            c = parts[k]
            end = len(c.ends) if k + 1 == len(parts) else max(first, c.trusted)
            yield c.ids[c.before[first] : c.before[end]]
            if k + 1 == len(parts):
                return
            ids, k, first = self.join(text, cuts, parts, cuts[k] + (c.ends[end - 1] if end else 0), k)
            yield ids

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes | bytearray] = []
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                out.append(array("I", [SPECIAL_ID]).tobytes())
            if part:
                out.extend(self.encode_part(part))
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, decode: bool = True
) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers in one binary value."""
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    id_type = pa.from_numpy_dtype(np.int64) if source.schema["doc_id"].dataType.simpleString() == "bigint" else pa.string()
    if id_type == pa.string():
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = pa.schema([("doc_id", id_type), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(vocabulary, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            texts = [encoder.decode(x) for x in ids] if decode else [None] * len(ids)
            yield record_batch(schema, doc_id=batch.column(0), ids=[x.astype("<u4").tobytes() for x in ids], decoded=texts)
            ids = texts = None
        del encoder
        release_memory()

    kind = "bigint" if id_type == pa.int64() else "string"
    return source.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(table(spark, sf_dir, "documents")))
