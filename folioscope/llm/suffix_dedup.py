"""Removal of repeated substrings by deep-shallow suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. Windows of
LENGTH bytes are compared as suffixes cut at that depth:

1.  Each window has an anchor, the leftmost of its GRAM-byte grams with the least hash. Neighbouring
    windows with one anchor form a run, which a covering string holds. Equal windows have equal anchors,
    so only runs with one anchor gram can hold equal windows. Runs are dealt out by their gram. A gram with
    very many different runs (the border of a line or passage that a large part of all documents holds) is
    found beforehand, from a sample; its runs are dealt out by gram and covering string.
2.  Of runs with equal covering strings, all but the first are repeats. Where a gram has one covering
    string alone, nothing is left to do.
3.  The other covering strings are sent, with their bytes, to their gram's bucket, where all of their
    suffixes are sorted: by multikey quicksort to SHALLOW bytes, then by blind tries, which look at one
    branching byte a node and at the common prefix lengths of the group, to LENGTH bytes. In each class of
    suffixes with LENGTH bytes in common all but the first are repeats. A gram with very many covering
    strings isn't left to one bucket here either: its windows are dealt out one by one by their own hash.
4.  Repeats become spans, which are merged and cut from the documents.

The sample decides how runs are dealt out, never what is removed. Steps 1 to 4 run as Spark shuffles over packed arrays. Before a shuffle each task combines what it holds:
equal covering strings, and equal windows of hot grams, are settled there but for the first. Covering strings count as equal by two 64-bit
hashes of their bytes and gram; all other comparisons are byte by byte.

Defined cases: a null text is empty; texts of fewer than LENGTH bytes keep all bytes; null ids come
after all others; rows that share an id are ordered by text, so the later of two equal rows goes; long
texts are read in slices, which changes no result; an empty input gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import id_and_text, record_batch, small_batches, stored, table

LENGTH = 100
GRAM = 32
SHALLOW = 16
#: Segments of fewer suffixes are sorted directly, as quicksorts do.
SMALL = 2048
#: Bytes of a text that are read at once.
SLICE = 1 << 20
#: Bytes of text for each bucket of runs, and covering strings for each bucket of suffixes.
BUCKET_BYTES = 12_000_000
BUCKET_STRINGS = 20_000
#: Runs that a task holds before it passes them on.
HELD_RUNS = 400_000
#: A gram is hot with more covering strings than this, and more than one in HOT_SHARE of all; so there are
#: HOT_SHARE hot grams at most, whatever the input. Before the runs are dealt out, HOT_RUNS takes the place of HOT_STRINGS.
HOT_STRINGS = 80_000
HOT_RUNS = 100_000
HOT_SHARE = 1_000_000
#: Bytes of text and share of all texts that are looked at, at least, for grams with very many runs.
SAMPLE_BYTES = 20_000_000
SAMPLE_SHARE = 0.01

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _splitmix(n: int, seed: int) -> np.ndarray:
    z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _MIX
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE = _splitmix(256, 1)
_OTHER = _splitmix(256, 1001)
_F = 0xD1342543DE82EF95
_F_INVERSE = pow(_F, -1, 1 << 64)


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_F, SLICE + LENGTH + 1)
_DOWN = _powers(_F_INVERSE, SLICE + LENGTH + 1)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes from each position on, by doubling."""
    h, size, out, have = _BYTE[b], 1, None, 0
    while True:
        if gram & size:
            out = h if out is None else out[: len(h) - have] * _power(_F, size) + h[have:] if have else h
            have += size
        if have == gram:
            break
        h = h[:-size] * _power(_F, size) + h[size:]
        size *= 2
    out = out[: len(b) - gram + 1]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def runs(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, windows, gram hash, hash of the covering string) of each run in a slice."""
    grams = gram_hashes(b, gram)
    low = np.uint64((1 << 31) - 1)
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    anchor = (m & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(anchor)]]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OTHER[b] * _UP[: len(b)], dtype=np.uint64)])
    cover = (total[first + count + length - 1] - total[first]) * _DOWN[first]
    return first, count, grams[anchor[first]], cover ^ (cover >> np.uint64(31))


def text_runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """The runs of a whole text, slice by slice; slices overlap by a window less one byte."""
    out = []
    for at in range(0, max(0, len(raw) - length + 1), SLICE):
        first, count, g, c = runs(np.frombuffer(raw, np.uint8)[at : at + SLICE + length - 1], length, gram)
        out.append((first + at, count, g, c))
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for count[0] numbers, then the same for each further entry."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def big_endian_words(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as a number that orders like them."""
    b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    w, size = b, 1
    while size < 8:
        w = (w[:-size] << np.uint64(8 * size)) | w[size:]
        size *= 2
    return w


class Suffixes:
    """Suffixes of a text, cut at a length, and their order."""

    def __init__(self, data: bytes, starts: np.ndarray, length: int = LENGTH):
        self.starts, self.length = starts, length
        self.words = big_endian_words(data + bytes(length))

    def word(self, rows: np.ndarray, at: int | np.ndarray) -> np.ndarray:
        """Bytes 8 * at to 8 * at + 7 of suffixes; bytes from length on are zero."""
        w = self.words[self.starts[rows] + 8 * at]
        over = np.clip(8 * (at + 1) - self.length, 0, 8)
        if np.ndim(over) == 0:
            return w if over == 0 else w >> np.uint64(8 * over) << np.uint64(8 * over)
        shift = np.minimum(8 * over, 63).astype(np.uint64)
        return np.where(over == 0, w, w >> shift << shift)

    def quicksort(self, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, first, end): order by the first bytes, to shallow, and the groups that are equal so far.

        Multikey quicksort: a segment is split three ways by a pivot's word; only the middle part goes on
        to the next word. All segments of a round are split at once.
        """
        n, depth = len(self.starts), -(-min(shallow, self.length) // 8)
        order = np.arange(n)
        low, high, at = np.array([0]), np.array([n]), np.array([0])
        small: list[tuple[np.ndarray, ...]] = []
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        while len(low):
            little = high - low <= SMALL
            small.append((low[little], high[little], at[little]))
            low, high, at = low[~little], high[~little], at[~little]
            if not len(low):
                break
            size = high - low
            place = _ranges(low, size)
            seg = np.repeat(np.arange(len(low)), size)
            key = self.word(order[place], at[seg])
            middle = np.cumsum(size) - size + size // 2
            pivot = key[middle][seg]
            side = (key > pivot).astype(np.int64) * 2 + (key == pivot)
            order[place] = order[place[np.argsort(seg * 3 + side, kind="stable")]]
            parts = np.bincount(seg * 3 + side, minlength=3 * len(low)).reshape(-1, 3)
            cut = np.column_stack([low, low + parts[:, 0], low + parts[:, 0] + parts[:, 1], high])
            done = at + 1 >= depth
            ties.append((cut[done, 1], cut[done, 2]))
            low = np.concatenate([cut[:, 0], cut[:, 2], cut[~done, 1]])
            high = np.concatenate([cut[:, 1], cut[:, 3], cut[~done, 2]])
            at = np.concatenate([at, at, at[~done] + 1])
            some = high - low > 1
            low, high, at = low[some], high[some], at[some]
        low, high, at = (np.concatenate(x) for x in zip(*small, strict=True))
        # Small segments are sorted directly, by the words that are left.
        size = high - low
        place, seg = _ranges(low, size), np.repeat(np.arange(len(low)), size)
        rows = order[place]
        keys = [np.where(at[seg] <= k, self.word(rows, k), np.uint64(0)) for k in range(depth)]
        by = np.lexsort([*keys[::-1], seg])
        order[place] = rows[by]
        if len(place):
            change = seg[by][1:] != seg[by][:-1]
            for k in keys:
                change |= k[by][1:] != k[by][:-1]
            edge = np.concatenate([[0], np.flatnonzero(change) + 1, [len(place)]])
            ties.append((place[edge[:-1]], place[edge[1:] - 1] + 1))
        first, end = (np.concatenate(x) for x in zip(*ties, strict=True))
        long = end - first > 1
        return order, first[long], end[long]

    def tries(self, order: np.ndarray, first: np.ndarray, end: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Orders the groups by blind tries, in place; gives the groups that are equal to the full length.

        Every group's trie grows a level at a time, all groups at once. A node's depth is the least
        prefix that a member shares with the first one; members go on by the byte at that depth. The bytes
        skipped are the same for all members, so no node looks at them again.
        """
        words = -(-self.length // 8)
        whole: list[tuple[np.ndarray, np.ndarray]] = []
        while len(first):
            size = end - first
            place, seg = _ranges(first, size), np.repeat(np.arange(len(first)), size)
            rows = order[place]
            lead = order[first][seg]
            share = np.full(len(rows), self.length, np.int64)
            open_ = np.arange(len(rows))
            for k in range(known // 8, words):
                diff = self.word(rows[open_], k) ^ self.word(lead[open_], k)
                odd = diff != 0
                if odd.any():
                    share[open_[odd]] = self._first_byte(diff[odd]) + 8 * k
                    open_ = open_[~odd]
                if not len(open_):
                    break
            depth = np.minimum.reduceat(share, np.cumsum(size) - size)
            equal = depth >= self.length
            whole.append((first[equal], end[equal]))
            live = ~equal[seg]
            place, seg, rows = place[live], seg[live], rows[live]
            if not len(place):
                break
            d = depth[seg]
            branch = (self.words[self.starts[rows] + d] >> np.uint64(56)).astype(np.int64)
            by = np.argsort(seg * 256 + branch, kind="stable")
            order[place] = rows[by]
            node = (seg * 256 + branch)[by]
            edge = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            first, end = place[edge[:-1]], place[edge[1:] - 1] + 1
            long = end - first > 1
            first, end = first[long], end[long]
        if not whole:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x for x, _ in whole]), np.concatenate([x for _, x in whole])

    @staticmethod
    def _first_byte(diff: np.ndarray) -> np.ndarray:
        """The place of the first byte that isn't zero."""
        out = np.zeros(len(diff), np.int64)
        for shift in (32, 16, 8):
            top = diff >> np.uint64(64 - shift)
            none = top == 0
            out += np.where(none, shift // 8, 0)
            diff = np.where(none, diff << np.uint64(shift), diff)
        return out

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, first, end): the suffixes in order, and the groups that agree in the full length."""
        order, first, end = self.quicksort(SHALLOW)
        if self.length <= SHALLOW:
            return order, first, end
        first, end = self.tries(order, first, end, SHALLOW)
        return order, first, end


PACKED = pa.schema([("bucket", pa.int32()), ("gram", pa.binary()), ("cover", pa.binary()), ("key", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])


def _is_hot(g: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which grams are among the hot ones, which are in order."""
    if not len(hot):
        return np.zeros(len(g), bool)
    return hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g


def hot_grams(texts: DataFrame, total: int, length: int, gram: int) -> np.ndarray:
    """Grams with very many different runs, in order: more than HOT_RUNS, and more than one in HOT_SHARE, as a sample tells."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(total, 1)))
    sample = texts.filter(F.pmod(F.xxhash64("key", F.lit("grams")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else texts

    def listed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        g, c = (np.concatenate([r[x] for r in held]) for x in (2, 3))
        by = np.lexsort([c, g])
        g, c = g[by], c[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        found, n = np.unique(g[new], return_counts=True)
        # A gram with very many runs has several in any part of the texts.
        return record_batch(GRAMS, gram=found[n > 1].view(np.int64), n=n[n > 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for r in text_runs(text.encode(), length, gram):
                    held.append(r)
                    size += len(r[0])
                    if size >= HELD_RUNS:
                        yield listed(held)
                        held, size = [], 0
        if held:
            yield listed(held)

    counts = sample.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # Runs are as long as half a window less the gram, on average.
    runs_ = total // ((length - gram) // 2 + 1)
    least = max(1, int(share * max(HOT_RUNS, runs_ // HOT_SHARE)))
    found = counts.filter(F.col("n") > least).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(found.view(np.uint64))


def _deal_runs(buckets: int, length: int, gram: int, shared):
    """Packs the runs of a task's texts by bucket of their gram; those of hot grams by gram and covering string."""

    def packed(held: list[tuple[int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
        key = np.concatenate([np.full(len(r[0]), k, np.int64) for k, r in held])
        at, n, g, c = (np.concatenate([r[x] for _, r in held]) for x in range(4))
        # Of equal covering strings in this task, the later ones are repeats already: they travel in buckets
        # of their own, below zero, so that no gram's bucket gathers them.
        by = np.lexsort([at, key, n, c, g])
        late = np.empty(len(g), bool)
        late[by] = np.concatenate([[False], (g[by][1:] == g[by][:-1]) & (c[by][1:] == c[by][:-1]) & (n[by][1:] == n[by][:-1])])
        at_hand = np.where(_is_hot(g, shared.value), (g ^ c) * _MIX >> np.uint64(20), g)
        to = np.where(late, -1 - key % buckets, (at_hand % np.uint64(buckets)).astype(np.int64))
        by = np.argsort(to, kind="stable")
        some, cut = np.unique(to[by], return_index=True)
        cut = [*cut.tolist(), len(by)]
        cols = {"gram": g[by], "cover": c[by], "key": key[by], "at": at[by].astype(np.int64), "n": n[by].astype(np.int32)}
        return record_batch(PACKED, bucket=some, **{x: [v[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for x, v in cols.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in text_runs((text or "").encode(), length, gram):
                    held.append((key, r))
                    size += len(r[0])
                    if size >= HELD_RUNS:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    return run


def _unpacked(group: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
RUN = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("gram", pa.int64()), ("repeat", pa.bool_())])


def _sift_runs(shared):
    """Runs that repeat a covering string, and the first runs of grams with several covering strings, as all hot ones have."""

    def run(group: pa.Table) -> pa.Table:
        return _sifted(group, shared.value)

    return run


def _sifted(group: pa.Table, hot: np.ndarray) -> pa.Table:
    g, c = _unpacked(group, "gram", np.uint64), _unpacked(group, "cover", np.uint64)
    key, at, n = _unpacked(group, "key", np.int64), _unpacked(group, "at", np.int64), _unpacked(group, "n", np.int32)
    if group.column("bucket")[0].as_py() < 0:
        return pa.table({"key": key, "at": at, "n": n, "gram": g.view(np.int64), "repeat": np.ones(len(g), bool)}, schema=RUN)
    by = np.lexsort([at, key, n, c, g])
    g, c, key, at, n = g[by], c[by], key[by], at[by], n[by]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    lead = new_gram | np.concatenate([[True], (c[1:] != c[:-1]) | (n[1:] != n[:-1])])
    several = np.add.reduceat(lead.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1] > 1
    several |= _is_hot(g, hot)
    out = np.flatnonzero(~lead | several)
    return pa.table({"key": key[out], "at": at[out], "n": n[out], "gram": g[out].view(np.int64), "repeat": ~lead[out]}, schema=RUN)


STRINGS = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("data", pa.binary())])


def _deal_strings(buckets: int, length: int):
    """Packs the covering strings of a task's documents by bucket of their gram, and windows of hot grams by their hash."""

    def packed(held: dict[int, list[tuple[int, int, int, bytes]]], windows: dict[bytes, tuple[int, int]]) -> pa.RecordBatch:
        for w, (key, at) in windows.items():
            held.setdefault(buckets + zlib.crc32(w) % buckets, []).append((key, at, 1, w))
        cols = {k: [] for k in ("key", "at", "n", "data")}
        for rows in held.values():
            cols["key"].append(np.array([r[0] for r in rows], np.int64).tobytes())
            cols["at"].append(np.array([r[1] for r in rows], np.int64).tobytes())
            cols["n"].append(np.array([r[2] for r in rows], np.int32).tobytes())
            cols["data"].append(b"".join(r[3] for r in rows))
        return record_batch(STRINGS, bucket=list(held), **cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, int, bytes]]] = {}
        windows: dict[bytes, tuple[int, int]] = {}
        size = 0
        for batch in batches:
            for key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for r in found:
                    string = raw[r["at"] : r["at"] + r["n"] + length - 1]
                    if not r["hot"]:
                        held.setdefault(r["gram"] % buckets, []).append((key, r["at"], r["n"], string))
                        size += len(string)
                        continue
                    for i in range(r["n"]):
                        w, place = string[i : i + length], (key, r["at"] + i)
                        first = windows.setdefault(w, place)
                        if first != place:  # the later of two equal windows is a repeat
                            windows[w], late = min(first, place), max(first, place)
                            held.setdefault(-1 - late[0] % buckets, []).append((*late, 1, b""))
                        size += length
                if size > 8_000_000:
                    yield packed(held, windows)
                    held, windows, size = {}, {}, 0
        if held or windows:
            yield packed(held, windows)

    return run


SPAN = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _sort_strings(length: int):
    """Sorts all windows of a bucket's covering strings and gives the spans of those that start earlier elsewhere."""

    def run(group: pa.Table) -> pa.Table:
        key, at, n = _unpacked(group, "key", np.int64), _unpacked(group, "at", np.int64), _unpacked(group, "n", np.int32).astype(np.int64)
        if group.column("bucket")[0].as_py() < 0:
            return pa.table({"key": key, "start": at, "end": at + n + length - 1}, schema=SPAN)
        sizes = n + length - 1
        starts = _ranges(np.cumsum(sizes) - sizes, n)
        owner = np.repeat(np.arange(len(n)), n)
        place = _ranges(at, n)
        order, first, end = Suffixes(b"".join(group.column("data").to_pylist()), starts, length).classes()
        if not len(first):
            return SPAN.empty_table()
        size = end - first
        rows, cls = order[_ranges(first, size)], np.repeat(np.arange(len(first)), size)
        by = np.lexsort([place[rows], key[owner[rows]], cls])
        rows, cls = rows[by], cls[by]
        late = rows[np.concatenate([[False], cls[1:] == cls[:-1]])]
        k, p = key[owner[late]], place[late]
        by = np.lexsort([p, k])
        k, p = k[by], p[by]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] - p[:-1] > length)]) if len(k) else np.empty(0, bool)
        edge = np.flatnonzero(new)
        last = np.concatenate([edge[1:] - 1, [len(k) - 1]]) if len(k) else edge
        return pa.table({"key": k[edge], "start": p[edge], "end": p[last] + length}, schema=SPAN)

    return run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(key, doc_id, text) with a key of its own for each row that orders like the ids, null last; whether the id is the key."""
    source = id_and_text(docs, id_col, text_col)
    plain = source.schema["doc_id"].dataType.simpleString() == "bigint"
    n, ids = source.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if plain and n == ids:
        return source.select(F.col("doc_id").alias("key"), "doc_id", "text"), True
    by = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranked = source.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ranked.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "suffix-rows"), False


def repeat_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, start, end): byte spans of repeats in rows of key, text; spans of one key may overlap."""
    spark = rows.sparkSession
    small_batches(spark)
    texts = rows.select("key", "text").filter(F.octet_length("text") >= length)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(total // BUCKET_BYTES) + 1
    shared = spark.sparkContext.broadcast(hot_grams(texts, total, length, gram))
    packed = texts.mapInArrow(_deal_runs(buckets, length, gram, shared), "bucket int, gram binary, cover binary, key binary, at binary, n binary")
    sifted = packed.groupBy("bucket").applyInArrow(_sift_runs(shared), "key bigint, at bigint, n int, gram bigint, repeat boolean")
    found = stored(sifted, "suffix-runs")

    firsts = found.filter("NOT repeat")
    n = firsts.count()
    buckets = n // BUCKET_STRINGS + 1
    hot = firsts.groupBy("gram").count().filter(F.col("count") > max(HOT_STRINGS, n // HOT_SHARE)).select("gram", F.lit(True).alias("hot"))
    marked = firsts.join(F.broadcast(hot), "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    lists = marked.groupBy("key").agg(F.collect_list(F.struct("at", "n", "gram", "hot")).alias("found"))
    strings = texts.join(lists, "key").select("key", "text", "found")
    dealt = strings.mapInArrow(_deal_strings(buckets, length), "bucket int, key binary, at binary, n binary, data binary")
    sorted_ = dealt.groupBy("bucket").applyInArrow(_sort_strings(length), "key bigint, start bigint, end bigint")
    whole = found.filter("repeat").select("key", F.col("at").alias("start"), (F.col("at") + F.col("n") + F.lit(length - 1)).alias("end"))
    return whole.unionByName(sorted_)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode()
            kept, at, removed, n = [], 0, 0, 0
            last = -1
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if s[0] > last:
                    n += 1
                begin, last = max(s[0], last), max(s[1], last)
                if last > begin:
                    kept.append(raw[at:begin])
                    removed += last - begin
                    at = last
            kept.append(raw[at:])
            for name, x in zip(out, (key, len(raw), removed, n, b"".join(kept)), strict=True):
                out[name].append(x)
        yield record_batch(schema, **out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; kept holds the bytes that stay."""
    rows, plain = keyed(docs, id_col, text_col)
    lists = repeat_spans(rows, length, gram).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.select("key", "text").join(lists, "key", "left").select("key", "text", "spans")
    cut = joined.mapInArrow(_cut, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    if plain:
        return cut.withColumnRenamed("key", "doc_id")
    return cut.join(rows.select("key", "doc_id"), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
