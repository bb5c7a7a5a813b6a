"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents within one task. Its words become numbers of the benchmark's vocabulary;
words outside it can be in no window, so runs of words that are all in the vocabulary, and long enough
for the shortest window, are all that is indexed. Each run ends in a separator of its own. The index is
the Burrows-Wheeler transform of that sequence in a wavelet matrix with rank directories, and sampled
suffix positions. All windows are searched backwards at once, and the rows found are traced to a
sampled position. Every place found is compared with the window word for word, and the covered words
are merged to spans.

Benchmark windows are sent to the tasks in blocks of at most BLOCK_BYTES of benchmark text; further
blocks are further passes over the documents, one after the other, whose results are added up row by row:
each row has a key of its own for that, so rows that share an id, or have none, are answered each by itself.

Defined cases: null and empty texts have no words and no hits; items without words have no windows;
items of one id count once; a window that several items hold counts for each of them; repeated rows, and rows
that share an id, are answered each by itself; a text longer than a shard is a shard of its own and searched whole; an
empty benchmark marks nothing; empty documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import id_and_text, record_batch, small_batches, stored, table

WINDOW = 10
#: Words of one shard, and distance of sampled suffix positions.
SHARD_WORDS = 1_500_000
SAMPLE = 16
#: Benchmark text that is sent to the tasks at once.
BLOCK_BYTES = 16_000_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words in UTF-8: runs of ASCII letters, digits and all non-ASCII characters."""
    return WORD.findall((text or "").encode().lower())


class Windows:
    """The windows of a block of benchmark items, by vocabulary number."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(ids[i : i + size], set()).add(item)
        self.keys = sorted(found)
        self.items = [sorted(found[k]) for k in self.keys]
        self.sizes = np.array([len(k) for k in self.keys], np.int64)
        self.longest = int(self.sizes.max()) if self.keys else 0
        self.shortest = int(self.sizes.min()) if self.keys else 0
        self.table = np.zeros((len(self.keys), self.longest), np.int64)
        for row, key in enumerate(self.keys):
            self.table[row, : len(key)] = key


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; entries of seq that are 0 are separators, each unlike any other."""
    n = len(seq)
    stops = seq == 0
    rank = np.where(stops, np.cumsum(stops) - 1, seq + stops.sum()).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.empty(n, np.int64)
        if step == 1:
            second = None
            change = key[1:] != key[:-1]
        else:
            change = (key[1:] != key[:-1]) | (second[order][1:] != second[order][:-1])
        new[order] = np.concatenate([[0], np.cumsum(change)])
        if new[order[-1]] == n - 1:
            return order
        rank = new
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a binary digit, each with the count of ones before each place."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.planes: list[tuple[np.ndarray, int]] = []
        self.bits = bits
        now = seq
        for k in range(bits - 1, -1, -1):
            ones = (now >> k) & 1
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.planes.append((before, len(now) - int(before[-1])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros(len(at), np.int64)
        high = at.astype(np.int64)
        for k, (before, zeros) in zip(range(self.bits - 1, -1, -1), self.planes, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            a, b = before[low], before[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        """seq: numbers from 1 to symbols - 1, with 0 as separator; it begins and ends with a separator."""
        order = suffix_array(seq)
        self.last = seq[order - 1]  # the separator at the front closes the circle
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.matrix = WaveletMatrix(self.last, max(1, int(symbols - 1).bit_length()))
        # A row is sampled at every SAMPLE-th position and wherever a run begins: no trace crosses a separator.
        sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled = sampled
        self.positions = order[sampled]
        self.size = len(seq)

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each pattern, by backward search from its last symbol."""
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((sizes >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, sizes[live] - back]
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back through the text until a sampled row."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            symbol = self.last[at[live]]
            at[live] = self.first[symbol] + self.matrix.rank(symbol, at[live])
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.positions[self.sampled_before[at]] + steps


def shard_hits(numbers: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) of every occurrence of a window in a shard's documents."""
    none = np.empty(0, np.int64)
    sizes = np.array([len(x) for x in numbers], np.int64)
    flat = np.concatenate([np.concatenate([x, [0]]) for x in numbers]).astype(np.int64) if len(numbers) else none
    if not windows.keys or not len(flat):
        return none, none, none
    known = np.concatenate([[False], flat > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= windows.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none, none
    # Runs, each followed by a separator, after one separator at the front.
    length = end - begin + 1
    starts = np.cumsum(length) - length + 1
    seq = np.zeros(int(length.sum()) + 1, np.int64)
    place = np.arange(len(seq) - 1) - np.repeat(starts - 1, length)
    source = np.repeat(begin, length) + place
    inside = place < np.repeat(length - 1, length)
    seq[1:][inside] = flat[source[inside]]

    index = FMIndex(seq, len(windows.vocabulary) + 1)
    low, high = index.search(windows.table, windows.sizes)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if not len(rows):
        return none, none, none
    at = index.locate(rows)
    first = source[at - 1]
    for k in range(windows.longest):  # the word-for-word check
        need = windows.sizes[which] > k
        same = ~need
        same[need] = flat[first[need] + k] == windows.table[which[need], k]
        first, which = first[same], which[same]
    document = np.searchsorted(np.cumsum(sizes + 1), first, side="right")
    return document, first - (np.cumsum(sizes + 1) - sizes - 1)[document], which


def hit_documents(numbers: list[np.ndarray], windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, its windows, which of its words are hit) for the shard's documents with hits."""
    document, first, which = shard_hits(numbers, windows)
    order = np.argsort(document, kind="stable")
    cut = np.searchsorted(document[order], np.arange(len(numbers) + 1))
    for d in np.unique(document).tolist():
        own = order[cut[d] : cut[d + 1]]
        change = np.zeros(len(numbers[d]) + 1, np.int64)
        np.add.at(change, first[own], 1)
        np.add.at(change, first[own] + windows.sizes[which[own]], -1)
        yield d, np.unique(which[own]), np.cumsum(change[:-1]) > 0


def word_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of hit words: numbers of the first word and the one after the last, and the bytes they cover."""
    ends = [m.span() for m in WORD.finditer(text.encode().lower())]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
    return [{"first": i, "after": j, "start": ends[i][0], "end": ends[j - 1][1]} for i, j in zip(edges[::2], edges[1::2], strict=True)]


SPAN = pa.struct([("first", pa.int64()), ("after", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = "array<struct<first:bigint,after:bigint,start:bigint,end:bigint>>"


def _searcher(windows: Windows, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(SPAN))])

    def shard(ids: list, texts: list, numbers: list[np.ndarray]) -> pa.RecordBatch:
        items, spans = [[] for _ in ids], [[] for _ in ids]
        for d, found, hit in hit_documents(numbers, windows):
            items[d] = sorted({x for w in found.tolist() for x in windows.items[w]})
            spans[d] = word_spans(texts[d], hit)
        return record_batch(schema, doc_id=ids, n_words=[len(x) for x in numbers], items=items, spans=spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = windows.vocabulary.get
        ids: list = []
        texts: list = []
        numbers: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                ids.append(key)
                texts.append(text)
                numbers.append(np.fromiter((number(w, 0) for w in found), np.int32, len(found)))
                held += len(found) + 1
                if held >= SHARD_WORDS:
                    yield shard(ids, texts, numbers)
                    ids, texts, numbers, held = [], [], [], 0
        if ids:
            yield shard(ids, texts, numbers)

    return run


Block = list[tuple[str, str | None]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks, asked first, and benchmark items in blocks of bounded size, each read when it is due."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(F.col("item").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // block_bytes) + 1

    def read() -> Iterator[Block]:
        for k in range(parts):
            block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
            yield [(r["item"], r["text"]) for r in block.toLocalIterator()]

    return parts, read()


def _union(acc, span):
    """Appends a span to spans in order, or widens the last one where they touch."""
    last = F.element_at(acc, -1)
    wider = F.struct(
        last["first"].alias("first"), F.greatest(last["after"], span["after"]).alias("after"), last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
    )
    return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["after"] >= span["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(
        F.concat(acc, F.array(span))
    )


FOUND = f"n_words bigint, items array<string>, spans {SPANS}"


def _rows_found(rows: DataFrame, blocks: Iterator[Block], window: int) -> DataFrame:
    """(row, n_words, items, spans) of every row (row, text), row being a key.

    A block's pass is run and written before the next block is read, so one block of windows is held at a time.
    """
    parts: list[DataFrame] = []

    def search(items: Block) -> None:
        part = rows.mapInArrow(_searcher(Windows(items, window), pa.int64()), f"doc_id bigint, {FOUND}")
        # The first pass tells the words of all rows; further ones have to tell hits only.
        parts.append(stored(part.filter(F.size("spans") > 0) if parts else part, "benchmark-hits"))

    for items in blocks:
        search(items)
        del items
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast(SPANS), _union).alias("spans"),
    )


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, items (ids sorted as strings) and merged spans.

    A span has the numbers of its first word and of the word after its last, and its UTF-8 bytes.
    """
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    number = source.schema["doc_id"].dataType.simpleString() == "bigint"
    if not number:
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    parts, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if parts == 1:
        windows = Windows(next(blocks), window)
        found = source.mapInArrow(_searcher(windows, pa.int64() if number else pa.string()), f"doc_id {'bigint' if number else 'string'}, {FOUND}")
    else:
        keyed = stored(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "benchmark-rows")
        found = keyed.select("row", "doc_id").join(_rows_found(keyed.select("row", "text"), blocks, window), "row")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["after"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def _cutter(windows: Windows, column: int):
    """Cuts the spans from a column's texts and passes all other columns on."""

    def cut(text: str, hit: np.ndarray) -> str:
        raw, at, kept = text.encode(), 0, []
        for s in word_spans(text, hit):
            kept.append(raw[at : s["start"]])
            at = s["end"]
        return b"".join([*kept, raw[at:]]).decode()

    def shard(held: list[pa.RecordBatch], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hits = {d: hit for d, _, hit in hit_documents(numbers, windows)}
        at = 0
        for batch in held:
            own = {d - at: hits[d] for d in range(at, at + batch.num_rows) if d in hits}
            at += batch.num_rows
            if own:
                texts = batch.column(column).to_pylist()
                for row, hit in own.items():
                    texts[row] = cut(texts[row], hit)
                columns = list(batch.columns)
                columns[column] = pa.array(texts, batch.schema.field(column).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = windows.vocabulary.get
        held: list[pa.RecordBatch] = []
        numbers: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(column).to_pylist():
                found = words(text)
                numbers.append(np.fromiter((number(w, 0) for w in found), np.int32, len(found)))
                size += len(found) + 1
            held.append(batch)
            if size >= SHARD_WORDS:
                yield from shard(held, numbers)
                held, numbers, size = [], [], 0
        if held:
            yield from shard(held, numbers)

    return run


def cut_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the merged spans cut from the texts; rows without hits and all other columns stay as they are.

    With one block of benchmark text, texts are cut where they are, without a join. With more, each row gets
    a key, the spans of all blocks are united and joined to the rows by that key.
    """
    small_batches(docs.sparkSession)
    parts, blocks = _blocks(benchmark, "item_id", "text", block_bytes)
    if parts == 1:
        return docs.mapInArrow(_cutter(Windows(next(blocks)), docs.columns.index(text_col)), docs.schema)
    key, spans = "_cut_row", "_cut_spans"
    while key in docs.columns or spans in docs.columns:
        key, spans = key + "_", spans + "_"
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "benchmark-rows")
    found = _rows_found(keyed.select(F.col(key).alias("row"), F.col(text_col).alias("text")), blocks, WINDOW).filter(F.size("spans") > 0)
    joined = keyed.join(found.select(F.col("row").alias(key), F.col("spans").alias(spans)), key, "left")
    raw = F.encode(F.col(text_col), "UTF-8")
    # What stays: from the end of each span, or the text's front, to the start of the next, or the text's end.
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(raw).cast("bigint")))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    kept = F.transform(
        F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda s: F.decode(F.substring(raw, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")), "UTF-8")
    )
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return joined.withColumn(text_col, text).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bp AS (
  SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS k FROM bp),
sizes AS (SELECT DISTINCT m FROM win),
dp AS (
  SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS p FROM dw, sizes),
hit AS (
  SELECT doc_id, item, p, dp.m FROM (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS k FROM dp) dp
  JOIN win ON win.m = dp.m AND win.k = dp.k),
n_hit AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN n_hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
