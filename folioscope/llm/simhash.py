"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over hashed word shingles. To find all pairs within RADIUS bits,
every bit position is given a random vector of RADIUS + 1 bits; for each of the 2**(RADIUS + 1) - 1
non-zero vectors v, a table keeps the bits whose vector has an odd product with v. Any set of RADIUS
positions is left out whole by at least one table, so every pair within the radius shares a key in
some table. Nothing is missed, and no number of candidates is capped.

Rows are first reduced to distinct fingerprints. A bucket that holds many of them is split by a second
covering of the bits that its table leaves out, which keeps the guarantee. In a bucket, links are
found by a search outwards from each fingerprint, which yields a spanning forest of the bucket's
links, not its pairs. Components follow by alternating star contractions on tables of the shared folder.

Defined cases: null or empty texts, and texts of white space, have fingerprint zero and link like any
other; fewer words than a shingle give one shingle of all words; copies share a component; a null id
never names a component unless all its ids are null; a long text is hashed whole, and half of its bits is not
more than half: ties give 0; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import id_and_text, record_batch, row_keys, small_batches, stored, table, without

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints in a bucket from which it is split by a second covering.
SPLIT = 20_000


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if more than half of the shingles' hashes, repeats included, have it."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return digest(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    begin = np.concatenate([[0], ends[:-1]])[: len(found) - shingle + 1].tolist()
    end = (ends[shingle - 1 :] - 1).tolist()
    h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(begin, end, strict=True)), np.uint64, len(begin))
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 8192):
        count += np.unpackbits(h[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    source = id_and_text(docs, id_col, text_col)
    number = source.schema["doc_id"].dataType.simpleString() == "bigint"
    if not number:
        source = source.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = pa.schema([("doc_id", pa.int64() if number else pa.string()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield record_batch(schema, doc_id=batch.column(0), fp=np.array(made, np.uint64).astype(np.int64))

    return source.mapInArrow(run, f"doc_id {'bigint' if number else 'string'}, fp bigint")


def covering_masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """Masks over the given bit positions: any radius of them are outside at least one mask."""
    vectors = np.random.default_rng(seed).integers(0, 2 ** (radius + 1), len(bits))
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        masks.append(sum(1 << b for b, x in zip(bits, vectors.tolist(), strict=True) if bin(x & v).count("1") % 2))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(fp, masks: list[int]):
    """An array of structs (table, key), one for each mask."""
    return F.array(*[F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])


def bucket_forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, by searches outwards.

    Each fingerprint is compared once with those not yet reached, so a bucket of close copies costs
    about its size, and each found link is an edge to something new.
    """
    left = np.arange(len(fps))
    values = fps.view(np.uint64)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left) > 1:
        ready, left = [int(left[0])], left[1:]
        while ready and len(left):
            at = ready.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            if near.any():
                new = left[near]
                a.append(np.full(len(new), fps[at]))
                b.append(fps[new])
                ready.extend(new.tolist())
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT, seed: int = 1) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that join all that are within the radius."""
    masks = covering_masks(list(range(BITS)), radius, seed)
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("fp", "k.t", "k.key")
    crowded = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("t", "key")
    crowded = stored(crowded, "simhash-crowded")
    shared = keyed.join(crowded, ["t", "key"], "left_anti")

    # In table t two close fingerprints differ in bits outside its mask only: a covering of those splits the bucket.
    inner = []
    for t, m in enumerate(masks):
        outside = [i for i in range(BITS) if not m >> i & 1]
        inner.append(_keys(F.col("fp"), covering_masks(outside, radius, seed + 1 + t)))
    subkeys = F.element_at(F.array(*inner), F.col("t") + 1)
    finer = keyed.join(crowded, ["t", "key"]).select("fp", "t", "key", F.explode(subkeys).alias("s"))
    parts = shared.select("fp", "t", "key", F.lit(-1).alias("u"), F.lit(0).cast("bigint").alias("sub")).unionByName(
        finer.select("fp", "t", "key", F.col("s.t").alias("u"), F.col("s.key").alias("sub"))
    )

    # Buckets lie together in sorted partitions and are read as they pass, many small ones at a time.
    dealt = parts.repartition("t", "key", "u", "sub").sortWithinPartitions("t", "key", "u", "sub", "fp")
    found = dealt.select("t", "key", "u", "sub", "fp").mapInArrow(_forests(radius), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forests(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        """Forests of whole buckets, which stand in order."""
        fp = cols[4]
        edge = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0), [True]]))
        first, size = edge[:-1], np.diff(edge)
        two = first[size == 2]
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
        a, b = [fp[two[near]]], [fp[two[near] + 1]]
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            x, y = bucket_forest(fp[i : i + n], radius)
            a.append(x)
            b.append(y)
        return record_batch(schema, a=np.concatenate(a), b=np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[4]):
                continue
            # The last bucket may go on in the next batch.
            same = np.all([c == c[-1] for c in cols[:4]], axis=0)
            whole = len(same) - int(same.sum())
            if whole:
                yield linked([c[:whole] for c in cols])
            rest = [c[whole:] for c in cols]
        if rest is not None and len(rest[4]):
            yield linked(rest)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component with a link, by large-star and small-star rounds."""
    now = stored(edges.select("a", "b").filter("a <> b"), "stars")
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours hang on the smallest one; small star: the node and its smaller ones do.
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        down = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.col("m").alias("a"), F.col("y").alias("b"))
        small = small.unionByName(least.select(F.col("m").alias("a"), F.col("x").alias("b"))).filter("a <> b").distinct()
        after = stored(small, "stars")
        # The stars stand when no root is itself a member and every member has one root.
        roots = after.select("a").distinct()
        moving = after.join(roots.withColumnRenamed("a", "b"), "b", "left_semi").limit(1).count()
        double = after.groupBy("b").count().filter("count > 1").limit(1).count()
        now = after
        if not moving and not double:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    marks = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-list")
    found = components(links(distinct.select("fp"), radius))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of a component other than that with its smallest id.

    Rows go each by itself, also where ids repeat: of rows that repeat the smallest id of a component one
    stays. Rows without an id stay.
    """
    rows, key = row_keys(docs, id_col, text_col, null_first=False)
    gone = near_groups(rows, key, text_col).filter(F.col("doc_id") != F.col("component_id"))
    if key != id_col:
        last = rows.filter(F.col(id_col).isNotNull()).agg(F.max(key)).first()[0]
        gone = gone.filter(F.col("doc_id") <= F.lit(last).cast("bigint"))
    return without(rows, key, gone.select("doc_id"), "near-gone").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
