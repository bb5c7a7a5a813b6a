"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; documents are long, so batches are kept small.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Where the setting is absent on a single machine, a temporary folder is made once and used for the
    session. On a cluster that would be a folder of one machine, so there its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='folioscope-')}")
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage durably."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small; a smaller setting of the session stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns under fixed names, so that further columns of the input never clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def row_keys(df: DataFrame, id_col: str, text_col: str, null_first: bool) -> tuple[DataFrame, str]:
    """df and the column that names its rows: the id, or else, where ids repeat or are null, a new key in the order of the ids."""
    n, ids = df.agg(F.count("*"), F.count_distinct(id_col)).first()
    if n == ids:
        return df, id_col
    key = "_row_key"
    while key in df.columns:
        key += "_"
    by = [F.col(id_col).asc_nulls_first() if null_first else F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_first()]
    ranked = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ranked.withColumn(key, F.monotonically_increasing_id()), "row-keys"), key


#: Keys that are broadcast at most, to take their rows out of a table.
BROADCAST_KEYS = 2_000_000


def without(rows: DataFrame, key: str, gone: DataFrame, label: str) -> DataFrame:
    """rows without those whose key is in gone, a table of one column.

    The keys are stored and counted: up to BROADCAST_KEYS they are sent to the rows, which stay where they are.
    """
    gone = stored(gone.toDF("_gone_key"), label)
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return rows.join(gone, rows[key] == gone["_gone_key"], "left_anti").select(*rows.columns)


def crc_mod(col: str, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(col).cast("string")) % n


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def release_memory() -> None:
    """Gives back to the system what a task has freed: its Python worker is used again and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text column in UTF-8, four bits a step, low ones first."""
    step = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        step.append(i)
    digits = f"list_transform(range(1, len(hex(encode({text}))) + 1), lambda k: (strpos('123456789ABCDEF', hex(encode({text}))[CASE WHEN k % 2 = 1 THEN k + 1 ELSE k - 1 END]))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: xor(c >> 4, ({step}::BIGINT[])[(xor(c, b) & 15) + 1])), 4294967295::BIGINT)"
