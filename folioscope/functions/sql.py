"""The library's functions for SQL users: temporary SQL functions, a table function and views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from folioscope.functions import scores
from folioscope.operators.structure import html_rows, markdown_rows

#: Each is inlined by Catalyst, so it costs what its expression costs.
SQL_FUNCTIONS = {
    "content_hash(t STRING) RETURNS STRING": "concat('passage-', md5(t))",
    "surface_idf(n BIGINT, df BIGINT) RETURNS DOUBLE": "ln((n + 1) / (df + 0.5))",
    "reciprocal_rank(r BIGINT) RETURNS DOUBLE": f"1.0D / ({scores.RRF_K} + r)",
    "page_number_of(p STRING) RETURNS INT": "try_cast(regexp_extract(p, '^p_([0-9]+)$', 1) AS INT)",
    "one_line(t STRING) RETURNS STRING": r"trim(regexp_replace(t, '[\\t\\r\\n]+', ' '))",
    "dot_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)",
}


@udtf(returnType="table_no int, row_no int, text string, is_header boolean")
class TableRows:
    """Rows of an HTML or pipe table: SELECT * FROM table_rows(blob)."""

    def eval(self, blob: str | None) -> Iterator[tuple]:
        blob = blob or ""
        found = html_rows(blob) if "<tr" in blob.lower() else markdown_rows(blob) if "|" in blob else []
        t, r = 0, 0
        for i, (text, head) in enumerate(found):
            t, r = (t + 1, 1) if head or i == 0 else (t, r + 1)
            yield t, r, text, head


@pandas_udf(DoubleType())
def log_sum_exp(x: pd.Series) -> float:
    """Aggregate: ln of the sum of exp, without overflow; null where there is no value.

    It merges with itself, so a hot group is dealt over salts and the parts are aggregated again: see MERGED.
    """
    x = x.dropna().to_numpy()
    if not len(x):
        return None
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum())) if np.isfinite(top) else float(top)


#: An aggregate of parts: no task holds more than a share of a group, whatever its size.
MERGED = """SELECT {key}, {name}(part) AS {name} FROM (
  SELECT {key}, {name}({value}) AS part FROM {table} GROUP BY {key}, pmod(xxhash64({salt}), {parts})) GROUP BY {key}"""


@udtf
class GapSessions:
    """Rows with the number of their session, which ends where ts rises by gap seconds or more.

    SELECT * FROM gap_sessions(TABLE(SELECT user_id, ts, ... FROM t), 'user_id', 'ts', gap). The first two names are those of the key and of
    the time; rows of a key come in order of time, with one time as the only state. A null time is in the session of
    number 0, a null key is a key. The result has the table's columns and session_no.
    """

    def __init__(self) -> None:
        self.last, self.number = None, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("gap_sessions: the first argument has to be a table")
        names = rows.dataType.fieldNames()
        for name in (key.value, at.value):
            if name not in names:
                raise ValueError(f"gap_sessions: no column {name} among {', '.join(names)}")
        if "session_no" in names:
            raise ValueError("gap_sessions: the table has a column session_no")
        schema = StructType(rows.dataType.fields[:]).add("session_no", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{key.value}`")], orderBy=[OrderingColumn(f"`{at.value}`")])

    def eval(self, row: Row, key: str, at: str, gap: float) -> Iterator[tuple]:
        ts = row[at]
        if ts is not None:
            if self.last is None or (ts - self.last).total_seconds() >= gap:
                self.number += 1
            self.last = ts
        yield (*row, self.number)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("table_rows", TableRows)
    spark.udtf.register("gap_sessions", GapSessions)
    spark.udf.register("log_sum_exp", log_sum_exp)


def views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views of the tables below a path."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
