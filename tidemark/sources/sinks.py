"""Result sinks: pipe-delimited text, parquet and SQLite.

Pipe text ends every field, the last one too, with ``|``. Integers are decimal, floats
the shortest decimal that reads back, without exponent and with a fraction, strings
verbatim. Formatting runs on the executors, in Arrow batches for the float columns.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_text(x: float) -> str:
    if not np.isfinite(x):
        return "NaN.0" if np.isnan(x) else "inf.0" if x > 0 else "-inf.0"
    return np.format_float_positional(x, unique=True, trim="0")


@F.pandas_udf(T.StringType())
def _doubles(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else float_text(np.float64(x)))


@F.pandas_udf(T.StringType())
def _floats(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else float_text(np.float32(x)))


def _shown(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.DoubleType):
        nan = F.when(F.isnan(c), F.lit("NaN.0"))
        return F.coalesce(nan, _doubles(c), F.lit(""))
    if isinstance(kind, T.FloatType):
        nan = F.when(F.isnan(c), F.lit("NaN.0"))
        return F.coalesce(nan, _floats(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def pipe_text(df: DataFrame) -> DataFrame:
    """One column ``line``; the order of ``df`` is kept. Null is an empty field."""
    flat = df.toDF(*[f"f{i}" for i in range(len(df.columns))])
    parts = [p for f in flat.schema.fields for p in (_shown(f.name, f.dataType), F.lit("|"))]
    return flat.select(F.concat(*parts).alias("line"))


def pipe_lines(df: DataFrame, framed: bool = False) -> Iterator[str]:
    """The lines, one partition at a time; framed: between ``validate`` and ``!``."""
    if framed:
        yield "validate"
    for row in pipe_text(df).toLocalIterator(prefetchPartitions=True):
        yield row["line"]
    if framed:
        yield "!"


def write_pipe(df: DataFrame, path: str) -> None:
    pipe_text(df).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small file, in any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(body.encode("utf-8")))
    finally:
        out.close()


def write_parquet(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Sorted files let later scans skip row groups by their bounds."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    out.write.mode("overwrite").parquet(path)


_SQLITE = {"int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL"}


def write_sqlite(df: DataFrame, path: str, table: str, batch: int = 1024) -> int:
    """Copy a result to a SQLite file on the driver, a batch at a time; returns the rows."""
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    cols = ", ".join(f"{quoted(f.name)} {_SQLITE.get(f.dataType.simpleString(), 'TEXT')}" for f in df.schema.fields)
    marks, n, rows = ", ".join("?" * len(df.columns)), 0, []
    with sqlite3.connect(path) as con:
        con.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        con.execute(f"CREATE TABLE {quoted(table)} ({cols})")
        for row in df.toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(v if isinstance(v, (int, float, str, type(None))) else str(v) for v in row))
            n += 1
            if len(rows) == batch:
                con.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", rows)
                rows = []
        con.executemany(f"INSERT INTO {quoted(table)} VALUES ({marks})", rows)
    return n
