"""Delimited text with a ``.schema`` file beside it.

The schema file has two lines, names and types, separated by ``|``. Data lines are
fields separated by ``|``, without header, quoting or escapes, with or without a
separator at the end. Blank lines are skipped; empty strings stay empty strings; a
short, long or malformed line is an error when it is read.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import PlanError

#: The format's type names; any case.
_TYPES = {"I32": T.IntegerType(), "I64": T.LongType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType()}


def parse_schema(source: str) -> T.StructType:
    lines = source.splitlines()
    if len(lines) < 2:
        raise PlanError("a schema has a line of names and a line of types")
    names, kinds = ([x.strip() for x in line.strip().rstrip("|").split("|")] for line in lines[:2])
    if len(names) > len(kinds):
        raise PlanError(f"{len(names)} names but {len(kinds)} types")
    out = T.StructType()
    for name, kind in zip(names, kinds, strict=False):
        if kind.upper() not in _TYPES:
            raise PlanError(f"unknown type {kind!r} of {name!r}")
        out = out.add(name, _TYPES[kind.upper()])
    return out


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines are split on the executors; a line with a wrong number of fields, or a field that isn't of its type, fails the query."""
    return parse_lines(spark.read.text(path), schema)


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of a column of lines."""
    lines = lines.select(F.trim(F.col(lines.columns[0])).alias("value")).filter("value <> ''")
    n = len(schema)
    parts = F.split("value", r"\|", -1)
    got = lines.select(F.when(F.size(parts) == n + 1, F.slice(parts, 1, n)).otherwise(parts).alias("f"), F.size(parts).alias("n"), F.element_at(parts, -1).alias("end"))
    right = (F.col("n") == n) | ((F.col("n") == n + 1) & (F.col("end") == ""))
    checked = got.select(F.when(right, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} fields, found "), F.col("n").cast("string"), F.lit(": "), F.array_join("f", "|")))).alias("f"))
    return checked.select(*[(F.col("f")[i] if isinstance(s.dataType, T.StringType) else F.trim(F.col("f")[i]).cast(s.dataType)).alias(s.name) for i, s in enumerate(schema)])


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each ``<name>.csv`` that has a ``<name>.schema``, by name; any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    files = {s.getPath().getName() for s in listed}
    out = {}
    for name in sorted(f[:-4] for f in files if f.endswith(".csv") and f"{f[:-4]}.schema" in files):
        base = posixpath.join(folder, name)
        source = spark.read.text(f"{base}.schema", wholetext=True).first()
        out[name] = read_table(spark, f"{base}.csv", parse_schema(source["value"] if source else ""))
    return out
