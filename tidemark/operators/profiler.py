"""Column profiles: row count, bounds, distinct count, density, physical order, histogram.

All columns share two passes that read each row once and send only aggregates:

- counts, bounds and a sketch of distinct values. The distinct count is exact up to
  ``exact_limit`` values, which are counted only for columns that the sketch shows near
  it, and the sketch's estimate beyond. Without a limit there is no sketch, and every
  count is exact.
- physical order: each input partition is checked as it streams by, in file order, and
  gives the first and last value of each file part; the parts are then compared in the
  order of (file, row). Nothing is shuffled but one row for each file part. A column
  with a null is not ordered.

Histograms are equi-depth and exact at any size: equal values are counted together, the
values are dealt over cells of similar size, cut at a hashed sample of them, and each
cell numbers its own. A value that fills several buckets bounds each of them.

Columns that can't be ordered (arrays, maps) get counts only. An empty table has no
statistics but its count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ProfileConfig:
    #: Distinct values beyond which a count is estimated; None counts all.
    exact_limit: int | None = 10_000
    #: Relative error of a 4096-register HyperLogLog.
    error: float = 0.0163
    buckets: int = 10
    #: Values that cut a histogram's column into cells; more have no effect on the result.
    cells: int = 256
    string_histogram_limit: int = 50


_COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _COMPLEX)]


def _q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def physical_order(df: DataFrame) -> DataFrame:
    """``column_name`` and ``ordered`` for each column that can be ordered, of a file-based DataFrame."""
    cols = _plain(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, ordered boolean")
    kinds = {c: df.schema[c].dataType.simpleString() for c in cols}
    source = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *[F.col(_q(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    n = len(cols)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        names = ["file", "row", *[f"{k}{i}" for i in range(n) for k in ("ok", "lo", "hi")]]
        held: list | None = None
        after = None
        for b in batches:
            files = b.column("file").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                own = b.slice(lo, hi - lo)
                out = [own.column("file").slice(0, 1), own.column("row").slice(0, 1)]
                for i in range(n):
                    v = own.column(f"v{i}")
                    up = v.null_count == 0 and (len(v) < 2 or bool(pc.all(pc.less_equal(v.slice(0, len(v) - 1), v.slice(1))).as_py()))
                    out += [pa.array([up]), v.slice(0, 1), v.slice(len(v) - 1, 1)]
                begins = (out[0][0].as_py(), out[1][0].as_py())
                if held is not None and begins == after:
                    for j in range(2, len(out), 3):
                        up = held[j][0].as_py() and out[j][0].as_py() and bool(pc.less_equal(held[j + 2], out[j + 1])[0].as_py())
                        held[j : j + 3] = [pa.array([up]), held[j + 1], out[j + 2]]
                else:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays(held, names)
                    held = out
                after = (begins[0], own.column("row")[own.num_rows - 1].as_py() + 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays(held, names)

    schema = "file string, row long, " + ", ".join(f"ok{i} boolean, lo{i} {kinds[c]}, hi{i} {kinds[c]}" for i, c in enumerate(cols))
    found = source.mapInArrow(parts, schema)
    order = Window.orderBy("file", "row")
    steps = found.select(*[(F.col(f"ok{i}") & F.coalesce(F.lag(f"hi{i}").over(order) <= F.col(f"lo{i}"), F.lag("file").over(order).isNull())).alias(f"up{i}") for i in range(n)])
    flat = steps.agg(*[F.bool_and(F.coalesce(f"up{i}", F.lit(False))).alias(f"up{i}") for i in range(n)])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"up{i}").alias("ordered")) for i, c in enumerate(cols)])).alias("r")).select("r.*")


def summary(df: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """One row for each column: ``column_name``, ``row_count``, ``lower_bound``, ``upper_bound`` (as text, not for strings), ``ndv`` and ``density``."""
    cols = _plain(df)
    fields = [f for f in df.schema.fields]
    limit, near, rough = config.exact_limit, cols, None
    if limit is not None:
        rough = df.agg(*[F.approx_count_distinct(_q(c), config.error).alias(f"a{i}") for i, c in enumerate(cols)] or [F.lit(0)]).first()
        near = [c for i, c in enumerate(cols) if rough[f"a{i}"] <= limit * (1 + 5 * config.error)]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(_q(f.name))
        if f.name in near:
            aggs.append(F.count_distinct(c).alias(f"d{i}"))
        if f.name in cols and not isinstance(f.dataType, T.StringType):
            aggs += [F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"u{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        known = f.name in cols
        bounds = known and not isinstance(f.dataType, T.StringType)
        text = F.lit(None).cast("string")
        ndv = F.lit(int(rough[f"a{cols.index(f.name)}"])) if known and rough else F.lit(None)
        if f.name in near:
            ndv = F.col(f"d{i}") if limit is None else F.when(F.col(f"d{i}") <= limit, F.col(f"d{i}")).otherwise(ndv)
        ndv = ndv.cast("bigint")
        density = F.when(F.col("n") > 0, F.least(F.lit(1.0).cast("float"), (ndv.cast("float") / F.col("n").cast("float")).cast("float")))
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n").alias("row_count"), (F.col(f"l{i}") if bounds else text).alias("lower_bound"), (F.col(f"u{i}") if bounds else text).alias("upper_bound"), ndv.alias("ndv"), density.alias("density")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """Equi-depth buckets of a column: ``bucket``, ``lower_bound``, ``upper_bound``, ``frequency``; nulls are left out."""
    counts = df.select(F.col(_q(column)).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    bounds = counts.orderBy(F.xxhash64("v"), "v").limit(config.cells).agg(F.sort_array(F.collect_list("v")).alias("bounds"))
    placed = counts.crossJoin(F.broadcast(bounds)).select("v", "c", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("cell"))
    sums = placed.groupBy("cell").agg(F.sum("c").alias("s"))
    base = sums.select("cell", (F.sum("s").over(Window.orderBy("cell")) - F.col("s")).alias("base"), F.sum("s").over(Window.partitionBy()).alias("n"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("before", before).join(F.broadcast(base), "cell").select("v", (F.col("base") + F.col("before")).alias("first"), (F.col("base") + F.col("before") + F.col("c") - 1).alias("last"), F.expr(f"(n + least({config.buckets}, n) - 1) div least({config.buckets}, n)").alias("chunk"))
    dealt = ranked.select("*", F.explode(F.expr("sequence(first div chunk, last div chunk)")).alias("bucket"))
    inside = F.least("last", (F.col("bucket") + 1) * F.col("chunk") - 1) - F.greatest("first", F.col("bucket") * F.col("chunk")) + 1
    return dealt.groupBy("bucket").agg(F.min("v").alias("lower_bound"), F.max("v").alias("upper_bound"), F.sum(inside).alias("frequency"))


def profile(df: DataFrame, config: ProfileConfig = ProfileConfig()) -> DataFrame:
    """``summary`` with the physical order of each column."""
    return summary(df, config).join(physical_order(df), "column_name", "left")


_TAGS = {"int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String"}


def profile_json(spark: SparkSession, tables: dict[str, DataFrame], config: ProfileConfig = ProfileConfig()) -> str:
    """The catalog with each column's statistics, in the order: ordered, range, cardinality, density, histogram."""
    specs = []
    for name, df in tables.items():
        rows = {r["column_name"]: r for r in profile(df, config).collect()}
        columns = []
        for f in df.schema.fields:
            tag = _TAGS.get(f.dataType.simpleString(), f.dataType.simpleString())
            r, stats = rows[f.name], []
            shown = lambda v, tag=tag: {tag: v if isinstance(v, (int, float, str)) else str(v)}
            parse = {"Int32": int, "Int64": int, "Float32": float, "Float64": float}.get(tag, str)
            if r["row_count"] and r["ndv"] is not None:
                if r["ordered"]:
                    stats.append("IsPhysicallyOrdered")
                if r["lower_bound"] is not None:
                    stats.append({"RangeStat": {"lower_bound": shown(parse(r["lower_bound"])), "upper_bound": shown(parse(r["upper_bound"]))}})
                stats += [{"CardinalityStat": r["ndv"]}, {"DensityStat": r["density"]}]
                if tag != "String" or r["ndv"] <= config.string_histogram_limit:
                    points = histogram(df, f.name, config).orderBy("bucket").collect()
                    stats.append({"HistogramStat": {"frequency_points": [[{"lower_bound": shown(p["lower_bound"]), "upper_bound": shown(p["upper_bound"])}, p["frequency"]] for p in points]}})
            columns.append({"column_name": f.name, "data_type": tag, "stats": stats or None})
        specs.append({"name": name, "file_id": name, "column_specs": columns})
    return json.dumps({"table_specs": specs}, indent=2)
