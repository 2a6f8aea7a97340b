"""Helpers that the corpus operators share.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
driver and executors share; a written table survives the loss of an executor and
cuts lineage. Only a local session without that setting (tests) gets a folder of its own;
a cluster without it is an error, as executors don't share the driver's folders.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, "") or _OWN.update({app: tempfile.mkdtemp(prefix="tidemark-")}) or _OWN[app]
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once results that read them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % mod


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows: those whose hashed key lies in that share of the hashes; all, if there are no more.

    The choice depends on the key alone, and no task sends rows that aren't kept.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths add up to about ``most``; at least one row each."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def batched(work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], text: str = "text", most: int = 4_000_000) -> Callable:
    """A mapInArrow function that hands ``work`` batches of about ``most`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            for lo, hi in slices(sizes, most):
                out = work(batch.slice(lo, hi - lo))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out

    return run
