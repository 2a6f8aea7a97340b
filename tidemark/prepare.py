"""One call from a folder of delimited text to tables, statistics, an oracle and a suite."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from tidemark.operators.profiler import ProfileConfig, profile_json
from tidemark.plans.ir import Query
from tidemark.sources.catalog import TableCatalog
from tidemark.sources.delimited import read_folder
from tidemark.sources.sinks import write_parquet, write_sqlite, write_text
from tidemark.validate import write_suite


def prepare(spark: SparkSession, dataset: str, out: str, sqlite: str | None = None, cases: Iterable[tuple[str, Query, str, bool]] = (), database: str = "default", config: ProfileConfig = ProfileConfig()) -> TableCatalog:
    """Compile every table of ``dataset`` and return their analyzed catalog.

    Under ``out`` come the tables as parquet (``tables``) and the catalog with column
    profiles (``catalog.json``). With ``sqlite``, a file on the driver, the tables are copied
    there too, and the suite of ``cases`` (name, query, SQL, whether order counts) is
    written with the outputs that SQLite computes (``suite.json``, ``expected``).
    """
    tables = read_folder(spark, dataset)
    for name, df in tables.items():
        write_parquet(df, f"{out}/tables/{name}.parquet")
    catalog = TableCatalog.of_folder(spark, f"{out}/tables", list(tables)).analyze(database)
    plain = {name: spark.read.parquet(f"{out}/tables/{name}.parquet") for name in tables}
    write_text(spark, f"{out}/catalog.json", profile_json(spark, plain, config))
    if sqlite:
        for name, df in plain.items():
            write_sqlite(df, sqlite, name)
        write_suite(spark, out, sqlite, cases)
    return catalog
