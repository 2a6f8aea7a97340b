"""Tables by name or file id.

Tables may be parquet paths, delimited text or any DataFrame. ``analyze`` registers
external tables and computes their statistics for Spark's cost-based optimizer, which
orders joins by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import UnknownTable

#: Types without column statistics. Spark's filter estimation has no case for timestamps without zone and fails on theirs.
_WITHOUT = ("array", "map", "struct", "binary", "variant", "timestamp_ntz")


class TableCatalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._ids: dict[str, str] = {}
        self._paths: dict[str, str] = {}

    def add(self, name: str, df: DataFrame, file_id: str | None = None) -> TableCatalog:
        self._tables[name] = df
        self._ids[file_id or name] = name
        return self

    def add_parquet(self, name: str, path: str, file_id: str | None = None) -> TableCatalog:
        self._paths[name] = path
        return self.add(name, self.spark.read.parquet(path), file_id)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str]) -> TableCatalog:
        """``<folder>/<name>.parquet`` for each name; a name's files are opened when it is looked up."""
        out = cls(spark)
        out._paths = {n: f"{folder}/{n}.parquet" for n in names}
        return out

    def names(self) -> list[str]:
        return sorted({*self._tables, *self._paths})

    def __call__(self, key: str) -> DataFrame:
        name = key if key in self._tables or key in self._paths else self._ids.get(key)
        if name is None:
            raise UnknownTable(f"no table {key!r}; there are {', '.join(self.names())}")
        if name not in self._tables:
            self.add_parquet(name, self._paths[name])
        return self._tables[name]

    def analyze(self, database: str = "default") -> TableCatalog:
        """Register the parquet tables as external tables with column statistics, and use those."""
        for name, path in self._paths.items():
            full = f"`{database}`.`{name}`"
            self.spark.sql(f"DROP TABLE IF EXISTS {full}")
            self.spark.catalog.createTable(f"{database}.{name}", path=path, source="parquet")
            plain = [f"`{f.name}`" for f in self(name).schema.fields if f.dataType.typeName() not in _WITHOUT]
            self.spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(plain)}" if plain else ""))
            self._tables[name] = self.spark.table(f"{database}.{name}")
        return self
