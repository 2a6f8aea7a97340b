"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    # Bounds and distinct counts order the joins; histograms of every column multiply planning time.
    "spark.sql.statistics.histogram.enabled": "false",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks."""
    base = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"} | SETTINGS | conf
    return SparkSession.builder.master(f"local[{cores}]").appName("tidemark").config(map=base).getOrCreate()
