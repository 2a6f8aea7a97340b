"""The corpus operators' queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import OP7_SQL, op7_decontamination
from tidemark.llm.language_id import op1_language_id
from tidemark.llm.line_dedup import op5_line_dedup
from tidemark.llm.near_dedup import OP3_SQL, op3_near_dedup
from tidemark.llm.packing import op6_packing
from tidemark.llm.pii import op9_pii
from tidemark.llm.sharding import op10_sharding
from tidemark.llm.suffix_dedup import OP2_SQL, op2_suffix_dedup
from tidemark.llm.syncmers import op4_syncmers
from tidemark.llm.toxicity import op8_toxicity

_QUERIES = [
    op1_language_id,
    op2_suffix_dedup,
    op3_near_dedup,
    op4_syncmers,
    op5_line_dedup,
    op6_packing,
    op7_decontamination,
    op8_toxicity,
    op9_pii,
    op10_sharding,
]


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_near_dedup": OP3_SQL, "op7_decontamination": OP7_SQL}
