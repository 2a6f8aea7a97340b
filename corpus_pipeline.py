"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, what the stage before kept (``documents`` at first) and
the folder of the tables. All but the last return the columns of ``documents``:

- ``language_id`` learns from the labelled rows it gets and drops texts that are null,
  without a letter, or whose best language has a probability under ``least_score``.
- ``line_dedup`` deletes aligned blocks of lines that earlier documents hold, and drops
  documents that lose all their lines. ``n_chars`` follows the text.
- ``near_dedup`` keeps the document with the smallest id of each group.
- ``decontaminate`` drops documents that hold a window of a benchmark item, each by its
  text, whatever its id.
- ``pack`` returns the pieces with their places in sequences.

Rows with a null id pass the two deduplicating stages. Rows that share an id share their
fate in ``near_dedup``. Null texts and texts without a letter go in the first stage. Very
long texts are read whole. Extra columns are carried through all stages but the last,
whatever their names. Empty tables pass as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.language_id import UNKNOWN, identify_language, train_language_model
from tidemark.llm.line_dedup import remove_shared_lines
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import PackConfig, pack

#: How far the best language's probability must lie from chance towards certainty: 0.4 among four.
MIN_LANGUAGE = 0.2
#: Python workers outlive their stage and hold these besides what later ones need.
PACKING = PackConfig(cached_words=400_000)


def least_score(languages: int) -> float:
    """The least probability that a text's best of so many learned languages must have."""
    return 1 / languages + MIN_LANGUAGE * (1 - 1 / languages) if languages > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_language_model(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify_language(docs, model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(len(model.classes)))).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = remove_shared_lines(docs).filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_duplicates(docs).filter("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pack(docs.select("doc_id", "text"), config=PACKING)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", packing),
]

#: Trained models, alignment and tokenizers have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
