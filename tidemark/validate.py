"""Comparison of results with expected ones, in order or as multisets; suites, their runner and its metrics."""

from __future__ import annotations

import json
import sqlite3
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import PlanError
from tidemark.operators.compiler import compile_plan
from tidemark.plans.ir import Query
from tidemark.sources.sinks import float_text, pipe_lines, write_text


def same_in_order(got: Iterable[str], expected: Iterable[str]) -> str | None:
    """The first difference, trimmed line by line; None if there is none."""
    a, b = iter(got), iter(expected)
    for n in range(1, 1 << 62):
        x, y = next(a, None), next(b, None)
        if x is None and y is None:
            return None
        if x is None or y is None:
            return f"line {n}: {'missing' if x is None else 'not expected'}: {y if x is None else x}"
        if x.strip() != y.strip():
            return f"line {n}: found {x!r}, expected {y!r}"
    return None


def same_sorted(got: Iterable[str], expected: Iterable[str]) -> str | None:
    return same_in_order(sorted(x.strip() for x in got), sorted(x.strip() for x in expected))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with both numbers; at any size, in one shuffle."""
    if a.dtypes != b.dtypes:
        raise PlanError(f"schemas differ: {a.dtypes} and {b.dtypes}")
    names = [f"f{i}" for i in range(len(a.columns))]
    sides = a.toDF(*names).withColumn("_l", F.lit(1)).unionByName(b.toDF(*names).withColumn("_l", F.lit(0)))
    out = sides.groupBy(*names).agg(F.sum("_l").alias("left_copies"), F.sum(1 - F.col("_l")).alias("right_copies"))
    return out.filter("left_copies <> right_copies").toDF(*a.columns, "left_copies", "right_copies")


#: The least memory limit of a case, and its default.
LEAST_MB = 64


@dataclass
class Case:
    name: str
    query: Query
    expected: list[str]
    sort_before_check: bool = False
    disabled: bool = False
    memory_limit_mb: int = LEAST_MB

    def __post_init__(self) -> None:
        if self.memory_limit_mb < LEAST_MB:
            raise PlanError(f"{self.name}: a memory limit of {self.memory_limit_mb} MB; the least is {LEAST_MB}")


@dataclass
class Outcome:
    name: str
    passed: bool
    seconds: float
    problem: str | None = field(default=None)
    metrics: dict[str, int] = field(default_factory=dict)


def load_suite(source: str, read: Callable[[str], list[str]]) -> list[Case]:
    """Cases from a JSON list of query configs; ``read`` gives the lines of an expected output's path."""
    obj = json.loads(source)
    return [
        Case(c["execution_name"], Query.from_json(json.dumps(c["query"])), read(c["expected_output_file"]), c.get("sort_before_check", False), c.get("disabled", False), c.get("memory_limit_mb", LEAST_MB))
        for c in obj["query_configs"]
    ]


def sql_lines(database: str, sql: str) -> list[str]:
    """The result of ``sql`` on a SQLite file as pipe text."""
    with sqlite3.connect(database) as con:
        shown = lambda v: "" if v is None else float_text(v) if isinstance(v, float) else str(v)
        return ["".join(f"{shown(v)}|" for v in row) for row in con.execute(sql)]


def write_suite(spark: SparkSession, folder: str, database: str, cases: Iterable[tuple[str, Query, str, bool]], memory_limit_mb: int = LEAST_MB) -> str:
    """Write a suite's config and expected outputs, which SQLite computes; returns the config's path.

    cases: name, query, SQL and whether the result's order counts.
    """
    configs = []
    for name, query, sql, ordered in cases:
        path = f"{folder}/expected/{name}.txt"
        write_text(spark, path, "".join(f"{line}\n" for line in sql_lines(database, sql)))
        case = Case(name, query, [], not ordered, memory_limit_mb=memory_limit_mb)
        configs.append({"execution_name": name, "query": json.loads(query.to_json()), "expected_output_file": path, "sort_before_check": not ordered, "disabled": False, "memory_limit_mb": case.memory_limit_mb})
    write_text(spark, f"{folder}/suite.json", json.dumps({"query_configs": configs}, indent=2))
    return f"{folder}/suite.json"


#: Columns of the metrics file: Spark's sums over the tasks of a case.
METRICS = ("numTasks", "executorRunTime", "inputBytes", "inputRecords", "outputRecords", "shuffleReadBytes", "shuffleWriteBytes", "memoryBytesSpilled", "diskBytesSpilled", "peakExecutionMemory")


def _stages(spark: SparkSession, after: int) -> tuple[int, dict[str, int]]:
    """The last stage so far, and the metrics of the stages since ``after``; the memory is that of the largest one's mean task."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    jvm = spark.sparkContext._jvm
    found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    last, sums = after, dict.fromkeys(METRICS, 0)
    for s in stages:
        if s.stageId() > after:
            last = max(last, s.stageId())
            for m in METRICS[:-1]:
                sums[m] += getattr(s, m)()
            sums[METRICS[-1]] = max(sums[METRICS[-1]], s.peakExecutionMemory() // max(1, s.numCompleteTasks()))
    return last, sums


def run_suite(cases: Iterable[Case], lookup: Callable[[str], DataFrame], cap_memory: bool = False) -> list[Outcome]:
    """Run the cases that aren't disabled.

    With ``cap_memory`` a case fails whose tasks took more than its limit. Spark's own
    memory is set for a session and not for a query, so tasks beyond it spill.
    """
    out = []
    for case in cases:
        if case.disabled:
            continue
        began, spark, at, used = time.perf_counter(), None, -1, {}
        try:
            result = compile_plan(case.query, lookup)
            spark = result.sparkSession
            at, _ = _stages(spark, -1)
            lines = pipe_lines(result)
            problem = (same_sorted if case.sort_before_check else same_in_order)(lines, case.expected)
        except PlanError as e:
            problem = f"{type(e).__name__}: {e}"
        seconds = time.perf_counter() - began
        if spark:
            _, used = _stages(spark, at)
            peak = used["peakExecutionMemory"]
            if cap_memory and problem is None and peak > case.memory_limit_mb << 20:
                problem = f"a task took {peak >> 20} MB; the limit is {case.memory_limit_mb}"
        out.append(Outcome(case.name, problem is None, seconds, problem, used))
    return out


def metrics_csv(outcomes: Iterable[Outcome]) -> str:
    """One line for each case: name, whether it passed, seconds and Spark's sums."""
    rows = [",".join(["name", "passed", "seconds", *METRICS])]
    rows += [",".join([f'"{o.name}"', str(o.passed).lower(), f"{o.seconds:.3f}", *[str(o.metrics.get(m, "")) for m in METRICS]]) for o in outcomes]
    return "\n".join(rows) + "\n"
