"""Plans, comparisons, compilation, sources, sinks, profiles and validation."""

import json
import sqlite3

import duckdb
import numpy as np
import pytest
from conftest import MIDDLE, SMALL
from pyspark.sql import functions as F

from tidemark import queries as Q
from tidemark.errors import AmbiguousColumn, PlanError, TypeMismatch, UnknownColumn, UnknownTable
from tidemark.operators.compiler import HINTS, compile_plan
from tidemark.operators.profiler import ProfileConfig, histogram, physical_order, profile_json, summary
from tidemark.plans import Col, Query, f32, f64, i32, i64, scan, text
from tidemark.prepare import prepare
from tidemark.sources import TableCatalog, parse_schema, pipe_lines, read_folder, write_parquet, write_pipe, write_sqlite
from tidemark.sources.sinks import float_text
from tidemark.validate import Case, load_suite, metrics_csv, multiset_difference, run_suite, same_in_order, same_sorted


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MIDDLE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, duck, name):
    got = Q.queries()[name](spark, MIDDLE)
    want = duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    shown = lambda df: sorted(map(repr, df[cols].astype(object).values.tolist()))
    assert shown(got.toPandas()) == shown(want)


FIXTURES = {"scan_project": 25, "filter_eq_i32": 5, "filter_ne_str": 4, "filter_gte_f64": 1000, "filter_lte_mixed": 12179, "filter_range": 17969, "filter_false": 0, "cross": 125, "join_theta": 10, "b1": 34603, "b2": 176, "b3": 2922, "b4": 80, "b5": 412, "b6": 2951, "b7": 3704, "b8": 1845, "b9": 812, "b10": 32, "join_composite_self": 96, "join_int_bigint": 25, "filter_columns": 3898}


@pytest.mark.parametrize(("name", "rows"), FIXTURES.items())
def test_row_counts(spark, name, rows):
    assert Q.run(spark, MIDDLE, name).count() == rows


@pytest.mark.parametrize("name", sorted(Q.PLANS))
def test_json_round_trip(name):
    q = Q.plan(name)
    assert Query.from_json(q.to_json(2)) == q


def test_json_form():
    q = scan("customer").cross(scan("orders")).filter_multiple(("c_custkey", "==", Col("o_custkey")), ("c_mktsegment", "==", "MACHINERY")).sort_multiple(("o_totalprice", False), "o_orderkey").project_multiple(("c_name", "name"), ("o_totalprice", "price")).build()
    assert json.loads(q.to_json()) == {
        "root": {"Project": {"column_name_map": [["c_name", "name"], ["o_totalprice", "price"]], "underlying": {"Sort": {"sort_specs": [{"column_name": "o_totalprice", "ascending": False}, {"column_name": "o_orderkey", "ascending": True}], "underlying": {"Filter": {"predicates": [{"column_name": "c_custkey", "operator": "EQ", "value": {"Column": "o_custkey"}}, {"column_name": "c_mktsegment", "operator": "EQ", "value": {"String": "MACHINERY"}}], "underlying": {"Cross": {"left": {"Scan": {"table_id": "customer"}}, "right": {"Scan": {"table_id": "orders"}}}}}}}}}}
    }
    for bad in ('{"root": {"Join": {}}}', '{"root": {"Scan": {}}}', '{"root": {"Filter": {"predicates": [{"column_name": "a", "operator": "LIKE", "value": {"I32": 1}}], "underlying": {"Scan": {"table_id": "t"}}}}}', "{}"):
        with pytest.raises(PlanError):
            Query.from_json(bad)


@pytest.mark.parametrize("name", ["b1", "sort_many", "filter_sort_project", "join_three", "b3"])
def test_order(spark, duck, name):
    keys = {"b1": "l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax", "b3": "o_orderdate, l_orderkey, l_linenumber, l_extendedprice, l_discount", "join_three": "c_acctbal DESC, c_custkey", "sort_many": "o_orderstatus, o_totalprice DESC, o_orderkey", "filter_sort_project": "s_acctbal DESC, s_suppkey"}[name]
    plain = Q.oracle_sql()[name].partition(" ORDER BY ")[0]
    got = [tuple(r) for r in Q.run(spark, MIDDLE, name).collect()]
    want = duck.execute(f"{plain} ORDER BY {keys}").fetchall()
    assert got == want


@pytest.mark.parametrize("hint", HINTS)
@pytest.mark.parametrize("name", ["join_equi", "join_equi_theta", "b7"])
def test_join_strategies_agree(spark, name, hint):
    assert multiset_difference(Q.run(spark, SMALL, name), Q.run(spark, SMALL, name, hint)).count() == 0


def plan_text(df):
    return df._jdf.queryExecution().toString()


def test_plans_push_down_and_join(spark):
    shown = plan_text(Q.run(spark, SMALL, "b2"))
    assert "CartesianProduct" not in shown.partition("Physical Plan")[2]
    b5 = plan_text(Q.run(spark, SMALL, "b5")).partition("Physical Plan")[2]
    assert "LessThan(l_quantity" in b5 and "l_tax" not in b5
    assert "p_size" in plan_text(Q.run(spark, SMALL, "filter_over_sort")).partition("PushedFilters")[2]


@pytest.fixture(scope="module")
def analyzed(spark):
    return TableCatalog.of_folder(spark, SMALL, Q.TABLES).analyze()


@pytest.mark.parametrize("name", sorted(Q.PLANS))
def test_plans_over_analyzed_tables(spark, analyzed, name):
    assert multiset_difference(Q.run(spark, SMALL, name), Q.run(spark, SMALL, name, catalog=analyzed)).count() == 0


def test_statistics_reach_the_plan(spark, analyzed):
    shown = analyzed("nation")._jdf.queryExecution().optimizedPlan().stats().toString()
    assert "rowCount=25" in shown


def test_sorted_tables_skip_row_groups(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("k"), F.col("id").alias("v"))
        for name, sort_by in (("sorted", ["k"]), ("mixed", None)):
            write_parquet(df, str(tmp_path / name), sort_by)
        read = {}
        for name in ("sorted", "mixed"):
            got = spark.read.parquet(str(tmp_path / name)).filter("k BETWEEN 500 AND 520")
            assert got.count() == 21
            plan = got._jdf.queryExecution().executedPlan()
            got._jdf.collect()
            read[name] = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
        assert read["sorted"] < 5000 and read["mixed"] == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def types(spark):
    rows = [(1, 2**53 + 1, 16777216.0, 1.0, "a"), (-(2**31), -(2**63), -0.0, 0.0, "B"), (2**31 - 1, 2**63 - 1, float("nan"), float("nan"), ""), (16777217, 5, 5.5, 2.0**53, "é")]
    return {"t": spark.createDataFrame(rows, "i int, l long, f float, d double, s string")}


@pytest.mark.parametrize("op", ["==", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("value", [i32(1), i64(2**53 + 1), f32(5.5), f64(0.0)])
@pytest.mark.parametrize("column", ["i", "l", "f", "d"])
def test_numeric_comparisons(types, column, op, value):
    import operator

    apply = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    got = compile_plan(scan("t").filter(column, op, value).build(), types.__getitem__, strict_float=True)
    kinds = {"i": np.int32, "l": np.int64, "f": np.float32, "d": np.float64}
    wide = (column in "fd" or value.kind in ("F32", "F64"))
    want = 0
    for r in types["t"].collect():
        x, y = kinds[column](r[column]), value.value
        x, y = (float(x), float(y)) if wide else (int(x), int(y))
        want += (op == "!=") if x != x else apply(x, y)
    assert got.count() == want


def test_strings_and_numbers(types):
    run = lambda *p: compile_plan(scan("t").filter(*p).build(), types.__getitem__)
    assert run("s", "==", 1).count() == 0 and run("i", "!=", "1").count() == 4
    assert [r["s"] for r in run("s", ">", "B").collect()] == ["a", "é"]
    for p in (("s", "<", 1), ("i", ">=", "1"), ("s", ">", Col("i"))):
        with pytest.raises(TypeMismatch):
            run(*p)


def test_names(spark):
    tables = {"a": spark.createDataFrame([(1, 2)], "k int, K int"), "b": spark.createDataFrame([(1, 5)], "k int, `x.y` int")}
    both = scan("a").cross(scan("b"))
    assert compile_plan(both.build(), tables.__getitem__).columns == ["k", "K", "k", "x.y"]
    assert compile_plan(both.filter("x.y", ">", Col("K")).project_multiple("x.y", "K", "K").build(), tables.__getitem__).collect() == [(5, 2, 2)]
    with pytest.raises(AmbiguousColumn):
        compile_plan(both.filter("k", "==", 1).build(), tables.__getitem__)
    with pytest.raises(UnknownColumn, match="there are k, K"):
        compile_plan(scan("a").sort("z").build(), tables.__getitem__)
    with pytest.raises(PlanError):
        compile_plan(scan("a").project_multiple().build(), tables.__getitem__)
    with pytest.raises(UnknownTable):
        TableCatalog(spark)("nothing")
    named = TableCatalog(spark).add("a", tables["a"], "file_7")
    assert named("file_7").columns == named("a").columns


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, s string")
    q = scan("t").filter("k", ">", 0).cross(scan("t").project("s", "z")).sort("k").build()
    assert compile_plan(q, lambda _: empty).collect() == []


def write(path, **files):
    for name, body in files.items():
        (path / name.replace("_dot_", ".")).write_text(body)


def test_delimited_text(spark, tmp_path):
    write(tmp_path, t_dot_csv='1|a "quoted"|2.5|\n\n2||3.25|\n3|x|1e3|\n', t_dot_schema="k|s|d|\nI32|string|FLOAT64|\n", other_dot_csv="1|\n")
    got = read_folder(spark, str(tmp_path))
    assert list(got) == ["t"] and sorted(got["t"].collect()) == [(1, 'a "quoted"', 2.5), (2, "", 3.25), (3, "x", 1000.0)]
    write(tmp_path, t_dot_csv="1|a|2.5|\n2|\n")
    with pytest.raises(Exception, match="expected 3 fields"):
        read_folder(spark, str(tmp_path))["t"].collect()
    for bad in ("a|b|\nI32|\n", "a|\nI16|\n", "a|\n"):
        with pytest.raises(PlanError):
            parse_schema(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1e7, 0.1, "x|y"), (2, 1.5e-5, 16777216.0, "")], "i int, d double, f float, s string").orderBy("i")
    want = ["1|10000000.0|0.1|x|y|", "2|0.000015|16777216.0||"]
    assert list(pipe_lines(df, framed=True)) == ["validate", *want, "!"]
    assert [float_text(x) for x in (np.float64("inf"), np.float64("nan"))] == ["inf.0", "NaN.0"]
    write_pipe(df, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == want
    write_parquet(df, str(tmp_path / "p"), sort_by=["i"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert write_sqlite(df, str(tmp_path / "x.db"), "t", batch=1) == 2
    assert sqlite3.connect(tmp_path / "x.db").execute("SELECT i, s FROM t ORDER BY i").fetchall() == [(1, "x|y"), (2, "")]


def test_profiles(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("int").alias("x"), F.when(F.col("id") == 50, 0).otherwise(F.col("id")).alias("y"), F.format_string("s%03d", "id").alias("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert {r["column_name"]: r["ordered"] for r in physical_order(t).collect()} == {"x": True, "y": False, "s": True}
    assert [tuple(r) for r in histogram(t, "x").orderBy("bucket").collect()] == [(b, 10 * b, 10 * b + 9, 10) for b in range(10)]
    rows = {r["column_name"]: r for r in summary(t).collect()}
    assert (rows["x"]["lower_bound"], rows["x"]["upper_bound"], rows["x"]["ndv"], rows["x"]["density"]) == ("0", "99", 100, 1.0)
    assert rows["s"]["lower_bound"] is None and rows["y"]["ndv"] == 99
    stats = json.loads(profile_json(spark, {"t": t}))["table_specs"][0]["column_specs"]
    assert stats[0]["stats"][0] == "IsPhysicallyOrdered" and stats[0]["stats"][1] == {"RangeStat": {"lower_bound": {"Int32": 0}, "upper_bound": {"Int32": 99}}}
    assert len(stats[2]["stats"]) == 3  # too many strings for a histogram
    many = spark.range(20_000).select("id")
    got = summary(many, ProfileConfig(exact_limit=1000)).first()["ndv"]
    assert abs(got - 20_000) < 2000
    assert sum(r["frequency"] for r in histogram(many, "id").collect()) == 20_000
    for values, cells in (([1] * 50 + [2] * 3 + [3] * 7, 1), (list(range(7)), 3), ([5, 5, 1, 9, 9, 9, 2, 7, 7, 8, 0, 3], 2), (["b", "a", "b", "c"] * 9, 256)):
        got = histogram(spark.createDataFrame([(v,) for v in values], ["v"]), "v", ProfileConfig(cells=cells)).orderBy("bucket").collect()
        own, size = sorted(values), -(-len(values) // min(10, len(values)))
        assert [tuple(r) for r in got] == [(k, p[0], p[-1], len(p)) for k, p in enumerate(own[i : i + size] for i in range(0, len(own), size))]
    assert histogram(spark.createDataFrame([(None,)], "v int"), "v").count() == 0
    ups = spark.createDataFrame([(i,) for i in range(5000)], "v int").repartitionByRange(6, "v").sortWithinPartitions("v")
    ups.write.parquet(str(tmp_path / "ups"))
    assert physical_order(spark.read.parquet(str(tmp_path / "ups"))).first()["ordered"]
    assert summary(t.limit(0)).first()["row_count"] == 0


def test_summary_counts_many_distinct_values_exactly(spark, tmp_path):
    """``customer`` of sf0.1 has more keys than an estimate's limit; copies with shifted keys have sixty times as many."""
    source = f"{MIDDLE.replace('sf0.01', 'sf0.1')}/customer.parquet"
    many = spark.read.parquet(source).crossJoin(spark.range(60).withColumnRenamed("id", "copy"))
    many.withColumn("c_custkey", F.expr("c_custkey + copy * 1000000")).drop("copy").write.parquet(str(tmp_path / "customer.parquet"))
    for folder, files in ((source.rpartition("/")[0], source), (str(tmp_path), f"{tmp_path}/customer.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{files}')")
        want = con.execute(Q.oracle_sql()["profile_summary"]).fetchall()
        assert sorted(tuple(r) for r in Q.queries()["profile_summary"](spark, folder).collect()) == sorted(want)
    both = spark.range(20_000).select("id", F.lit(None).cast("int").alias("none"), F.array("id").alias("many"))
    assert [r["ndv"] for r in summary(both, ProfileConfig(exact_limit=None)).collect()] == [20_000, 0, None]


def test_validation(spark):
    assert same_in_order(["a ", "b"], ["a", "b"]) is None and same_in_order(["a"], ["a", "b"]) and same_in_order(["b", "a"], ["a", "b"])
    assert same_sorted(["b", "a"], ["a", "b"]) is None and same_sorted(["a", "a"], ["a", "b"])
    lookup = {"t": spark.createDataFrame([(2,), (1,)], "k int")}.__getitem__
    q = scan("t").sort("k").build()
    cases = [Case("good", q, ["1|", "2|"]), Case("bad", q, ["2|", "1|"]), Case("any order", q, ["2|", "1|"], sort_before_check=True), Case("off", q, [], disabled=True), Case("broken", scan("t").filter("z", "==", 1).build(), [])]
    assert [(o.name, o.passed) for o in run_suite(cases, lookup)] == [("good", True), ("bad", False), ("any order", True), ("broken", False)]
    done = run_suite(cases[:1], lookup)
    header, line = metrics_csv(done).splitlines()
    assert header.startswith("name,passed,seconds,numTasks") and line.startswith('"good",true,') and done[0].metrics["numTasks"] > 0
    with pytest.raises(PlanError):
        Case("small", q, [], memory_limit_mb=63)
    big = {"t": spark.range(3_000_000).select((-F.col("id")).alias("k"))}.__getitem__
    capped = run_suite([Case("big", scan("t").sort("k").filter("k", ">", -2).build(), ["-1|", "0|"], memory_limit_mb=64)], big, cap_memory=True)
    peak = capped[0].metrics["peakExecutionMemory"]
    assert capped[0].passed == (peak <= 64 << 20) and peak > 0
    a, b = (spark.createDataFrame(x, "k int") for x in ([(1,), (1,), (2,)], [(1,), (2,), (3,)]))
    assert sorted(map(tuple, multiset_difference(a, b).collect())) == [(1, 2, 1), (3, 0, 1)]


def test_prepare(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, t_dot_csv="1|b|2.5|\n2|a|3.0|\n3|a|1e3|\n", t_dot_schema="k|s|d|\nI32|STRING|FLOAT64|\n", u_dot_csv="1|x|\n3|y|\n", u_dot_schema="uk|name|\nI64|STRING|\n")
    cases = [
        ("joined", scan("t").cross(scan("u")).filter("k", "==", Col("uk")).sort("k", False).project_multiple("name", "d").build(), "SELECT name, d FROM t, u WHERE k = uk ORDER BY k DESC", True),
        ("any", scan("t").filter("s", "==", "a").build(), "SELECT * FROM t WHERE s = 'a'", False),
    ]
    spark.sql("CREATE DATABASE IF NOT EXISTS prepared")
    catalog = prepare(spark, str(source), str(tmp_path / "out"), str(tmp_path / "oracle.db"), cases, "prepared")
    assert catalog.names() == ["t", "u"]
    specs = json.loads((tmp_path / "out" / "catalog.json").read_text())["table_specs"]
    assert [s["name"] for s in specs] == ["t", "u"] and specs[0]["column_specs"][0]["stats"][0] == "IsPhysicallyOrdered"
    suite = load_suite((tmp_path / "out" / "suite.json").read_text(), lambda p: (tmp_path / "out" / "expected" / p.rpartition("/")[2]).read_text().splitlines())
    assert [(c.name, c.sort_before_check, c.memory_limit_mb, c.expected) for c in suite] == [("joined", False, 64, ["y|1000.0|", "x|2.5|"]), ("any", True, 64, ["2|a|3.0|", "3|a|1000.0|"])]
    assert all(o.passed for o in run_suite(suite, catalog))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert text("x").kind == "String"
