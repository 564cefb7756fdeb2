"""Runner, comparison, timing, command line, streaming roll-up."""

import json

import pytest

from tessel import cli
from tessel.errors import UnsupportedPlanError
from tessel.operators.aggregate import Agg, parse_aggregate
from tessel.plans import report, runner
from tessel.plans.pipeline import one_mode
from tessel.queries.tpch import ORACLE_SQL, SPARK_SQL
from tessel.session import register
from tessel.streaming import rollup

SF = "/root/testdata/sf0.001"


def test_one_source_of_text(tmp_path):
    (tmp_path / "q.sql").write_text("SELECT 2")
    assert runner.sql_text(sql="SELECT 1") == "SELECT 1" and runner.sql_text(sql_file=str(tmp_path / "q.sql")) == "SELECT 2"
    assert runner.sql_text(query="tpch_q06") == SPARK_SQL["tpch_q06"]
    for bad in ({}, {"sql": "a", "query": "b"}, {"query": "nothing"}):
        with pytest.raises(UnsupportedPlanError):
            runner.sql_text(**bad)


def test_explain_and_coverage(spark):
    register(spark, SF)
    plan = runner.explain(spark, "SELECT n_name, count(*) AS n FROM nation GROUP BY n_name")
    assert plan.admissible and plan.schema == [("n_name", "string"), ("n", "bigint")] and plan.nodes["HashAggregate"] == 2
    gaps = runner.explain(spark, "SELECT count(*) FROM orders o JOIN lineitem l ON o.o_totalprice < l.l_extendedprice").gaps
    assert gaps and not any(":" not in g for g in gaps)
    with pytest.raises(UnsupportedPlanError):
        runner.explain(spark, "SELECT nothing FROM nowhere")
    found = runner.coverage(spark, {**SPARK_SQL, "bad": "SELEC"})
    assert isinstance(found["bad"], str) and all(isinstance(found[q], runner.Plan) for q in SPARK_SQL)
    assert runner.label(SPARK_SQL["tpch_q03"].upper().replace("\n", "  ").lower()) == "tpch_q03" and runner.label("SELECT 1") is None


def test_probe_tells_what_does_not_scale(spark):
    register(spark, SF)
    assert runner.probe(spark, "SELECT rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) FROM nation")["admissible"]
    for sql, said in (("SELECT rank() OVER (ORDER BY o_orderkey) FROM orders", "one task"), ("SELECT nothing FROM nowhere", "nowhere"), ("SELECT count(*) FROM orders a JOIN orders b ON a.o_orderkey < b.o_orderkey", "every row")):
        found = runner.probe(spark, sql)
        assert not found["admissible"] and said in found["gaps"][0]


def test_modes_do_not_combine():
    assert one_mode(scan_chunk=100, partition=False) == "scan_chunk" and one_mode() is None
    for bad in ({"scan_chunk": 1, "masks": True}, {"partition": True, "masks": True}, {"other": 1}):
        with pytest.raises(UnsupportedPlanError):
            one_mode(**bad)


def test_aggregate_texts():
    assert parse_aggregate("sum(x)") == parse_aggregate(' SUM_NO_OVERFLOW ( "x" ) ') == Agg("sum", "x") and parse_aggregate("count_star()") == parse_aggregate("count(*)") == Agg("count_star")
    assert parse_aggregate("avg(l_quantity)") == Agg("avg", "l_quantity") and parse_aggregate('min("a b")') == Agg("min", "a b")
    for bad in ("median(x)", "sum()", "sum(*)", "sum(x + 1)", "sum", "count(DISTINCT x)", ""):
        with pytest.raises(UnsupportedPlanError):
            parse_aggregate(bad)


def test_reports(tmp_path):
    found = {"tpch_q01": runner.summarize([1.0, 2.0, 3.0]), "a|b": runner.summarize([0.5])}
    report.write(found, str(tmp_path))
    assert json.loads((tmp_path / "profile.json").read_text())["tpch_q01"]["median"] == 2.0
    assert (tmp_path / "profile.csv").read_text().splitlines()[0].startswith("query,") and len((tmp_path / "profile.csv").read_text().splitlines()) == 3
    table = (tmp_path / "profile.md").read_text().splitlines()
    assert len(table) == 4 and all(line.replace("\\|", "").count("|") == table[0].count("|") for line in table)


def test_leaner_plans(spark):
    """Order lines are read once where the plain text reads them more often, and cut down before they are grouped."""
    register(spark, SF)
    plan = lambda n: spark.sql(SPARK_SQL[n])._jdf.queryExecution().optimizedPlan().toString()
    assert plan("tpch_q21").count("Relation") == 3
    for n in ("tpch_q02", "tpch_q20"):
        lines = plan(n).split("\n")
        at = next(i for i, line in enumerate(lines) if "l_suppkey" in line and "Aggregate [l_partkey" in line)
        assert "LeftSemi" in "".join(lines[at : at + 4])


def test_validate(spark):
    register(spark, SF)
    n, worst = runner.validate(spark, SF, SPARK_SQL["tpch_q01"], ORACLE_SQL["tpch_q01"])
    assert n > 0 and worst <= 0.01
    told = []
    out = runner.validate_all(spark, SF, {"good": ("SELECT 1 AS a", "SELECT 1 AS a"), "bad": ("SELECT 1 AS a", "SELECT 2 AS a")}, tell=told.append)
    assert out["good"] == "pass" and out["bad"] != "pass" and len(told) == 2
    with pytest.raises(ValueError):
        runner.validate_all(spark, SF, {"bad": ("SELECT 1 AS a", "SELECT 2 AS a")}, keep_going=False, tell=told.append)


def test_compare_rows():
    assert runner.compare_rows([{"a": 1.0, "b": "x"}], [{"a": 1.005, "b": "x"}]) == pytest.approx(0.005)
    assert runner.compare_rows([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], [{"a": 2, "b": "y"}, {"a": 1, "b": "x"}], ordered=False) == 0
    for got, want in (([], [{"a": 1}]), ([{"a": 1}], [{"b": 1}]), ([{"a": None}], [{"a": 0}]), ([{"a": "x"}], [{"a": "y"}]), ([{"a": float("nan")}], [{"a": 0.0}])):
        with pytest.raises(ValueError):
            runner.compare_rows(got, want)


def test_timings(spark):
    s = runner.summarize([5.0, 1.0, 2.0, 4.0, 3.0])
    assert (s.min, s.median, s.mean, s.p95, s.max) == (1.0, 3.0, 3.0, 5.0, 5.0) and runner.summarize([2.0]).stdev == 0
    assert runner.summarize([float(i) for i in range(1, 101)]).p95 == 95
    got = runner.benchmark(lambda: spark.range(10), cold=1, warm_up=0, hot=2)
    assert got["cold"].runs == 1 and got["hot"].runs == 2
    rows, seconds = runner.timed_run(spark, sql="SELECT 1 AS a")
    assert rows == [{"a": 1}] and seconds > 0
    with pytest.raises(UnsupportedPlanError):
        runner.summarize([])


def test_command_line(spark, capsys):
    assert cli.main(["run", "--data", SF, "--json", "--sql", "SELECT r_name FROM region WHERE r_regionkey = 1"]) == 0
    assert json.loads(capsys.readouterr().out) == {"r_name": spark.read.parquet(f"{SF}/region.parquet").where("r_regionkey = 1").first()["r_name"]}
    assert cli.main(["validate", "--data", SF, "--queries", "tpch_q06,tpch_q14"]) == 0
    assert cli.main(["explain", "--data", SF, "--query", "tpch_q06"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "--data", SF, "--sql", "a", "--query", "b"])


def test_streamed_rollup_counts_each_batch_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    aggs = {"n": Agg("count_star"), "m": Agg("avg", "value")}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it finds nothing new
        assert rollup.start(stream, ["event_type"], aggs, str(tmp_path / "states"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = {r["event_type"]: (r["n"], round(r["m"], 6)) for r in rollup.result(spark, ["event_type"], aggs, str(tmp_path / "states")).collect()}
    want = {r[0]: (r[1], round(r[2], 6)) for r in events.groupBy("event_type").agg({"*": "count", "value": "avg"}).select("event_type", "count(1)", "avg(value)").collect()}
    assert got == want


def test_entry_without_the_corpus_operators(tmp_path):
    """The registry still imports when the corpus package and its pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "tessel", tmp_path / "tessel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'tpch_q01' in q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
