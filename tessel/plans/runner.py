"""Running, explaining, comparing and timing SQL."""

from __future__ import annotations

import math
import re
import statistics
import time
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessel.errors import UnsupportedPlanError

TOLERANCE = 1e-2


def sql_text(query: str | None = None, sql: str | None = None, sql_file: str | None = None) -> str:
    """The text of exactly one source: a known query's name, SQL, or a file."""
    given = [x for x in (query, sql, sql_file) if x is not None]
    if len(given) != 1:
        raise UnsupportedPlanError("give exactly one of query, sql and sql_file")
    if sql is not None:
        return sql
    if sql_file is not None:
        return Path(sql_file).read_text()
    from tessel.queries.tpch import SPARK_SQL

    if query not in SPARK_SQL:
        raise UnsupportedPlanError(f"no query {query!r}")
    return SPARK_SQL[query]


def run(spark: SparkSession, query: str | None = None, sql: str | None = None, sql_file: str | None = None) -> DataFrame:
    return spark.sql(sql_text(query, sql, sql_file))


def timed_run(spark: SparkSession, **source: str) -> tuple[list[dict], float]:
    """The rows and the seconds they took."""
    began = time.perf_counter()
    rows = [r.asDict() for r in run(spark, **source).collect()]
    return rows, time.perf_counter() - began


@dataclass(frozen=True)
class Plan:
    """What a query runs as: operators of the physical plan, output names and types, and what keeps it from running whole in the JVM's code."""

    nodes: dict[str, int]
    schema: list[tuple[str, str]]
    gaps: list[str]

    @property
    def admissible(self) -> bool:
        return not self.gaps


_NODE = re.compile(r"^[\s:|+*\-!]*(?:\(\d+\)\s*)?([A-Z][A-Za-z]+)")
_GAPS = {"CartesianProduct": "pairs every row with every row", "BroadcastNestedLoopJoin": "compares every row with every row of one side", "BatchEvalPython": "runs Python row by row"}


def explain(spark: SparkSession, sql: str) -> Plan:
    """Plan without running; a text that cannot be analysed is an UnsupportedPlanError."""
    try:
        df = spark.sql(sql)
        text = df._jdf.queryExecution().executedPlan().toString()
    except Exception as e:
        raise UnsupportedPlanError(str(e).split("\n")[0]) from e
    lines = [(m[1], line) for line in text.split("\n") if (m := _NODE.match(line))]
    nodes = Counter(n for n, _ in lines)
    gaps = [f"{n}: {_GAPS[n]}" for n in nodes if n in _GAPS]
    if _gathers_windows(lines):
        gaps.append("Window: all rows of a window without PARTITION BY come to one task")
    return Plan(dict(nodes), [(f.name, f.dataType.simpleString()) for f in df.schema], gaps)


def _gathers_windows(lines: Sequence[tuple[str, str]]) -> bool:
    """Whether a window's rows come from an exchange to a single partition."""
    for at, (node, _) in enumerate(lines):
        if node == "Window":
            below = next((line for n, line in lines[at + 1 :] if n not in ("Sort", "Window", "Project", "InputAdapter", "WholeStageCodegen")), "")
            if "SinglePartition" in below:
                return True
    return False


def probe(spark: SparkSession, sql: str) -> dict:
    """Whether a text can run, and what in its plan would not scale, without running it."""
    try:
        plan = explain(spark, sql)
    except UnsupportedPlanError as e:
        return {"admissible": False, "node_count": 0, "gaps": [str(e)]}
    return {"admissible": plan.admissible, "node_count": sum(plan.nodes.values()), "gaps": plan.gaps}


def coverage(spark: SparkSession, queries: Mapping[str, str]) -> dict[str, Plan | str]:
    """The plan of each query, or why it has none."""
    out: dict[str, Plan | str] = {}
    for name, sql in queries.items():
        try:
            out[name] = explain(spark, sql)
        except UnsupportedPlanError as e:
            out[name] = str(e)
    return out


def label(sql: str) -> str | None:
    """The known query whose normalised text this is; never used to choose how to run."""
    from tessel.queries.tpch import SPARK_SQL

    plain = lambda s: " ".join(s.lower().split())
    return next((n for n, s in SPARK_SQL.items() if plain(s) == plain(sql)), None)


def compare_rows(got: Sequence[Mapping], want: Sequence[Mapping], tolerance: float = TOLERANCE, ordered: bool = True) -> float:
    """The largest difference of numbers; other differences, or one over ``tolerance``, are a ValueError."""
    if len(got) != len(want):
        raise ValueError(f"{len(got)} rows, not {len(want)}")
    if not ordered:
        key = lambda r: [str(r[k]) for k in sorted(r) if not isinstance(r[k], float)]
        got, want = sorted(got, key=key), sorted(want, key=key)
    worst = 0.0
    for i, (a, b) in enumerate(zip(got, want, strict=True)):
        if list(a) != list(b):
            raise ValueError(f"row {i}: columns {list(a)}, not {list(b)}")
        for k in a:
            x, y = a[k], b[k]
            if isinstance(x, bool) or isinstance(y, bool) or x is None or y is None or isinstance(x, str):
                if x != y:
                    raise ValueError(f"row {i}, {k}: {x!r}, not {y!r}")
            elif hasattr(x, "__float__"):
                x, y = float(x), float(y)
                if math.isnan(x) != math.isnan(y):
                    raise ValueError(f"row {i}, {k}: {x!r}, not {y!r}")
                worst = max(worst, 0.0 if x == y or math.isnan(x) else abs(x - y))
            elif str(x) != str(y):
                raise ValueError(f"row {i}, {k}: {x!r}, not {y!r}")
    if worst > tolerance:
        raise ValueError(f"numbers differ by {worst}")
    return worst


def validate(spark: SparkSession, folder: str, sql: str, oracle: str, tolerance: float = TOLERANCE) -> tuple[int, float]:
    """``(rows, largest difference)`` of a query against DuckDB on the same Parquet files."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    got = [r.asDict() for r in spark.sql(sql).collect()]
    return len(got), compare_rows(got, want, tolerance, ordered="order by" in sql.lower())


def validate_all(spark: SparkSession, folder: str, pairs: Mapping[str, tuple[str, str]], keep_going: bool = True, tell: Callable[[str], None] = print) -> dict[str, str]:
    """Validate each pair of (SQL, oracle); says how each went as it goes."""
    out = {}
    for name, (sql, oracle) in pairs.items():
        try:
            n, worst = validate(spark, folder, sql, oracle)
            out[name] = "pass"
            tell(f"{name}: {n} rows, largest difference {worst:g}")
        except Exception as e:
            out[name] = str(e)
            tell(f"{name}: {e}")
            if not keep_going:
                raise
    return out


@dataclass(frozen=True)
class Timing:
    runs: int
    min: float
    median: float
    mean: float
    p95: float
    max: float
    stdev: float


def summarize(seconds: Sequence[float]) -> Timing:
    """The 95th percentile is the nearest rank."""
    if not seconds:
        raise UnsupportedPlanError("no runs")
    s = sorted(seconds)
    return Timing(len(s), s[0], statistics.median(s), statistics.fmean(s), s[math.ceil(0.95 * len(s)) - 1], s[-1], statistics.stdev(s) if len(s) > 1 else 0.0)


def benchmark(run: Callable[[], DataFrame], cold: int = 1, warm_up: int = 1, hot: int = 5) -> dict[str, Timing]:
    """Cold runs with an emptied cache, then hot ones. The result is made and thrown away, not collected."""

    def once() -> float:
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    spark = SparkSession.active()
    out = {}
    if cold:
        samples = []
        for _ in range(cold):
            spark.catalog.clearCache()
            samples.append(once())
        out["cold"] = summarize(samples)
    for _ in range(warm_up):
        once()
    if hot:
        out["hot"] = summarize([once() for _ in range(hot)])
    return out
