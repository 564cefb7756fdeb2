"""Command line: ``python -m tessel.cli run|explain|probe|validate|bench|coverage``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from tessel.plans import report, runner
from tessel.session import register, session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessel")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("run", "explain", "probe", "validate", "bench", "coverage"):
        c = commands.add_parser(name)
        c.add_argument("--data", required=True, help="folder of Parquet tables")
        c.add_argument("--master", default="local[*]")
        c.add_argument("--json", action="store_true")
        if name in ("run", "explain", "probe", "bench"):
            one = c.add_mutually_exclusive_group(required=True)
            one.add_argument("--query")
            one.add_argument("--sql")
            one.add_argument("--sql-file")
        if name == "validate":
            c.add_argument("--queries", default="all", help="names, comma-joined, or all")
            c.add_argument("--keep-going", action="store_true")
        if name == "bench":
            c.add_argument("--cold", type=int, default=1)
            c.add_argument("--warm-up", type=int, default=1)
            c.add_argument("--hot", type=int, default=5)
            c.add_argument("--report", help="folder for JSON, CSV and Markdown files of the timings")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from tessel.queries.tpch import ORACLE_SQL, SPARK_SQL

    spark = session(args.master)
    register(spark, args.data)
    say = lambda x: print(json.dumps(x, default=str) if args.json else x)
    if args.command in ("run", "explain", "probe", "bench"):
        text = runner.sql_text(args.query, args.sql, args.sql_file)
    if args.command == "run":
        for row in spark.sql(text).toLocalIterator():
            say(row.asDict())
    elif args.command == "explain":
        say(dataclasses.asdict(runner.explain(spark, text)))
    elif args.command == "probe":
        found = runner.probe(spark, text)
        say(found)
        return int(not found["admissible"])
    elif args.command == "bench":
        found = runner.benchmark(lambda: spark.sql(text), args.cold, args.warm_up, args.hot)
        if args.report:
            report.write(found, args.report)
        say({k: dataclasses.asdict(v) for k, v in found.items()})
    elif args.command == "coverage":
        found = runner.coverage(spark, SPARK_SQL)
        say({n: x if isinstance(x, str) else {"nodes": sum(x.nodes.values()), "gaps": x.gaps} for n, x in found.items()})
    else:
        names = list(SPARK_SQL) if args.queries == "all" else args.queries.split(",")
        found = runner.validate_all(spark, args.data, {n: (SPARK_SQL[n], ORACLE_SQL[n]) for n in names}, args.keep_going)
        return int(any(v != "pass" for v in found.values()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
