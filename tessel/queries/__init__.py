"""Registered queries, one per operator, each with the DuckDB SQL that must agree with it."""

from __future__ import annotations

from tessel.queries import aggregates, encodings, joins, scans, tpch

QUERIES = dict(tpch.QUERIES)
ORACLE_SQL = dict(tpch.ORACLE_SQL)
for _module in (scans, joins, aggregates, encodings):
    QUERIES |= _module.query.queries
    ORACLE_SQL |= _module.query.oracle
