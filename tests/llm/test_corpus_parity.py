"""Corpus queries that SQL can express, against DuckDB."""

import pytest

from tessel.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differ(connect(SF), QUERIES[name](spark, SF), ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    """Held against brute force elsewhere; here: a row per document or vector, whatever SQL cannot say."""
    table = {"op8_embedding_dedup": "embeddings"}.get(name, "documents")
    got, rows = QUERIES[name](spark, SF), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert got.count() >= (rows if name != "op9_token_counts" else 1)
