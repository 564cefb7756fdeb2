"""Every registered query of the core against its DuckDB SQL."""

import pytest

from tessel.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differ

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLE_SQL
    assert differ(con, QUERIES[name](spark, SF), ORACLE_SQL[name]) is None


def test_range_join_takes_all_orders(spark, con):
    """Orders beyond the first few hundred keys are joined too."""
    got = QUERIES["j27_range_join"](spark, SF).where("o_orderkey >= 400").count()
    (want,) = con.execute("SELECT count(*) FROM orders JOIN part ON p_retailprice BETWEEN o_totalprice / 100 - 1 AND o_totalprice / 100 + 1 WHERE o_orderkey >= 400").fetchone()
    assert got == want > 0
