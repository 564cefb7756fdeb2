"""Encoded selections. Positions are the order keys of a table; the oracle computes the same by plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import scalar as S
from tessel.operators import masks as M
from tessel.queries.registry import Registry
from tessel.sources.scan import with_row_id

query = Registry()
c, lit = F.col, F.lit

_ROWS = "(SELECT max(o_orderkey) + 1 FROM orders)"
#: Two selections of order positions, and the runs of each, in SQL.
_A, _B = "o_totalprice > 60000", "o_orderpriority < '4'"
_RUNS = "SELECT min(p) AS start, max(p) AS \"end\" FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM ({0}) q) r GROUP BY g"
_POS_A, _POS_B = f"SELECT o_orderkey AS p FROM orders WHERE {_A}", f"SELECT o_orderkey AS p FROM orders WHERE {_B}"


def _rows(t):
    return t.orders.agg(F.max("o_orderkey")).first()[0] + 1


def _index(t, condition):
    return t.orders.where(condition).select(c("o_orderkey").alias("pos"))


def _rle(t, condition):
    return M.index_to_rle(_index(t, condition))


@query("c01_range_lengths", f"SELECT start, \"end\", \"end\" - start + 1 AS length FROM ({_RUNS.format(_POS_A)})")
def _(t):
    return M.lengths(_rle(t, _A))


@query("c01_range_check", "SELECT CAST(5 AS BIGINT) AS start, CAST(9 AS BIGINT) AS \"end\", 'overlap' AS fault UNION ALL SELECT 20, 10, 'bounds'")
def _(t):
    return M.check_ranges(t.spark.createDataFrame([(0, 6), (5, 9), (12, 13), (20, 10)], "start long, end long"))


@query("c02_plain_to_rle", _RUNS.format(_POS_A))
def _(t):
    return M.plain_to_rle(t.orders.select(c("o_orderkey").alias("pos"), F.expr(_A).alias("bit")))


@query("c03_rle_to_index", f"SELECT p AS pos FROM ({_POS_A})")
def _(t):
    return M.rle_to_index(_rle(t, _A))


@query("c04_rle_to_plain", f"SELECT i AS pos, i IN ({_POS_A}) AS bit FROM range(0, {_ROWS}) r(i)")
def _(t):
    return M.rle_to_plain(_rle(t, _A), _rows(t))


@query("c05_compact", f"SELECT CAST(coalesce(sum(n) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY start) - 1 AS BIGINT) AS \"end\" FROM (SELECT start, \"end\" - start + 1 AS n FROM ({_RUNS.format(_POS_A)}))")
def _(t):
    return M.compact(_rle(t, _A))


_AND, _OR = f"{_POS_A} INTERSECT {_POS_B}", f"{_POS_A} UNION {_POS_B}"


@query("c06_range_intersect", f"SELECT greatest(a.start, b.start) AS start, least(a.\"end\", b.\"end\") AS \"end\" FROM ({_RUNS.format(_POS_A)}) a JOIN ({_RUNS.format(_POS_B)}) b ON a.start <= b.\"end\" AND b.start <= a.\"end\"")
def _(t):
    return M.intersect(_rle(t, _A), _rle(t, _B))


@query("c07_range_union", _RUNS.format(_OR))
def _(t):
    return M.union(_rle(t, _A), _rle(t, _B))


_NOT_A = f"SELECT i AS p FROM range(0, {_ROWS}) r(i) WHERE i NOT IN ({_POS_A})"


@query("c08_complement", _RUNS.format(_NOT_A))
def _(t):
    return M.complement(_rle(t, _A), _rows(t))


@query("c09_index_in_rle", f"SELECT p AS pos FROM ({_AND})")
def _(t):
    return M.index_in_rle(_index(t, _B), _rle(t, _A))


@query("c10_rle_holding_index", f"SELECT DISTINCT start, \"end\" FROM ({_RUNS.format(_POS_A)}) a JOIN ({_POS_B}) b ON p BETWEEN start AND \"end\"")
def _(t):
    return M.rle_holding_index(_index(t, _B), _rle(t, _A))


@query("c11_index_and", f"SELECT p AS pos FROM ({_AND})")
def _(t):
    return M.index_and(_index(t, _A), _index(t, _B))


@query("c12_index_or", f"SELECT p AS pos FROM ({_OR})")
def _(t):
    return M.index_or(_index(t, _A), _index(t, _B))


@query("c13_complement_index", _RUNS.format(_NOT_A))
def _(t):
    return M.complement_index(_index(t, _A), _rows(t))


@query("c14_mask_types", f"SELECT 'rle' AS kind, count(*) AS n FROM ({_POS_A}) UNION ALL SELECT 'index', count(*) FROM ({_POS_A}) UNION ALL SELECT 'plain', count(*) FROM ({_POS_A})")
def _(t):
    n = _rows(t)
    masks = [M.mask_of(t.orders, F.expr(_A), "o_orderkey", n, k) for k in ("rle", "index", "plain")]
    out = [m.to_index().agg(F.count("*").alias("n")).select(lit(m.kind).alias("kind"), "n") for m in masks]
    return out[0].union(out[1]).union(out[2])


@query("c15_mask_decode", f"SELECT i AS pos, i IN ({_POS_A}) AS bit FROM range(0, {_ROWS}) r(i)")
def _(t):
    return M.mask_of(t.orders, F.expr(_A), "o_orderkey", _rows(t), "index").to_plain()


def _pair(t, a, b):
    n = _rows(t)
    return M.mask_of(t.orders, F.expr(_A), "o_orderkey", n, a), M.mask_of(t.orders, F.expr(_B), "o_orderkey", n, b)


@query("c16_mask_and", f"SELECT p AS pos FROM ({_AND})")
def _(t):
    a, b = _pair(t, "plain", "rle")
    return (a & b).to_index()


@query("c16_mask_or", f"SELECT p AS pos FROM ({_OR})")
def _(t):
    a, b = _pair(t, "index", "rle")
    return (a | b).to_index()


@query("c16_mask_not", _RUNS.format(_NOT_A))
def _(t):
    return (~_pair(t, "index", "rle")[0]).data


@query("c17_concatenated_ranges", "SELECT CAST(unnest(range(n_nationkey * 10, n_nationkey * 10 + n_regionkey)) AS BIGINT) AS pos FROM nation")
def _(t):
    return M.concatenated_ranges(t.nation.select((c("n_nationkey") * 10).cast("long").alias("s"), c("n_regionkey").alias("n")), "s", "n")




@query("c18_rle_aggregates", "SELECT CAST(sum(r_regionkey + 1) AS BIGINT) AS n, CAST(sum(r_regionkey * (r_regionkey + 1)) AS BIGINT) AS total, min(r_regionkey) + 0 AS least, max(r_regionkey) + 0 AS most, sum(r_regionkey * (r_regionkey + 1)) / sum(r_regionkey + 1) AS mean FROM region")
@query("c19_rle_sum", "SELECT CAST(sum(r_regionkey + 1) AS BIGINT) AS n, CAST(sum(r_regionkey * (r_regionkey + 1)) AS BIGINT) AS total, min(r_regionkey) + 0 AS least, max(r_regionkey) + 0 AS most, sum(r_regionkey * (r_regionkey + 1)) / sum(r_regionkey + 1) AS mean FROM region")
@query("c20_rle_min_max", "SELECT CAST(sum(r_regionkey + 1) AS BIGINT) AS n, CAST(sum(r_regionkey * (r_regionkey + 1)) AS BIGINT) AS total, min(r_regionkey) + 0 AS least, max(r_regionkey) + 0 AS most, sum(r_regionkey * (r_regionkey + 1)) / sum(r_regionkey + 1) AS mean FROM region")
@query("c21_rle_mean", "SELECT CAST(sum(r_regionkey + 1) AS BIGINT) AS n, CAST(sum(r_regionkey * (r_regionkey + 1)) AS BIGINT) AS total, min(r_regionkey) + 0 AS least, max(r_regionkey) + 0 AS most, sum(r_regionkey * (r_regionkey + 1)) / sum(r_regionkey + 1) AS mean FROM region")
@query("a26_rle_aggregates", "SELECT CAST(sum(r_regionkey + 1) AS BIGINT) AS n, CAST(sum(r_regionkey * (r_regionkey + 1)) AS BIGINT) AS total, min(r_regionkey) + 0 AS least, max(r_regionkey) + 0 AS most, sum(r_regionkey * (r_regionkey + 1)) / sum(r_regionkey + 1) AS mean FROM region")
def _(t):
    # region k stands for a run of k + 1 rows of the value k
    k = c("r_regionkey")
    return M.rle_aggregates(t.region.select((k * 10).alias("start"), (k * 10 + k).alias("end"), k.alias("value")))


@query("c22_q6_by_masks", "SELECT round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice > 60000 AND o_orderstatus = 'F'")
def _(t):
    # positions are the rows' own, and no mask holds a row that is not selected
    rows = with_row_id(t.orders, "pos")
    n = rows.count()
    dates = M.mask_of(rows, F.expr("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'"), "pos", n, "index")
    both = M.mask_of(rows, (c("o_totalprice") > 60000) & (c("o_orderstatus") == "F"), "pos", n, "index")
    return M.select(rows, "pos", dates & both).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("c23_dictionary", "SELECT dense_rank() OVER (ORDER BY v) - 1 AS id, v AS value FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)")
def _(t):
    return M.dictionary(t.spark, t.orders, "o_orderpriority")


@query("c23_dictionary_growth", "WITH old AS (SELECT row_number() OVER (ORDER BY v) - 1 AS id, v AS value FROM (SELECT DISTINCT p_brand AS v FROM part WHERE p_size < 2)), new AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand NOT IN (SELECT value FROM old)) SELECT id, value FROM old UNION ALL SELECT (SELECT count(*) FROM old) + row_number() OVER (ORDER BY v) - 1, v FROM new")
def _(t):
    old = M.dictionary(t.spark, t.part.where("p_size < 2"), "p_brand")
    return M.dictionary(t.spark, t.part, "p_brand", old)


@query("c24_dictionary_encode", "SELECT n_nationkey, coalesce(id, -1) AS code FROM nation LEFT JOIN (SELECT row_number() OVER (ORDER BY n_name) - 1 AS id, n_name AS v FROM nation WHERE n_regionkey = 1) ON n_name = v")
def _(t):
    ids = M.dictionary(t.spark, t.nation.where("n_regionkey = 1"), "n_name")
    return M.encode(t.nation, "n_name", ids, "code").select("n_nationkey", "code")


@query("c25_decimal_align", "SELECT o_orderkey, CAST(round(o_totalprice * 100, 0) AS BIGINT) AS scaled FROM orders")
def _(t):
    return t.orders.select("o_orderkey", (S.decimal(c("o_totalprice")) * 100).cast("long").alias("scaled"))


@query("c26_null_is_not_empty", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN NULL ELSE r_name END AS s, CAST(strlen(CASE r_regionkey WHEN 0 THEN '' WHEN 1 THEN NULL ELSE r_name END) AS BIGINT) AS n FROM region")
def _(t):
    s = S.simple_case(c("r_regionkey"), [(0, "")], None)
    s = F.when(c("r_regionkey") == 1, None).otherwise(F.coalesce(s, "r_name"))
    return t.region.select("r_regionkey", s.alias("s"), F.octet_length(s).cast("long").alias("n"))
