"""Aggregates, windows, and chunked execution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.functions import scalar as S
from tessel.operators import aggregate as A
from tessel.operators import window as W
from tessel.operators.aggregate import Agg
from tessel.plans.pipeline import Pipeline
from tessel.queries.registry import Registry
from tessel.sources import scan as X

query = Registry()
c, lit = F.col, F.lit

_GROUP = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2"


@query("a01_hash_group_by", _GROUP)
@query("a11_group_keys", _GROUP)
@query("a21_key_aggregates", _GROUP)
@query("a28_generic_aggregates", _GROUP)
def _(t):
    return A.group(t.lineitem, ["l_returnflag", "l_linestatus"], q=F.round(F.sum("l_quantity"), 2), n=F.count("*"))


@query("a02_ungrouped", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, min(l_quantity) + 0.0 AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return A.group(t.lineitem.where("l_returnflag = 'R'"), [], n=F.count("*"), s=F.round(F.sum("l_extendedprice"), 2), lo=F.min("l_quantity") + 0.0, hi=F.max("l_quantity"))


@query("a02_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderstatus) AS lo FROM orders WHERE o_totalprice < 0")
def _(t):
    return A.group(t.orders.where("o_totalprice < 0"), [], n=F.count("*"), s=F.sum("o_totalprice"), lo=F.min("o_orderstatus"))


@query("a03_count_star", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders, ["o_orderstatus"], n=F.count("*"))


@query("a04_count_skips_nulls", "SELECT o_orderpriority, count(nullif(o_orderstatus, 'F')) AS n FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders, ["o_orderpriority"], n=F.count(F.nullif("o_orderstatus", lit("F"))))


@query("a05_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_discount) AS d FROM lineitem GROUP BY 1")
def _(t):
    return A.group(t.lineitem, ["l_returnflag"], s=F.countDistinct("l_suppkey"), d=F.countDistinct("l_discount"))


@query("a06_sum_null_group", "SELECT n_regionkey, CAST(sum(nullif(n_nationkey, 3)) AS BIGINT) AS s, sum(CASE WHEN n_nationkey > 99 THEN 1 END)::BIGINT AS none FROM nation GROUP BY 1")
def _(t):
    return A.group(t.nation, ["n_regionkey"], s=F.sum(F.nullif("n_nationkey", lit(3))), none=F.sum(S.case([(c("n_nationkey") > 99, lit(1))])))


@query("a07_avg", "SELECT l_linestatus, round(avg(l_quantity), 6) AS a, round(avg(CAST(l_extendedprice AS DECIMAL(15,2))), 6) AS d FROM lineitem GROUP BY 1")
def _(t):
    return A.group(t.lineitem, ["l_linestatus"], a=F.round(F.avg("l_quantity"), 6), d=F.round(S.mean(S.decimal(c("l_extendedprice"))), 6))


@query("a08_min_max", "SELECT o_orderstatus, min(o_orderpriority) AS a, max(o_orderpriority) AS b, min(o_totalprice) AS x, max(o_totalprice) AS y, CAST(min(o_orderdate) AS DATE) AS d FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders, ["o_orderstatus"], a=F.min("o_orderpriority"), b=F.max("o_orderpriority"), x=F.min("o_totalprice"), y=F.max("o_totalprice"), d=F.min("o_orderdate").cast("date"))


@query("a09_first", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders, ["o_custkey"], p=A.first_by("o_totalprice", "o_orderkey"))


@query("a12_sorted_input", "SELECT o_orderkey // 100 AS k, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders.select(F.floor(c("o_orderkey") / 100).cast("long").alias("k")), ["k"], n=F.count("*"))


@query("a13_dictionary_keys", "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2")
def _(t):
    return A.group(t.orders, ["o_orderpriority", "o_orderstatus"], s=F.round(F.sum("o_totalprice"), 2))


@query("a14_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14 AND sum(o_totalprice) > 1000000")
def _(t):
    return A.group(t.orders, ["o_custkey"], n=F.count("*"), s=F.sum("o_totalprice")).where("n > 14 and s > 1000000").select("o_custkey", "n")


@query("a15_expression_over_aggregates", "SELECT l_returnflag, round(100 * sum(l_discount) / sum(l_tax), 6) AS r FROM lineitem GROUP BY 1")
def _(t):
    return A.group(t.lineitem, ["l_returnflag"], r=F.round(S.divide(100 * F.sum("l_discount"), F.sum("l_tax")), 6))


@query("a16_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


_AGGS = {"s": Agg("sum", "l_quantity"), "n": Agg("count_star"), "k": Agg("count", "d"), "a": Agg("avg", "d"), "lo": Agg("min", "l_quantity"), "hi": Agg("max", "l_quantity")}
_TWO = "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, count(*) AS n, count(nullif(l_discount, 0.05)) AS k, round(avg(nullif(l_discount, 0.05)), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1"


def _rounded(df):
    return df.select("l_returnflag", F.round("s", 2).alias("s"), "n", "k", F.round("a", 6).alias("a"), "lo", "hi")


@query("a17_local_partial", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    states = A.local_aggregate(X.with_chunk(t.lineitem, 5000), ["l_returnflag"], {"n": Agg("count_star")}, "chunk")
    return states.groupBy("l_returnflag").agg(F.sum("n__n").alias("n"))


@query("a18_final_merge", _TWO)
def _(t):
    rows = X.with_chunk(t.lineitem, 5000).withColumn("d", F.nullif("l_discount", lit(0.05)))
    return _rounded(A.two_phase(rows, ["l_returnflag"], _AGGS, "chunk"))


@query("a18_salted", _TWO)
def _(t):
    return _rounded(A.salted(t.lineitem.withColumn("d", F.nullif("l_discount", lit(0.05))), ["l_returnflag"], _AGGS, 8))


@query("a19_concatenated_states", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
def _(t):
    aggs = {"n": Agg("count_star"), "s": Agg("sum", "o_totalprice")}
    parts = [A.local_aggregate(t.orders.where(f), ["o_orderstatus"], aggs) for f in ("o_totalprice < 100000", "o_totalprice >= 100000")]
    out = A.finalize(A.merge_states(parts[0].unionByName(parts[1]), ["o_orderstatus"], aggs), ["o_orderstatus"], aggs)
    return out.withColumn("s", F.round("s", 2))


@query("a20_dense_primitives", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s, count(*) AS n, CAST(min(n_nationkey) AS INTEGER) AS lo, CAST(max(n_nationkey) AS INTEGER) AS hi, avg(n_nationkey) AS m FROM nation GROUP BY 1")
def _(t):
    k = "n_nationkey"
    return A.group(t.nation, ["n_regionkey"], s=F.sum(k), n=F.count("*"), lo=F.min(k), hi=F.max(k), m=F.avg(k))


@query("a22_recipe_aggregates", "SELECT s_nationkey, count(DISTINCT s_name) AS d, round(avg(s_acctbal), 8) AS m FROM supplier GROUP BY 1")
def _(t):
    return A.group(t.supplier, ["s_nationkey"], d=F.countDistinct("s_name"), m=F.round(F.avg("s_acctbal"), 8))


@query("a23_scalar_aggregate", "SELECT round(0.2 * sum(s_acctbal), 4) AS s, max(s_acctbal) AS hi, min(s_acctbal) + 0.0 AS lo, round(avg(s_acctbal), 6) AS m FROM supplier WHERE s_suppkey >= 0")
def _(t):
    b = "s_acctbal"
    return A.group(t.supplier, [], s=F.round(0.2 * F.sum(b), 4), hi=F.max(b), lo=F.min(b) + 0.0, m=F.round(F.avg(b), 6))


@query("a24_grouped_scalar", "SELECT s_suppkey, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 8) AS m FROM supplier")
def _(t):
    means = A.group(t.supplier, ["s_nationkey"], m=F.round(F.avg("s_acctbal"), 8))
    return t.supplier.join(means, "s_nationkey").select("s_suppkey", "m")


@query("a25_batch_grouped_sum", "SELECT l_suppkey, round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1")
def _(t):
    return A.group(t.lineitem, ["l_suppkey"], **{f"sum_{k}": F.round(F.sum(k), 2) for k in ("l_quantity", "l_extendedprice")})


@query("a27_fused_aggregate", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1")
def _(t):
    rows = t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return A.group(rows, ["l_returnflag"], charge=F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))), 2))


@query("a29_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("a29_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a29_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(t):
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a29_filter_clause", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders, ["o_orderpriority"], f=F.count_if(c("o_orderstatus") == "F"), o=F.round(F.sum(F.when(c("o_orderstatus") == "O", c("o_totalprice"))), 2))


@query("a29_spread", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(quantile_cont(l_quantity, 0.5), 4) AS med, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(t):
    return A.group(t.lineitem, ["l_returnflag"], sd=F.round(F.stddev_samp("l_quantity"), 6), vp=F.round(F.var_pop("l_quantity"), 6), med=F.round(F.percentile("l_quantity", 0.5), 4), r=F.round(F.corr("l_quantity", "l_extendedprice"), 6))


@query("a29_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, quantile_disc(l_quantity, 0.5) AS mid,
       mode(l_linenumber) AS mode, round(skewness(l_quantity), 4) AS skew FROM lineitem GROUP BY 1""")
def _(t):
    n = F.count("*")
    return A.group(
        t.lineitem, ["l_returnflag"], p90=F.round(F.percentile("l_extendedprice", 0.9), 4), p25=F.round(F.percentile("l_extendedprice", 0.25), 4), mid=F.expr("percentile_disc(0.5) within group (order by l_quantity)"),
        mode=F.mode("l_linenumber"), skew=F.round(F.skewness("l_quantity") * F.sqrt(n * (n - 1)) / (n - 2), 4),
    )


@query("a29_approximate", "SELECT l_returnflag, true AS distinct_close, true AS median_close, true AS quartiles_close FROM lineitem GROUP BY 1")
def _(t):
    # sketches of bounded size; held against the exact answers within the errors that they promise
    p = "l_extendedprice"
    found = A.group(
        t.lineitem, ["l_returnflag"], d=F.approx_count_distinct("l_partkey", 0.02), exact=F.count_distinct("l_partkey"), n=F.count("*"), m=F.approx_percentile(p, 0.5, 1000), q=F.approx_percentile(p, [0.25, 0.75], 1000),
        lo=F.percentile(p, [0.49, 0.24, 0.74]), hi=F.percentile(p, [0.51, 0.26, 0.76]),
    )
    within = lambda x, i: (x >= F.floor(c("lo")[i])) & (x <= F.ceil(c("hi")[i]))
    return found.select("l_returnflag", (F.abs(c("d") - c("exact")) <= 0.08 * c("exact") + 1).alias("distinct_close"), within(c("m"), 0).alias("median_close"), (within(c("q")[0], 1) & within(c("q")[1], 2)).alias("quartiles_close"))


@query("a29_boolean_aggregates", "SELECT o_orderpriority, bool_and(o_totalprice > 900) AS every, bool_or(o_orderstatus = 'P') AS some, bit_xor(o_orderkey) AS x, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, count(DISTINCT (o_orderstatus, o_custkey)) AS pairs FROM orders GROUP BY 1")
def _(t):
    return A.group(t.orders, ["o_orderpriority"], every=F.bool_and(c("o_totalprice") > 900), some=F.bool_or(c("o_orderstatus") == "P"), x=F.bit_xor("o_orderkey"), dearest=F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")), pairs=F.count_distinct("o_orderstatus", "o_custkey"))


@query("a29_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    return A.group(t.nation, ["n_regionkey"], names=F.array_join(F.array_sort(F.collect_list("n_name")), ","))




@query("w01_window_appends", "SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation")
def _(t):
    return W.add(t.nation, W.over(["n_regionkey"]), n=F.count("*"))


@query("w02_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def _(t):
    return W.rank_columns(t.orders, ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"]).select("o_orderkey", "rn")


@query("w03_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rk FROM part")
def _(t):
    return W.rank_columns(t.part, ["p_brand"], [("p_size", "desc")]).select("p_partkey", "rk")


@query("w04_dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 30) NULLS LAST) AS dr FROM part")
def _(t):
    return W.rank_columns(t.part.withColumn("k", F.nullif("p_size", lit(30))), ["p_brand"], ["k"]).select("p_partkey", "dr")


@query("w05_whole_input", "SELECT s_suppkey, count(*) OVER () AS n, max(s_acctbal) OVER () AS hi, round(sum(s_acctbal) OVER (), 2) AS s FROM supplier")
def _(t):
    return W.whole(t.supplier.select("s_suppkey", "s_acctbal"), n=F.count("*"), hi=F.max("s_acctbal"), s=F.round(F.sum("s_acctbal"), 2)).drop("s_acctbal")


@query("w06_partition_aggregates", "SELECT c_custkey, round(sum(c_acctbal) OVER w, 2) AS s, round(avg(c_acctbal) OVER w, 8) AS m, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi, count(nullif(c_nationkey, 3)) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey)")
def _(t):
    b = "c_acctbal"
    df = W.add(t.customer, W.over(["c_mktsegment", "c_nationkey"]), s=F.sum(b), m=F.avg(b), lo=F.min(b), hi=F.max(b), n=F.count(F.nullif("c_nationkey", lit(3))))
    return df.select("c_custkey", F.round("s", 2).alias("s"), F.round("m", 8).alias("m"), "lo", "hi", "n")


@query("w07_count_star", "SELECT c_custkey, count(*) OVER (PARTITION BY nullif(c_mktsegment, 'BUILDING')) AS n FROM customer")
def _(t):
    return W.add(t.customer.withColumn("k", F.nullif("c_mktsegment", lit("BUILDING"))), W.over(["k"]), n=F.count("*")).select("c_custkey", "n")


@query("w08_multi_key_order", "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount ASC, l_partkey DESC) AS rk FROM lineitem")
def _(t):
    return W.rank_columns(t.lineitem, ["l_suppkey"], [("l_quantity", "desc"), "l_discount", ("l_partkey", "desc")]).select("l_orderkey", "l_linenumber", "l_partkey", "rk")


@query("w09_empty_input", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_totalprice < 0")
def _(t):
    return W.rank_columns(t.orders.where("o_totalprice < 0"), ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "rn")


@query("w10_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS s FROM orders")
def _(t):
    return W.add(t.orders, W.over(["o_custkey"], ["o_orderdate"]), s=F.sum("o_totalprice")).select("o_orderkey", F.round("s", 2).alias("s"))


@query("w11_rows_frame", "SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def _(t):
    return W.add(t.orders, W.over(["o_custkey"], ["o_orderkey"], rows=(-2, 1)), n=F.count("*"), hi=F.max("o_totalprice")).select("o_orderkey", "n", "hi")


@query("w11_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM part")
def _(t):
    return W.add(t.part, W.over(["p_brand"], ["p_size"], range_=(-2, 0)), n=F.count("*")).select("p_partkey", "n")


@query("w11_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(t):
    return W.add(t.orders, W.over(["o_custkey"], ["o_orderkey"]), before=F.lag("o_totalprice"), later=F.lead("o_totalprice", 2, -1.0)).select("o_orderkey", "before", "later")


@query("w11_first_last_nth", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS a, last_value(o_totalprice) OVER w AS z, nth_value(o_totalprice, 2) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t):
    w = W.over(["o_custkey"], ["o_orderkey"], rows=(Window.unboundedPreceding, Window.unboundedFollowing))
    return W.add(t.orders, w, a=F.first("o_totalprice"), z=F.last("o_totalprice"), b=F.nth_value("o_totalprice", 2)).select("o_orderkey", "a", "z", "b")


@query("w11_named_windows", "SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER (w ORDER BY o_orderkey), 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def _(t):
    t.orders.createOrReplaceTempView("orders_w11")
    return t.spark.sql("SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER v, 2) AS s FROM orders_w11 WINDOW w AS (PARTITION BY o_custkey), v AS (PARTITION BY o_custkey ORDER BY o_orderkey)")


@query("w11_exclude", "SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)")
def _(t):
    rows = W.add(t.orders, W.over(["o_custkey"], ["o_orderkey"], rows=(-2, 2)), n=F.count("*"), s=F.sum("o_totalprice"))
    n = c("n") - 1
    return rows.select("o_orderkey", n.alias("n"), F.when(n > 0, F.round(c("s") - c("o_totalprice"), 2)).alias("s"))


@query("w11_ntile_percent", "SELECT p_partkey, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)")
def _(t):
    df = W.add(t.part, W.over(["p_brand"], ["p_size", "p_partkey"]), q=F.ntile(4), pr=F.percent_rank(), cd=F.cume_dist())
    return df.select("p_partkey", c("q").cast("long").alias("q"), F.round("pr", 6).alias("pr"), F.round("cd", 6).alias("cd"))


def _chunked(t):
    return Pipeline(t.lineitem, 7000)


@query("b01_pulled_batches", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 4")
def _(t):
    # pulled chunk by chunk by the consumer, and made a table again
    pulled = [r for b in Pipeline(t.nation, 6).filter(c("n_nationkey") > 4).project("n_name", "n_regionkey").batches() for r in b]
    return X.from_rows(t.spark, pulled, "n_name string, n_regionkey int")


@query("b02_chunked_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
@query("b03_chunked_filter", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
@query("b08_scan_chunk_mode", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
def _(t):
    return _chunked(t).filter(c("l_quantity") > 48).project("l_orderkey", "l_quantity").run()


@query("b04_chunked_project", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(t):
    return _chunked(t).project("l_orderkey", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("net")).run()


@query("b05_chunked_sort", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.1")
def _(t):
    return _chunked(t).filter(c("l_discount") == 0.1).project("l_orderkey", "l_linenumber").sort("l_orderkey").run()


@query("b06_local_aggregate", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return _chunked(t).aggregate(["l_linestatus"], {"n": Agg("count_star")}).local().groupBy("l_linestatus").agg(F.sum("n__n").alias("n"))


@query("b07_pipeline", "SELECT l_returnflag, round(sum(net), 4) AS s FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_tax < 0.05) GROUP BY 1 ORDER BY 1")
def _(t):
    net = (c("l_extendedprice") * (1 - c("l_discount"))).alias("net")
    p = _chunked(t).filter(c("l_tax") < 0.05).project("l_returnflag", net).aggregate(["l_returnflag"], {"s": Agg("sum", "net")}).sort("l_returnflag")
    return p.run().withColumn("s", F.round("s", 4))


@query("b09_partition_mode", _TWO)
def _(t):
    return _rounded(Pipeline(t.lineitem.withColumn("d", F.nullif("l_discount", lit(0.05))).select("*", "_metadata"), 9000).aggregate(["l_returnflag"], _AGGS).run())


@query("b10_row_ranges", "SELECT CAST(i * 1000 AS BIGINT) AS a, CAST(least((i + 1) * 1000, (SELECT count(*) FROM part)) AS BIGINT) AS b FROM range(0, CAST(ceil((SELECT count(*) FROM part) / 1000) AS BIGINT)) r(i)")
def _(t):
    from tessel.plans.pipeline import count_rows

    return t.spark.createDataFrame(X.row_ranges(count_rows(t.part), 1000), "a long, b long")
