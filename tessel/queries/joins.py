"""Joins, subqueries, set operations and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import join as J
from tessel.operators import relational as R
from tessel.queries.registry import Registry
from tessel.sources import scan as X

query = Registry()
c, lit = F.col, F.lit

_INNER = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000"


@query("j01_inner_join", _INNER)
@query("j03_unique_build_join", _INNER)
@query("j17_join_output", _INNER)
def _(t):
    return J.equi_join(t.orders.where("o_totalprice > 200000"), t.customer, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@query("j02_typed_key_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON CAST(o_custkey AS DECIMAL(18,2)) = CAST(c_custkey AS DOUBLE) WHERE o_totalprice > 200000")
def _(t):
    # a decimal key against a double one: both sides come to one type before they are compared
    o = t.orders.where("o_totalprice > 200000").select("o_orderkey", c("o_custkey").cast("decimal(18,2)").alias("k"))
    return J.equi_join(o, t.customer.select(c("c_custkey").cast("double").alias("c"), "c_name"), {"k": "c"}).select("o_orderkey", "c_name")


@query("j20_batch_inner_join", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def _(t):
    # each Arrow batch is joined where it is with a table of fixed size
    met = J.equi_join(t.orders.where("o_totalprice > 200000"), t.customer, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_nationkey")
    return J.batch_join(met, t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey").select("o_orderkey", "n_name")


@query("j04_multi_key_join", "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2")
def _(t):
    a = t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_partkey", c("l_linenumber").alias("x"))
    b = t.lineitem.where("l_linenumber = 2").select(c("l_orderkey").alias("o"), c("l_partkey").alias("p"), c("l_quantity").alias("q"))
    return J.equi_join(a, b, {"l_orderkey": "o", "l_partkey": "p"}).select("l_orderkey", "x", "q")


@query("j05_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000")
def _(t):
    return J.equi_join(t.customer, t.orders.where("o_orderstatus = 'F' and o_totalprice > 250000"), {"c_custkey": "o_custkey"}, "left").select("c_custkey", "o_orderkey")


@query("j06_right_outer", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON o_custkey = c_custkey")
def _(t):
    return J.equi_join(t.orders.where("o_totalprice > 300000"), t.customer, {"o_custkey": "c_custkey"}, "right").select("o_orderkey", "c_custkey")


_SEMI = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"
_ANTI = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')"


@query("j07_left_semi", _SEMI)
def _(t):
    return J.equi_join(t.customer, t.orders.where("o_totalprice > 300000"), {"c_custkey": "o_custkey"}, "left_semi").select("c_custkey")


@query("j08_left_anti", _ANTI)
def _(t):
    return J.equi_join(t.customer, t.orders.where("o_orderdate >= timestamp_ntz'2000-06-01'"), {"c_custkey": "o_custkey"}, "left_anti").select("c_custkey")


@query("j09_right_semi", _SEMI)
def _(t):
    return J.right_semi(t.orders.where("o_totalprice > 300000"), t.customer, {"o_custkey": "c_custkey"}).select("c_custkey")


@query("j09_right_anti", _ANTI)
def _(t):
    return J.right_anti(t.orders.where("o_orderdate >= timestamp_ntz'2000-06-01'"), t.customer, {"o_custkey": "c_custkey"}).select("c_custkey")


@query("j10_mark_join", "SELECT c_custkey, c_custkey IN (SELECT nullif(o_custkey, 7) FROM orders WHERE o_totalprice > 300000) AS mark FROM customer")
def _(t):
    return J.mark_join(t.customer, t.orders.where("o_totalprice > 300000").select(F.nullif("o_custkey", lit(7)).alias("k")), "c_custkey", "k").select("c_custkey", "mark")


@query("j10_exists_in_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    t.customer.createOrReplaceTempView("customer")
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")


@query("j11_mark_literal_list", "SELECT n_nationkey, n_name IN ('NATION_1', 'NATION_2') OR n_regionkey = 3 AS mark FROM nation")
def _(t):
    return t.nation.select("n_nationkey", (c("n_name").isin("NATION_1", "NATION_2") | (c("n_regionkey") == 3)).alias("mark"))


@query("j12_delim_join", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_quantity > (SELECT 1.8 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
def _(t):
    mean = t.lineitem.groupBy("l_partkey").agg((1.8 * F.avg("l_quantity")).alias("m"))
    return t.lineitem.join(mean, "l_partkey").where("l_quantity > m").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j13_scalar_subquery_join", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT 1.9 * avg(o_totalprice) FROM orders)")
def _(t):
    return J.scalar_join(t.orders, t.orders.agg((1.9 * F.avg("o_totalprice")).alias("m")), "o_totalprice", ">=", "m").select("o_orderkey")


@query("j14_residual", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey")
def _(t):
    a = t.lineitem.select("l_orderkey", "l_suppkey")
    b = t.lineitem.select(c("l_orderkey").alias("o"), c("l_suppkey").alias("s"))
    return J.equi_join(a, b, {"l_orderkey": "o"}, residual=a["l_suppkey"] != b["s"]).agg(F.count("*").alias("n"))


@query("j15_null_safe_key", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 1)")
def _(t):
    a = t.nation.select(c("n_nationkey").alias("a"), F.nullif("n_regionkey", lit(1)).alias("x"))
    b = t.nation.select(c("n_nationkey").alias("b"), F.nullif("n_regionkey", lit(1)).alias("y"))
    return J.equi_join(a, b, {"x": "y"}, null_safe=True).select("a", "b")


@query("j15_null_keys_never_meet", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON nullif(a.n_regionkey, 1) = nullif(b.n_regionkey, 1)")
def _(t):
    a = t.nation.select(c("n_nationkey").alias("a"), F.nullif("n_regionkey", lit(1)).alias("x"))
    b = t.nation.select(c("n_nationkey").alias("b"), F.nullif("n_regionkey", lit(1)).alias("y"))
    return J.equi_join(a, b, {"x": "y"}).select("a", "b")


@query("j16_dummy_join", "SELECT r_name, x FROM region, (SELECT CAST(5 AS INTEGER) AS x)")
def _(t):
    return t.region.crossJoin(X.dummy(t.spark).select(lit(5).alias("x"))).select("r_name", "x")


@query("j18_shuffle_hash_join", _INNER)
def _(t):
    return J.equi_join(t.orders.where("o_totalprice > 200000"), t.customer.hint("shuffle_hash"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@query("j19_broadcast_join", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    # nation has 25 rows at any scale
    return J.equi_join(t.supplier, F.broadcast(t.nation), {"s_nationkey": "n_nationkey"}).select("s_name", "n_name")


@query("j21_lookup_join", "SELECT o_orderkey, coalesce(s_suppkey, -1) AS s FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey")
def _(t):
    dim = t.supplier.withColumn("s", c("s_suppkey"))
    return J.lookup(t.orders, dim, {"o_custkey": "s_suppkey"}, "s", -1).select("o_orderkey", "s")


@query("j22_composite_lookup", "SELECT l_orderkey, l_linenumber, coalesce(m, -1) AS m FROM lineitem LEFT JOIN (SELECT l_partkey AS p, l_suppkey AS s, max(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) ON l_partkey = p AND l_suppkey = s")
def _(t):
    dim = t.lineitem.where("l_returnflag = 'R'").groupBy(c("l_partkey").alias("p"), c("l_suppkey").alias("s")).agg(F.max("l_quantity").alias("m"))
    return J.lookup(t.lineitem, dim, {"l_partkey": "p", "l_suppkey": "s"}, "m", -1.0).select("l_orderkey", "l_linenumber", "m")


@query("j23_semi_anti_mask", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS semi FROM customer")
def _(t):
    return J.mark_join(t.customer, t.orders.where("o_totalprice > 300000"), "c_custkey", "o_custkey", "semi").select("c_custkey", "semi")


@query("j24_in_not_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_size NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(t):
    for n in ("part", "lineitem", "nation"):
        getattr(t, n).createOrReplaceTempView(n)
    return t.spark.sql("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_size NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")


@query("j24_not_in_with_null", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region WHERE r_regionkey < 2)")
def _(t):
    keys = t.region.where("r_regionkey < 2").select(F.nullif("r_regionkey", lit(1)).alias("k"))
    return J.mark_join(t.nation, keys, "n_regionkey", "k").where(~c("mark")).select("n_name")


@query("j25_self_join", "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
def _(t):
    a, b = t.nation.alias("n1"), t.nation.alias("n2")
    return a.join(b, (c("n1.n_regionkey") == c("n2.n_regionkey")) & (c("n1.n_nationkey") < c("n2.n_nationkey"))).select(c("n1.n_name").alias("a"), c("n2.n_name").alias("b"))


@query("j26_full_outer", "SELECT s_suppkey, o_custkey FROM supplier FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 250000) ON s_suppkey = o_custkey")
def _(t):
    return J.equi_join(t.supplier, t.orders.where("o_totalprice > 250000").select("o_custkey").distinct(), {"s_suppkey": "o_custkey"}, "full").select("s_suppkey", "o_custkey")


@query("j27_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    # both have a fixed number of rows at any scale
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("j27_range_join", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON p_retailprice BETWEEN o_totalprice / 100 - 1 AND o_totalprice / 100 + 1")
def _(t):
    r = t.orders.select("o_orderkey", (c("o_totalprice") / 100 - 1).alias("lo"), (c("o_totalprice") / 100 + 1).alias("hi"))
    return J.range_join(t.part.select("p_partkey", "p_retailprice"), r, "p_retailprice", "lo", "hi", 4).select("o_orderkey", "p_partkey")


@query("j27_positional_join", "SELECT o_orderkey, c_custkey FROM orders POSITIONAL JOIN customer")
def _(t):
    return J.positional_join(t.orders.select("o_orderkey"), t.customer.select("c_custkey"))


@query("j27_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 DAY")
def _(t):
    x = t.events.where("event_type = 'error'").select(c("event_id").alias("a"), c("user_id").alias("u"), c("ts").alias("at"))
    y = t.events.where("event_type = 'purchase'").select(c("event_id").alias("b"), "user_id", "ts")
    return J.equi_join(x, y, {"u": "user_id"}, residual=c("ts").between(c("at"), c("at") + F.expr("interval 2 days"))).select("a", "b")


_ASOF = "SELECT a.event_id, (SELECT max_by(b.value, (b.ts, b.value)) FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts <= a.ts) AS last_purchase FROM events a WHERE a.event_type = 'error'"


@query("j27_asof_join", _ASOF)
def _(t):
    left = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return J.asof_join(left, right, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("j27_asof_join_cells", _ASOF)
def _(t):
    left = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return J.asof_join(left, right, "user_id", "ts", "value", "last_purchase", cell=lambda at: F.date_trunc("month", at)).select("event_id", "last_purchase")


@query("u01_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def _(t):
    return R.union_all(t.nation.select(c("n_nationkey").alias("k")), t.region.select("r_regionkey"))


@query("u02_union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def _(t):
    return R.union(t.nation.select(c("n_regionkey").alias("k")), t.region.select("r_regionkey"))


@query("u03_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return R.intersect(t.customer.where("c_acctbal > 9000").select(c("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@query("u03_intersect_all", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT ALL SELECT s_nationkey FROM supplier")
def _(t):
    return R.intersect(t.customer.where("c_acctbal > 9000").select(c("c_nationkey").alias("k")), t.supplier.select("s_nationkey"), keep_all=True)


@query("u03_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return R.minus(t.nation.select(c("n_nationkey").alias("k")), t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("u03_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def _(t):
    return R.minus(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select("s_nationkey"), keep_all=True)


@query("u04_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n, count(*) AS customers FROM big GROUP BY n")
@query("u05_materialized_cte", "WITH big AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n, count(*) AS customers FROM big GROUP BY n")
def _(t):
    big = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return R.with_tables(t.orders, {"big_u04": big}, "SELECT n, count(*) AS customers FROM big_u04 GROUP BY n")


@query("u06_recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r")
def _(t):
    return t.spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r")


@query("u07_scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND p_size = (SELECT min(p_size) FROM part)")
def _(t):
    dear = J.scalar_join(t.part, t.part.agg(F.avg("p_retailprice").alias("m")), "p_retailprice", ">", "m")
    return J.scalar_join(dear, t.part.agg(F.min("p_size").alias("m")), "p_size", "=", "m").select("p_partkey")


@query("u08_correlated_scalar", "SELECT s_suppkey, (SELECT round(sum(l_extendedprice), 2) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS total FROM supplier")
def _(t):
    t.supplier.createOrReplaceTempView("supplier")
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql("SELECT s_suppkey, (SELECT round(sum(l_extendedprice), 2) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS total FROM supplier")


@query("u09_correlated_exists", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def _(t):
    early = t.orders.join(t.lineitem, (c("l_orderkey") == c("o_orderkey")) & (c("l_shipdate") < c("o_orderdate")), "left_semi")
    kept = early.join(t.lineitem.where("l_returnflag = 'R'"), c("l_orderkey") == c("o_orderkey"), "left_anti")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_SORT = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_custkey) AS place FROM customer QUALIFY place <= 40"


@query("o01_order_by", _SORT)
@query("o02_order_key_resolution", _SORT)
def _(t):
    # the order shows in the positions: the first forty, numbered
    from tessel.operators.window import add, over

    rows = R.top(t.customer.select("c_custkey", F.nullif("c_mktsegment", lit("BUILDING")).alias("seg")), 40, ("seg", "desc"), "c_custkey")
    return add(rows, over((), (("seg", "desc"), "c_custkey")), place=F.row_number()).withColumn("place", c("place").cast("long"))


@query("o03_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
@query("o04_top_k_single_key", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return R.top(t.orders.select("o_orderkey", "o_totalprice"), 25, ("o_totalprice", "desc"), "o_orderkey")


@query("o05_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
def _(t):
    return R.sort(t.orders.select("o_orderkey"), "o_orderkey").offset(30).limit(10)


@query("o06_top_values", "SELECT p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 12")
def _(t):
    return R.top_values(t.part, "p_retailprice", 12)


@query("o07_sort_limit_rows", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 6")
def _(t):
    return R.top(t.nation.select("n_name", "n_regionkey"), 6, ("n_regionkey", "desc"), "n_name")


@query("o08_batch_sort", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49")
def _(t):
    return R.sort_batches(t.lineitem.where("l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_quantity"), ("l_quantity", "desc"), "l_orderkey")


@query("o09_final_sort_by_keys", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
@query("o10_row_sort", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
def _(t):
    return R.sort(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "l_returnflag", "l_linestatus")
