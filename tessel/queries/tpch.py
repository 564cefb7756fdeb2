"""The 22 TPC-H query shapes on tables without partsupp and some columns.

Where a column is missing the nearest that is there takes its place, and parts
offered by suppliers are those of the order lines. ``{ts}`` is the timestamp literal's keyword, which Spark and DuckDB call differently.
"""

from __future__ import annotations

from tessel.session import register

_PS = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

_TEXT = {
    "tpch_q01": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= {ts} '2001-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q02": f"""
WITH {_PS}
SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part JOIN partsupp ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE p_size = 15 AND p_type LIKE '%O%' AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(q.ps_supplycost) FROM partsupp q JOIN supplier s2 ON s2.s_suppkey = q.ps_suppkey JOIN nation n2 ON s2.s_nationkey = n2.n_nationkey
                       JOIN region r2 ON n2.n_regionkey = r2.r_regionkey WHERE q.ps_partkey = p_partkey AND r2.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < {ts} '1998-03-15 00:00:00' AND l_shipdate > {ts} '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= {ts} '1996-07-01 00:00:00' AND o_orderdate < {ts} '1996-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= {ts} '1996-01-01 00:00:00' AND o_orderdate < {ts} '1997-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q06": """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= {ts} '1996-01-01 00:00:00' AND l_shipdate < {ts} '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN {ts} '1995-01-01 00:00:00' AND {ts} '1998-12-31 00:00:00') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN {ts} '1995-01-01 00:00:00' AND {ts} '1996-12-31 00:00:00') all_nations
GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""
WITH {_PS}
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey
       JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
  WHERE p_name LIKE '%blue%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(c_acctbal, 2) AS c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= {ts} '1996-10-01 00:00:00' AND o_orderdate < {ts} '1997-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
WITH {_PS},
value AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
SELECT ps_partkey, round(sum(v), 2) AS total FROM value GROUP BY ps_partkey HAVING sum(v) > (SELECT sum(v) * 0.001 FROM value) ORDER BY total DESC, ps_partkey""",
    "tpch_q12": """
SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN CAST(1 AS BIGINT) ELSE 0 END)::BIGINT AS high_line_count,
       sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN CAST(1 AS BIGINT) ELSE 0 END)::BIGINT AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate > o_orderdate AND l_shipdate >= {ts} '1996-01-01 00:00:00' AND l_shipdate < {ts} '1997-01-01 00:00:00'
GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1-%' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= {ts} '1996-09-01 00:00:00' AND l_shipdate < {ts} '1996-10-01 00:00:00'""",
    "tpch_q15": """
WITH revenue AS (
  SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total_revenue FROM lineitem
  WHERE l_shipdate >= {ts} '1996-01-01 00:00:00' AND l_shipdate < {ts} '1996-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
WITH {_PS}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#15' AND p_type NOT LIKE 'MED%' AND p_size IN (3, 9, 14, 19, 23, 26, 29, 30) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND p_size < 10 AND l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS sum_quantity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag IN ('A', 'R') AND ((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#14' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
    "tpch_q20": f"""
WITH {_PS}
SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name IN ('NATION_3', 'NATION_5', 'NATION_7') AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= {{ts}} '1996-01-01 00:00:00' AND l_shipdate < {{ts}} '1997-01-01 00:00:00'))
ORDER BY s_name, s_suppkey""",
    "tpch_q21": """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 JOIN orders o3 ON o3.o_orderkey = l3.l_orderkey
                  WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o3.o_orderdate + INTERVAL '60' DAY)
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT substring(c_name, 18, 1) AS cntrycode, c_acctbal FROM customer
  WHERE substring(c_name, 18, 1) IN ('1', '3', '5', '7', '9') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND substring(c_name, 18, 1) IN ('1', '3', '5', '7', '9'))
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= {ts} '2000-06-01 00:00:00')) custsale
GROUP BY cntrycode ORDER BY cntrycode""",
}

#: The same results where the plain text makes Spark read or group more than it needs: order lines are
#: cut down by part or supplier before they are grouped, and one pass over them answers what subqueries ask one by one.
_LEANER = {
    "tpch_q02": """
WITH offers AS (
  SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15 AND p_type LIKE '%O%')
    AND l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
  GROUP BY l_partkey, l_suppkey),
best AS (SELECT *, min(cost) OVER (PARTITION BY l_partkey) AS least FROM offers)
SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand
FROM best JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE cost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q09": """
WITH lines AS (
  SELECT l_orderkey, l_suppkey, l_extendedprice, l_discount, l_quantity, min(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) AS cost
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%blue%'))
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - cost * l_quantity AS amount
  FROM lines JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey) profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q11": """
WITH offers AS (
  SELECT l_partkey AS ps_partkey, min(l_extendedprice / l_quantity) * sum(l_quantity) AS v FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7') GROUP BY l_partkey, l_suppkey)
SELECT ps_partkey, round(sum(v), 2) AS total FROM offers GROUP BY ps_partkey HAVING sum(v) > (SELECT sum(v) * 0.001 FROM offers) ORDER BY total DESC, ps_partkey""",
    "tpch_q16": """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#15' AND p_type NOT LIKE 'MED%' AND p_size IN (3, 9, 14, 19, 23, 26, 29, 30) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q20": """
WITH enough AS (
  SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') GROUP BY l_partkey, l_suppkey
  HAVING sum(l_quantity) > 0.5 * sum(l_quantity) FILTER (WHERE l_shipdate >= {ts} '1996-01-01 00:00:00' AND l_shipdate < {ts} '1997-01-01 00:00:00'))
SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name IN ('NATION_3', 'NATION_5', 'NATION_7') AND s_suppkey IN (SELECT l_suppkey FROM enough) ORDER BY s_name, s_suppkey""",
    "tpch_q21": """
WITH lines AS (
  SELECT l_orderkey, l_suppkey, l_shipdate > o_orderdate + INTERVAL '60' DAY AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'),
blamed AS (
  SELECT min(l_suppkey) FILTER (WHERE late) AS s, count_if(late) AS n FROM lines GROUP BY l_orderkey
  HAVING min(l_suppkey) <> max(l_suppkey) AND min(l_suppkey) FILTER (WHERE late) = max(l_suppkey) FILTER (WHERE late))
SELECT s_name, sum(n) AS numwait FROM blamed JOIN supplier ON s_suppkey = s GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
}

SPARK_SQL = {n: s.replace("{ts}", "TIMESTAMP_NTZ") for n, s in (_TEXT | _LEANER).items()}
ORACLE_SQL = {n: s.replace("{ts}", "TIMESTAMP") for n, s in _TEXT.items()}


def _query(sql: str):
    def run(spark, folder):
        register(spark, folder)
        return spark.sql(sql)

    return run


QUERIES = {n: _query(s) for n, s in SPARK_SQL.items()}
