"""Scans, sources, projections, filters and scalar expressions. Row positions have no SQL oracle: DuckDB's file row order is its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import scalar as S
from tessel.operators import relational as R
from tessel.queries.registry import Registry
from tessel.sources import scan as X
from tessel.sources.files import read_files, write_files
from tessel.sources.shared import new_path
from tessel.sources.zones import read_model, zone_map

query = Registry()
c, lit = F.col, F.lit
ORDERS = "{0}/orders.parquet"


@query("sc01_seq_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def _(t):
    return X.scan(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"], [c("l_quantity") > 45, c("l_returnflag") == "R"])


@query("sc16_generic_fetch", "SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 3 OFFSET 1")
@query("sc14_recipe_scan", "SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 3 OFFSET 1")
@query("sc02_table_fetch", "SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 3 OFFSET 1")
def _(t):
    return t.nation.where("n_regionkey = 2").orderBy("n_nationkey").offset(1).limit(3).select("n_name")


@query("sc03_arrow_batches", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000")
def _(t):
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = t.orders.where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return X.map_batches(rows, lambda b: pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], names=["o_orderkey", "twice"]), "o_orderkey long, twice double")


@query("sc04_chunk_scan", "SELECT o_orderkey, CAST(floor((row_number() OVER () - 1) / 1000) AS BIGINT) AS chunk FROM orders")
def _(t):
    return X.with_chunk(t.orders.select("o_orderkey"), 1000)


@query("sc05_range_scan", "SELECT o_orderkey, o_totalprice FROM orders LIMIT 50 OFFSET 100")
def _(t):
    return X.scan(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey", "o_totalprice"], rows=(100, 150))


@query("sc06_count_scan", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("sc07_filtered_row_ids", "SELECT rowid FROM (SELECT row_number() OVER () - 1 AS rowid, o_orderstatus FROM orders) WHERE o_orderstatus = 'F'")
def _(t):
    return X.with_row_id(t.orders).where("o_orderstatus = 'F'").select("rowid")


@query("sc08_row_id", "SELECT o_orderkey, row_number() OVER () - 1 AS rowid FROM orders")
def _(t):
    return X.with_row_id(t.orders.select("o_orderkey"))


@query("sc09_dummy_scan", "SELECT CAST(1 AS INTEGER) AS one, 'a' AS letter")
def _(t):
    return X.dummy(t.spark).select(lit(1).alias("one"), lit("a").alias("letter"))


@query("sc10_literal_relation", "SELECT n_name FROM nation WHERE n_nationkey IN (VALUES (1), (3), (99))")
def _(t):
    return t.nation.join(X.literals(t.spark, "k", [1, 3, 99]), c("n_nationkey") == c("k"), "left_semi").select("n_name")


@query("sc11_empty_result", "SELECT n_name FROM nation WHERE 1 = 0")
def _(t):
    return X.empty_like(t.nation.select("n_name"))


@query("sc12_delim_scan", "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
def _(t):
    n = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", F.coalesce("n", lit(0)).alias("n"))


@query("sc13_cte_scan", "WITH s AS (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey) SELECT k FROM s WHERE q = (SELECT max(q) FROM s)")
def _(t):
    t.lineitem.createOrReplaceTempView("li_sc13")
    return t.spark.sql("WITH s AS (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS q FROM li_sc13 GROUP BY l_suppkey) SELECT k FROM s WHERE q = (SELECT max(q) FROM s)")


@query("sc15_typed_fetch", "SELECT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS day, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(S.day_number(c("o_orderdate")).alias("day")).agg(F.count("*").alias("n"))


@query("sc17_resident_table", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1")
def _(t):
    df = X.resident(t.lineitem.select("l_returnflag", "l_linestatus"), "lineitem flags")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n")).union(df.groupBy("l_linestatus").agg(F.count("*").alias("n")))


@query("sc18_tables_of_rows", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, NULL)) v(id, name)")
def _(t):
    return X.from_columns(t.spark, {"id": [1, 2], "name": ["x", None]})


@query("sc20_query_sources", "SELECT r_name FROM region WHERE r_regionkey < 2")
def _(t):
    from tessel.plans.runner import run

    t.region.createOrReplaceTempView("region")
    return run(t.spark, sql="SELECT r_name FROM region WHERE r_regionkey < 2")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS priority FROM orders"


def _reread(t, kind, **options):
    """The orders written as files of a kind and read again by their schema."""
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.nullif("o_orderpriority", lit("5-LOW")).alias("priority"))
    path = new_path(t.spark, kind)
    write_files(df, path, kind, **options)
    return read_files(t.spark, path, kind, None if kind in ("orc", "parquet") else df.schema, **options)


@query("sc25_csv_files", _ORDERS)
def _(t):
    return _reread(t, "csv", header=True, compression="gzip")


@query("sc25_json_files", _ORDERS)
def _(t):
    return _reread(t, "json")


@query("sc25_orc_files", _ORDERS)
def _(t):
    return _reread(t, "orc")


@query("sc25_parquet_files", _ORDERS + " WHERE o_orderkey > 500")
def _(t):
    return _reread(t, "parquet").where("o_orderkey > 500")


@query("sc25_text_lines", "SELECT r_name AS value FROM region")
def _(t):
    path = new_path(t.spark, "text")
    write_files(t.region.select("r_name"), path, "text")
    return read_files(t.spark, path, "text")


@query("sc25_broken_lines", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_name END AS r_name, r_regionkey = 2 AS broken FROM region")
def _(t):
    # a line that does not fit the schema gives nulls and is told apart
    path = new_path(t.spark, "broken")
    line = F.when(c("r_regionkey") == 2, lit('{"r_regionkey": 2, "r_name"')).otherwise(F.to_json(F.struct("r_regionkey", "r_name")))
    write_files(t.region.select(line.alias("value")), path, "text")
    rows = read_files(t.spark, path, "json", "r_regionkey int, r_name string, _corrupt_record string")
    return rows.select(F.coalesce("r_regionkey", F.regexp_extract("_corrupt_record", "([0-9]+)", 1).cast("int")).alias("r_regionkey"), "r_name", c("_corrupt_record").isNotNull().alias("broken"))


@query("sc26_selectivity", "SELECT count(*) AS rows, count(*) FILTER (l_discount >= 0.05 AND l_quantity < 24) AS selected, round(count(*) FILTER (l_discount >= 0.05 AND l_quantity < 24) / count(*), 6) AS share FROM lineitem")
def _(t):
    return X.selectivity(t.lineitem, (c("l_discount") >= 0.05) & (c("l_quantity") < 24)).withColumn("share", F.round("share", 6))


_ZONES = "SELECT CAST(floor((row_number() OVER () - 1) / 500) AS BIGINT) AS zone, * FROM orders"


@query("sc27_zone_map", f"SELECT zone, count(*) AS rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM ({_ZONES}) GROUP BY zone")
def _(t):
    return zone_map(t.orders.select("o_orderkey", "o_totalprice", "_metadata"), ["o_orderkey", "o_totalprice"], 500)


@query("sc27_zones_read", f"""SELECT count(*) AS zones, count(*) FILTER (hit) AS zones_read, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS rows_read,
       CAST(coalesce(sum(n) FILTER (hit), 0) AS DOUBLE) / (SELECT nullif(count(*), 0) FROM orders WHERE o_orderkey BETWEEN 300 AND 700) AS amplification
       FROM (SELECT count(*) AS n, max(o_orderkey) >= 300 AND min(o_orderkey) <= 700 AS hit FROM ({_ZONES}) GROUP BY zone)""")
def _(t):
    zones = zone_map(t.orders.select("o_orderkey", "_metadata"), ["o_orderkey"], 500)
    return read_model(zones, {"o_orderkey": (300, 700)}, t.orders.where("o_orderkey between 300 and 700").count())


@query("pf01_projection", "SELECT o_orderkey, o_totalprice * 0.5 AS half, o_orderstatus || '-' || o_orderpriority AS tag FROM orders")
def _(t):
    return R.project(t.orders, o_orderkey=c("o_orderkey"), half=c("o_totalprice") * 0.5, tag=F.concat("o_orderstatus", lit("-"), "o_orderpriority"))


@query("pf02_literals", "SELECT n_nationkey, CAST(7 AS INTEGER) AS i, CAST(1.5 AS DOUBLE) AS d, true AS b, 'text' AS s FROM nation")
def _(t):
    return R.project(t.nation, n_nationkey=c("n_nationkey"), i=7, d=1.5, b=True, s="text")


@query("pf03_filter_unknown_drops", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY'")
def _(t):
    return t.customer.where(F.nullif("c_mktsegment", lit("BUILDING")) != "MACHINERY").select("c_custkey")


@query("pf04_pushed_filters", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_totalprice < 50000 AND o_orderstatus = 'O'")
def _(t):
    return X.scan(t.spark, f"{t.folder}/orders.parquet", ["o_orderkey"], [c("o_orderkey") > 100, c("o_totalprice") < 50000, c("o_orderstatus") == "O"])


@query("pf05_rename_trim", "SELECT r_regionkey AS id FROM region")
def _(t):
    return R.rename(t.region, ["id"])


@query("pf06_comparisons", "SELECT o_orderkey, o_totalprice > 100000 AS gt, o_totalprice >= 100000 AS ge, o_totalprice < 100000 AS lt, o_totalprice <= 100000 AS le, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS ne, o_orderdate >= TIMESTAMP '1998-01-01' AS d FROM orders")
def _(t):
    p, s = c("o_totalprice"), c("o_orderstatus")
    return t.orders.select("o_orderkey", (p > 100000).alias("gt"), (p >= 100000).alias("ge"), (p < 100000).alias("lt"), (p <= 100000).alias("le"), (s == "F").alias("eq"), (s != "F").alias("ne"), F.expr("o_orderdate >= timestamp_ntz'1998-01-01'").alias("d"))


@query("pf07_string_order", "SELECT c_custkey FROM customer WHERE c_mktsegment > 'C' AND c_mktsegment <= 'HOUSEHOLD'")
def _(t):
    return t.customer.where((c("c_mktsegment") > "C") & (c("c_mktsegment") <= "HOUSEHOLD")).select("c_custkey")


_KLEENE = "SELECT n_nationkey, (nullif(n_regionkey, 1) = 2 AND n_nationkey > 10) AS a, (nullif(n_regionkey, 1) = 2 OR n_nationkey > 10) AS o, NOT (nullif(n_regionkey, 1) = 2) AS n FROM nation"


@query("pf08_kleene_and_or", _KLEENE)
@query("pf09_not", _KLEENE)
def _(t):
    x, y = F.nullif("n_regionkey", lit(1)) == 2, c("n_nationkey") > 10
    return t.nation.select("n_nationkey", (x & y).alias("a"), (x | y).alias("o"), (~x).alias("n"))


@query("pf10_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND nullif(p_brand, 'Brand#3') IN ('Brand#1', 'Brand#2', 'Brand#3')")
def _(t):
    return t.part.where(S.member(c("p_size"), [1, 5, 9]) & S.member(F.nullif("p_brand", lit("Brand#3")), ["Brand#1", "Brand#2", "Brand#3"])).select("p_partkey")


@query("pf11_like", r"SELECT p_partkey, p_name LIKE '%bl_e%' AS a, p_name NOT LIKE 'red%' AS b, p_name LIKE '%\%' AS e FROM part")
def _(t):
    return t.part.select("p_partkey", S.like(c("p_name"), "%bl_e%").alias("a"), (~S.like(c("p_name"), "red%")).alias("b"), S.like(c("p_name"), "%\\%").alias("e"))


@query("pf12_prefix_suffix_contains", "SELECT p_partkey, starts_with(p_name, 'blue') AS p, suffix(p_name, 'bolt') AS s, contains(p_name, 'e b') AS k FROM part")
def _(t):
    return t.part.select("p_partkey", c("p_name").startswith("blue").alias("p"), c("p_name").endswith("bolt").alias("s"), c("p_name").contains("e b").alias("k"))


@query("pf13_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 10 AND 11")
def _(t):
    return t.lineitem.where(c("l_discount").between(0.05, 0.07) & c("l_quantity").between(10, 11)).select("l_orderkey", "l_linenumber")


@query("pf14_or_of_equalities", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 7 OR p_size = 12")
def _(t):
    return t.part.where(S.any_of([c("p_size") == k for k in (1, 7, 12)])).select("p_partkey")


@query("pf15_membership", "SELECT count(*) FILTER (p_size IN (3, 4)) AS two, count(*) FILTER (p_size = 3) AS one, CAST(0 AS BIGINT) AS none FROM part")
def _(t):
    return t.part.agg(*(F.count_if(S.member(c("p_size"), v)).alias(n) for n, v in (("two", [3, 4]), ("one", [3]), ("none", []))))


@query("pf16_symmetric_filter", "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey WHERE (n1.n_nationkey = 1 AND n2.n_nationkey = 6) OR (n1.n_nationkey = 6 AND n2.n_nationkey = 1) OR n1.n_nationkey = n2.n_nationkey")
def _(t):
    x, y = t.nation.alias("n1"), t.nation.alias("n2")
    met = x.join(y, c("n1.n_regionkey") == c("n2.n_regionkey"))
    a, b = c("n1.n_nationkey"), c("n2.n_nationkey")
    return met.where(((a == 1) & (b == 6)) | ((a == 6) & (b == 1)) | (a == b)).select(c("n1.n_name").alias("a"), c("n2.n_name").alias("b"))


@query("pf17_all_any", "SELECT count(*) FILTER (p_size > 5 AND p_size < 20 AND p_retailprice > 1000) AS every, count(*) FILTER (p_size < 3 OR p_size > 28 OR p_retailprice > 1900) AS some FROM part")
def _(t):
    s, r = c("p_size"), c("p_retailprice")
    return t.part.agg(F.count_if(S.all_of([s > 5, s < 20, r > 1000])).alias("every"), F.count_if(S.any_of([s < 3, s > 28, r > 1900])).alias("some"))


@query("pf18_gather_by_mask", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
@query("pf19_recipe_filter", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def _(t):
    return t.supplier.where("s_acctbal < 0").select("s_suppkey")


@query("pf20_filter_tree", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND NOT o_orderpriority LIKE '1%') OR (o_totalprice > 300000 AND o_orderpriority IN ('5-LOW', '2-HIGH'))")
def _(t):
    p = c("o_orderpriority")
    return t.orders.where(((c("o_orderstatus") == "F") & ~p.like("1%")) | ((c("o_totalprice") > 300000) & p.isin("5-LOW", "2-HIGH"))).select("o_orderkey")


@query("pf21_batch_filter_project", "SELECT l_orderkey, l_quantity + 1 AS q FROM lineitem WHERE l_quantity > 40")
def _(t):
    import pyarrow as pa
    import pyarrow.compute as pc

    def step(b):
        b = b.filter(pc.greater(b.column(1), 40.0))
        return pa.RecordBatch.from_arrays([b.column(0), pc.add(b.column(1), 1.0)], names=["l_orderkey", "q"])

    return X.map_batches(t.lineitem.select("l_orderkey", "l_quantity"), step, "l_orderkey long, q double")


@query("pf22_projection_dag", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) + 2 * 3 AS gross FROM lineitem")
def _(t):
    net = c("l_extendedprice") * (1 - c("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", net.alias("net"), (net * (1 + c("l_tax")) + lit(2) * 3).alias("gross"))


@query("f01_literals", "SELECT CAST(1 AS INTEGER) AS i, CAST(1.25 AS DECIMAL(10,2)) AS d, true AS b, 'it''s' AS s, DATE '1998-09-02' AS day, CAST(NULL AS INTEGER) AS nothing")
def _(t):
    return X.dummy(t.spark).select(lit(1).alias("i"), F.expr("cast(1.25 as decimal(10,2))").alias("d"), lit(True).alias("b"), lit("it's").alias("s"), F.expr("date'1998-09-02'").alias("day"), lit(None).cast("int").alias("nothing"))


@query("f02_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS s, p_size * 2 AS m, p_size / 4 AS q, p_size / nullif(p_size - 5, 0) AS z FROM part")
def _(t):
    s = c("p_size")
    return t.part.select("p_partkey", (s + 1).alias("a"), (s - 1).alias("s"), (s * 2).alias("m"), (s / 4).alias("q"), S.divide(s, s - 5).alias("z"))


@query("f03_decimal_arithmetic", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) + CAST(l_tax AS DECIMAL(15,4)) AS DECIMAL(20,4)) AS a, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(19,4)) AS m, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) / CAST(CAST(l_quantity AS DECIMAL(15,2)) AS DOUBLE) AS q FROM lineitem")
def _(t):
    e = S.decimal(c("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (e + S.decimal(c("l_tax"), 15, 4)).cast("decimal(20,4)").alias("a"), (e * S.decimal(c("l_discount"), 4, 2)).cast("decimal(19,4)").alias("m"), S.divide(e, S.decimal(c("l_quantity"))).alias("q"))


@query("f04_case", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CASE WHEN nullif(o_orderstatus, 'F') = 'O' THEN 1 END AS open FROM orders")
def _(t):
    p = c("o_totalprice")
    return t.orders.select("o_orderkey", S.case([(p < 50000, lit("low")), (p < 150000, lit("mid"))], lit("high")).alias("band"), S.simple_case(c("o_orderstatus"), [("F", 1), ("O", 2)], 0).alias("code"), S.case([(F.nullif("o_orderstatus", lit("F")) == "O", lit(1))]).alias("open"))


@query("f05_case_decimal", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) ELSE CAST(0.125 AS DECIMAL(5,3)) END AS DECIMAL(16,3)) AS v FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.case([(c("o_orderstatus") == "F", S.decimal(c("o_totalprice")))], S.decimal(lit(0.125), 5, 3)).cast("decimal(16,3)").alias("v"))


@query("f06_cast", "SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS d, CAST('12' AS BIGINT) AS n FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c("o_orderkey").cast("int").alias("i"), c("o_orderkey").cast("string").alias("s"), c("o_orderdate").cast("date").alias("d"), lit("12").cast("long").alias("n"))


@query("f07_extract_year", "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(S.year_of(c("o_orderdate")).alias("y")).agg(F.count("*").alias("n"))


@query("f08_iso_dates", "SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS number FROM lineitem")
def _(t):
    return t.lineitem.select(S.iso_date(c("l_shipdate")).alias("day"), S.day_number(c("l_shipdate")).alias("number")).distinct()


@query("f09_substring", "SELECT c_custkey, substring(c_name, 10, 9) AS digits, substring(c_name FROM 1 FOR 3) AS head FROM customer")
def _(t):
    return t.customer.select("c_custkey", S.text_between(c("c_name"), 10, 9).alias("digits"), S.text_between(c("c_name"), 1, 3).alias("head"))


@query("f10_prefix_suffix", "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'B') OR suffix(c_name, '7')")
def _(t):
    return t.customer.where(c("c_mktsegment").startswith("B") | c("c_name").endswith("7")).select("c_custkey")


@query("f11_like", "SELECT s_suppkey FROM supplier WHERE s_name LIKE '%_1_' AND s_name NOT LIKE '%11%'")
@query("f17_like_subset", "SELECT s_suppkey FROM supplier WHERE s_name LIKE '%_1_' AND s_name NOT LIKE '%11%'")
def _(t):
    return t.supplier.where(S.like(c("s_name"), "%_1_") & ~S.like(c("s_name"), "%11%")).select("s_suppkey")


@query("f12_constant_or_null", "SELECT n_nationkey, constant_or_null(7, nullif(n_regionkey, 1), n_name) AS v FROM nation")
def _(t):
    return t.nation.select("n_nationkey", S.constant_or_null(lit(7), F.nullif("n_regionkey", lit(1)), c("n_name")).alias("v"))


@query("f14_ordinal", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")


@query("f18_column_times_constant", "SELECT p_partkey, p_retailprice * 2 AS v FROM part")
def _(t):
    return t.part.select("p_partkey", (c("p_retailprice") * 2).alias("v"))


@query("f15_error_guard", "SELECT r_regionkey AS k FROM region")
def _(t):
    return t.region.select(S.guard(c("r_regionkey") >= 0, c("r_regionkey"), "negative key").alias("k"))


@query("f16_string_predicates", "SELECT p_partkey, p_brand = 'Brand#1' AS eq, p_brand <> 'Brand#1' AS ne, p_brand IN ('Brand#1', 'Brand#2') AS i, p_name NOT LIKE '%special%requests%' AS n FROM part")
def _(t):
    return t.part.select("p_partkey", (c("p_brand") == "Brand#1").alias("eq"), (c("p_brand") != "Brand#1").alias("ne"), c("p_brand").isin("Brand#1", "Brand#2").alias("i"), (~c("p_name").like("%special%requests%")).alias("n"))


@query("f19_modulo_is_null", "SELECT o_orderkey, o_orderkey % 7 AS m, nullif(o_orderstatus, 'F') IS NULL AS a, nullif(o_orderstatus, 'F') IS NOT NULL AS b FROM orders")
def _(t):
    x = F.nullif("o_orderstatus", lit("F"))
    return t.orders.select("o_orderkey", (c("o_orderkey") % 7).alias("m"), x.isNull().alias("a"), x.isNotNull().alias("b"))


@query("f20_other_functions", "SELECT event_id, upper(event_type) AS u, length(event_type) AS n, reverse(event_type) AS r, regexp_replace(event_type, '[aeiou]', '*', 'g') AS x, CAST(floor(value) AS BIGINT) AS f, abs(value) AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_sum([event_id, 1])::BIGINT AS s FROM events")
def _(t):
    e = c("event_type")
    return t.events.select("event_id", F.upper(e).alias("u"), F.char_length(e).cast("long").alias("n"), F.reverse(e).alias("r"), F.regexp_replace(e, "[aeiou]", "*").alias("x"), F.floor("value").cast("long").alias("f"), F.abs("value").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.aggregate(F.array("event_id", lit(1).cast("long")), lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@query("f20_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing,
       to_json({'id': event_id, 'kind': event_type}) AS packed FROM events""")
def _(t):
    fields = F.from_json("props", "k long, none string")
    return t.events.select("event_id", fields["k"].alias("k"), fields["none"].alias("missing"), F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("kind"))).alias("packed"))


@query("f20_arrays", """SELECT o_custkey, len(x) AS n, x[1] AS first, list_contains(x, 'F') AS has, array_to_string(list_sort(list_distinct(x)), '') AS kinds,
       len(list_filter(x, lambda s: s = 'O')) AS open, array_to_string(list_transform(list_sort(x), lambda s: lower(s)), '') AS low, array_to_string(list_slice(list_sort(x), 1, 3), '') AS head
       FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS x FROM orders GROUP BY 1)""")
def _(t):
    pairs = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    x = c("x")
    rows = t.orders.groupBy("o_custkey").agg(F.transform(pairs, lambda p: p["o_orderstatus"]).alias("x"))
    return rows.select(
        "o_custkey", F.size(x).cast("long").alias("n"), F.element_at(x, 1).alias("first"), F.array_contains(x, "F").alias("has"), F.array_join(F.array_sort(F.array_distinct(x)), "").alias("kinds"),
        F.size(F.filter(x, lambda s: s == "O")).cast("long").alias("open"), F.array_join(F.transform(F.array_sort(x), F.lower), "").alias("low"), F.array_join(F.slice(F.array_sort(x), 1, 3), "").alias("head"),
    )


@query("f20_unnest", "SELECT n_regionkey, unnest(names) AS name FROM (SELECT n_regionkey, list(n_name) AS names FROM nation GROUP BY 1)")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).select("n_regionkey", F.explode("names").alias("name"))


@query("f20_maps", """SELECT r_regionkey, m['a'] AS a, m['none'] AS missing, len(map_keys(m)) AS n, array_to_string(list_sort(map_keys(m)), ',') AS keys
       FROM (SELECT r_regionkey, MAP {'a': r_name, 'b': upper(r_name)} AS m FROM region)""")
def _(t):
    m = c("m")
    rows = t.region.select("r_regionkey", F.create_map(lit("a"), "r_name", lit("b"), F.upper("r_name")).alias("m"))
    return rows.select("r_regionkey", F.try_element_at(m, lit("a")).alias("a"), F.try_element_at(m, lit("none")).alias("missing"), F.size(F.map_keys(m)).cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"))


@query("f20_intervals", """SELECT o_orderkey, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS later, CAST(o_orderdate - INTERVAL 40 DAY AS DATE) AS before, o_orderdate + INTERVAL 90 MINUTE AS soon,
       date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
       CAST(dayofweek(o_orderdate) AS BIGINT) AS weekday, last_day(CAST(o_orderdate AS DATE)) AS last, strftime(o_orderdate, '%d/%m/%Y') AS said FROM orders""")
def _(t):
    d = c("o_orderdate")
    return t.orders.select(
        "o_orderkey", (d + F.expr("interval 3 months")).cast("date").alias("later"), (d - F.expr("interval 40 days")).cast("date").alias("before"), (d + F.expr("interval 90 minutes")).alias("soon"),
        F.datediff(d.cast("date"), F.expr("date'1995-01-01'")).cast("long").alias("days"), F.trunc(d.cast("date"), "month").alias("month"), F.trunc(d.cast("date"), "quarter").alias("quarter"),
        (F.dayofweek(d) - 1).cast("long").alias("weekday"), F.last_day(d.cast("date")).alias("last"), F.date_format(d, "dd/MM/yyyy").alias("said"),
    )


@query("f20_math", """SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_quantity), 6) AS ln, round(power(l_discount, 2), 8) AS square, sign(l_tax - 0.04) AS side,
       CAST(ceil(l_extendedprice) AS BIGINT) AS up, greatest(l_tax, l_discount) AS most, least(l_tax, l_discount) AS least FROM lineitem""")
def _(t):
    side = F.when(c("l_tax") - 0.04 > 0, 1).when(c("l_tax") - 0.04 < 0, -1).otherwise(0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.round(F.log("l_quantity"), 6).alias("ln"), F.round(F.pow("l_discount", lit(2)), 8).alias("square"), side.alias("side"), F.ceil("l_extendedprice").alias("up"), F.greatest("l_tax", "l_discount").alias("most"), F.least("l_tax", "l_discount").alias("least"))


@query("f20_strings", """SELECT c_custkey, split_part(c_name, '#', 2) AS digits, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, position('#' IN c_name) AS at, replace(c_mktsegment, 'BUILD', 'Re') AS swapped,
       trim('  ' || c_mktsegment || ' ') AS bare, c_mktsegment || ':' || c_custkey AS tag, regexp_extract(c_name, '([0-9]+)', 1) AS number, repeat('ab', 2) AS twice, md5(c_name) AS digest FROM customer""")
def _(t):
    n, m = c("c_name"), c("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.split_part(n, lit("#"), lit(2)).alias("digits"), F.lpad(c("c_nationkey").cast("string"), 4, "0").alias("padded"), F.instr(n, "#").cast("long").alias("at"), F.replace(m, lit("BUILD"), lit("Re")).alias("swapped"),
        F.trim(F.concat(lit("  "), m, lit(" "))).alias("bare"), F.concat(m, lit(":"), c("c_custkey").cast("string")).alias("tag"), F.regexp_extract(n, "([0-9]+)", 1).alias("number"), F.repeat(lit("ab"), 2).alias("twice"), F.md5(n).alias("digest"),
    )
