"""Operators on small tables: nulls, ties, duplicates, empty input, and refusals."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError
from tessel.functions import scalar as S
from tessel.operators import aggregate as A
from tessel.operators import join as J
from tessel.operators import masks as M
from tessel.operators import relational as R
from tessel.operators import window as W
from tessel.operators.aggregate import Agg
from tessel.plans.pipeline import Pipeline
from tessel.sources import scan as X
from tessel.sources import sinks
from tessel.sources.files import read_files, write_files

c = F.col


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def pair(spark):
    t = spark.createDataFrame([(1, 10, 1.5), (2, 10, 2.5), (3, 20, 3.0), (4, None, 4.0)], "a int, id int, amount double")
    u = spark.createDataFrame([(10, "x"), (20, "y"), (20, "z"), (None, "n")], "uid int, name string")
    return t, u


def test_join_kinds(pair):
    t, u = pair
    join = lambda how, **kw: rows(J.equi_join(t, u, {"id": "uid"}, how, **kw).select(*(["a", "name"] if how[:5] != "left_" else ["a"])))
    inner = [(1, "x"), (2, "x"), (3, "y"), (3, "z")]
    assert join("inner") == inner
    assert join("left") == sorted([*inner, (4, None)], key=str)
    assert join("right") == sorted([*inner, (None, "n")], key=str)
    assert join("full") == sorted([*inner, (4, None), (None, "n")], key=str)
    assert join("left_semi") == [(1,), (2,), (3,)] and join("left_anti") == [(4,)]
    assert join("inner", null_safe=True) == sorted([*inner, (4, "n")], key=str)
    assert join("inner", residual=u["name"] != "y") == [(1, "x"), (2, "x"), (3, "z")]
    with pytest.raises(UnsupportedPlanError):
        J.equi_join(t, u, {"id": "uid"}, "cross")
    with pytest.raises(UnsupportedPlanError):
        J.equi_join(t, u, {})


def test_decimal_and_fractional_keys_are_not_cut(spark):
    a = spark.sql("SELECT cast(1.25 AS double) AS k UNION ALL SELECT 1.75D")
    b = spark.sql("SELECT cast(1.250 AS decimal(6,3)) AS j UNION ALL SELECT cast(1.5 AS decimal(6,3))")
    assert rows(J.equi_join(a, b, {"k": "j"}).select("k")) == [(1.25,)]


@pytest.mark.parametrize(("values", "want"), [([10, None], [True, True, None, None]), ([10], [True, True, False, None]), ([], [False] * 4)])
def test_mark_join_is_three_valued(spark, pair, values, want):
    keys = spark.createDataFrame([(v,) for v in values], "k int")
    assert [r[1] for r in rows(J.mark_join(pair[0], keys, "id", "k").select("a", "mark"))] == want


def test_scalar_join(spark, pair):
    t, _ = pair
    one = spark.createDataFrame([(2.0,)], "m double")
    assert rows(J.scalar_join(t, one, "amount", ">", "m").select("a")) == [(2,), (3,), (4,)]
    assert J.scalar_join(t, one.where("m > 9"), "amount", ">", "m").count() == 0
    with pytest.raises(Exception, match="more than one row"):
        J.scalar_join(t, one.union(one), "amount", ">", "m").collect()
    with pytest.raises(UnsupportedPlanError):
        J.scalar_join(t, one, "amount", "~", "m")


def test_lookup_misses(pair, spark):
    t, _ = pair
    dim = spark.createDataFrame([(10, 7)], "k int, v int")
    assert [r[3] for r in rows(J.lookup(t, dim, {"id": "k"}, "v", -1))] == [7, 7, -1, -1]


def test_range_and_asof_join(spark):
    rng = random.Random(1)
    p = [(i, rng.randrange(100)) for i in range(60)]
    q = [(i, x, x + rng.randrange(-2, 30)) for i in range(40) for x in [rng.randrange(100)]]
    got = rows(J.range_join(spark.createDataFrame(p, "p int, x int"), spark.createDataFrame(q, "q int, lo int, hi int"), "x", "lo", "hi", 7).select("p", "q"))
    assert got == sorted(((i, j) for i, x in p for j, lo, hi in q if lo <= x <= hi), key=str)
    left = [(i, rng.randrange(4), rng.randrange(50)) for i in range(60)]
    right = [(rng.randrange(4), rng.randrange(50), rng.randrange(1000)) for _ in range(60)]
    got = dict(rows(J.asof_join(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", "v", "last").select("i", "last")))
    assert got == {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(0, None))[1] for i, k, t in left}


def test_kleene_logic(spark):
    row = spark.sql("SELECT cast(null AS boolean) AS u").select(
        S.any_of([c("u"), F.lit(True)]), S.any_of([c("u"), F.lit(False)]), S.all_of([c("u"), F.lit(True)]), S.all_of([c("u"), F.lit(False)]), ~c("u"), S.case([(c("u"), F.lit(1))], F.lit(2)), S.member(c("u"), [])
    ).first()
    assert tuple(row) == (True, None, None, False, None, 2, False)
    for f in (S.all_of, S.any_of, S.case):
        with pytest.raises(UnsupportedPlanError):
            f([])


def test_scalars(spark):
    df = spark.sql("SELECT 7 AS i, 0 AS z, date'1998-09-02' AS d, 'a\\\\b' AS s, cast(0.1 AS decimal(4,2)) AS x")
    got = df.select(S.divide(c("i"), c("z")), S.divide(c("i"), F.lit(2)), S.year_of(c("d")), S.iso_date(c("d")), S.day_number(c("d")), S.like(c("s"), "a\\b"), S.text_between(c("s"), 1, 1), (c("x") + S.decimal(F.lit(0.25), 5, 3)).cast("string"), S.simple_case(c("i"), [(7, "seven")], "other")).first()
    assert tuple(got) == (None, 3.5, 1998, "1998-09-02", 19980902, True, "a", "0.350", "seven")
    with pytest.raises(Exception, match="too small"):
        df.select(S.guard(c("i") > 9, c("i"), "too small")).collect()
    with pytest.raises(UnsupportedPlanError):
        S.text_between(c("s"), 0, 1)


@pytest.fixture(scope="module")
def sums(spark):
    return spark.createDataFrame([("a", 10, 1.0), ("a", None, 2.0), ("b", None, None), ("b", None, None), (None, 5, -1.0)], "g string, x long, y double")


AGGS = {"n": Agg("count_star"), "k": Agg("count", "x"), "s": Agg("sum", "x"), "m": Agg("avg", "x"), "lo": Agg("min", "y"), "hi": Agg("max", "y")}
WANT = sorted([("a", 2, 1, 10, 10.0, 1.0, 2.0), ("b", 2, 0, None, None, None, None), (None, 1, 1, 5, 5.0, -1.0, -1.0)], key=str)


def test_two_phase_equals_one_phase(sums):
    one = A.group(sums, ["g"], n=F.count("*"), k=F.count("x"), s=F.sum("x"), m=F.avg("x"), lo=F.min("y"), hi=F.max("y"))
    assert rows(one) == WANT
    assert rows(A.two_phase(sums.withColumn("ch", F.monotonically_increasing_id() % 3), ["g"], AGGS, "ch")) == WANT
    assert rows(A.salted(sums, ["g"], AGGS, 3)) == WANT
    states = A.local_aggregate(sums, ["g"], AGGS)
    again = A.merge_states(A.merge_states(states, ["g"], AGGS).union(states.limit(0)), ["g"], AGGS)
    assert rows(A.finalize(again, ["g"], AGGS)) == WANT


def test_aggregates_of_nothing(sums):
    assert rows(A.two_phase(sums.limit(0), [], AGGS)) == [(0, 0, None, None, None, None)]
    assert rows(A.two_phase(sums.limit(0), ["g"], AGGS)) == []
    for bad in (("median", "x"), ("sum", None), ("count_star", "x")):
        with pytest.raises(UnsupportedPlanError):
            Agg(*bad)


def test_ties_and_null_order(spark):
    t = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 30, 2), (4, 40, 2), (5, 40, 2), (6, None, 2)], "id int, x int, grp int")
    got = {r["id"]: (r["rn"], r["rk"], r["dr"]) for r in W.rank_columns(t, ["grp"], [("x", "desc")]).collect()}
    assert got[3][1:] == (3, 2) and got[4][1:] == got[5][1:] == (1, 1) and got[6][1:] == (4, 3)
    assert [r["id"] for r in R.sort(t, "x", "id").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r["id"] for r in R.top(t, 2, ("x", "desc"), "id").collect()] == [4, 5]
    running = {r["id"]: r["s"] for r in W.add(t, W.over([], ["x"]), s=F.sum("x")).collect()}
    assert running[4] == running[5] == running[6] == 140
    assert {r["n"] for r in W.whole(t, n=F.count("x")).collect()} == {5}
    with pytest.raises(UnsupportedPlanError):
        W.over([], ["x"], rows=(0, 1), range_=(0, 1))
    with pytest.raises(UnsupportedPlanError):
        R.sort(t, ("x", "up"))
    with pytest.raises(UnsupportedPlanError):
        R.top_values(t, "x", 7)


def test_set_operations(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (3,), (None,)], "j int")
    assert len(rows(R.union_all(a, b))) == 7 and rows(R.union(a, b)) == [(1,), (2,), (3,), (None,)]
    assert rows(R.intersect(a, b)) == [(1,), (None,)] and rows(R.minus(a, b)) == [(2,)]
    assert rows(R.minus(a, b, keep_all=True)) == [(1,), (2,)] and rows(R.intersect(a, b, keep_all=True)) == [(1,), (None,)]
    with pytest.raises(UnsupportedPlanError):
        R.union_all(a, b.select("j", "j"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "t.parquet")
    spark.range(1000).select(c("id"), (c("id") % 7).alias("k"), F.when(c("id") % 5 != 0, c("id") * 1.0).alias("v")).repartition(3).write.parquet(path)
    return path


def test_row_ids_and_ranges(spark, stored):
    df = X.with_row_id(spark.read.parquet(stored))
    assert sorted(r["rowid"] for r in df.collect()) == list(range(1000))
    assert X.scan(spark, stored, ["id"], rows=(100, 130)).count() == 30
    assert {r["chunk"]: r["count"] for r in X.with_chunk(spark.read.parquet(stored), 300).groupBy("chunk").count().collect()} == {0: 300, 1: 300, 2: 300, 3: 100}
    assert X.row_ranges(1000, 300) == [(0, 300), (300, 600), (600, 900), (900, 1000)] and X.row_ranges(0, 5) == []
    with pytest.raises(UnsupportedPlanError):
        X.row_ranges(5, 0)


def test_chunked_plans_equal_plain_ones(spark, stored):
    df = spark.read.parquet(stored)
    p = Pipeline(df, 64).filter(c("id") > 10).project("k", "v")
    assert rows(p.run()) == rows(df.where("id > 10").select("k", "v"))
    batches = list(p.sort("k").batches())
    assert sum(map(len, batches)) == 989 and all(b == sorted(b, key=lambda r: r["k"]) for b in batches) and max(map(len, batches)) <= 64
    aggs = {"m": Agg("avg", "v"), "n": Agg("count_star")}
    assert [(r["k"], r["m"], r["n"]) for r in p.aggregate(["k"], aggs).sort("k").run().collect()] == [tuple(r) for r in df.where("id > 10").groupBy("k").agg(F.avg("v"), F.count("*")).orderBy("k").collect()]
    for bad in (lambda: p.join(df), lambda: p.limit(3), lambda: p.aggregate(["k"], aggs).filter(c("n") > 1), lambda: p.aggregate(["k"], aggs).sort(("k", "desc")), lambda: Pipeline(df, 0), lambda: p.local()):
        with pytest.raises(UnsupportedPlanError):
            bad()


def test_filters_and_columns_reach_the_scan(spark, stored):
    plan = X.scan(spark, stored, ["k"], [c("id") > 990])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,990)]" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan


def ranges_of(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


@pytest.mark.parametrize("cell", [4, 1 << 16])
def test_masks(spark, cell, monkeypatch):
    monkeypatch.setattr(M, "CELL", cell)
    rng = random.Random(cell)
    n = 50
    a, b = ({i for i in range(n) if rng.random() < share} for share in (0.6, 0.5))
    index = lambda s: spark.createDataFrame([(i,) for i in sorted(s)], "pos long")
    masks = {"index": lambda s: M.Mask("index", index(s), n), "rle": lambda s: M.Mask("rle", M.index_to_rle(index(s)), n), "plain": lambda s: M.Mask("plain", M.index_to_plain(index(s), n), n)}
    pos = lambda m: {r["pos"] for r in m.to_index().collect()}
    assert rows(masks["rle"](a).data) == sorted(ranges_of(a), key=str)
    kinds = {("rle", "rle"): ("rle", "rle"), ("plain", "plain"): ("plain", "plain"), ("index", "index"): ("index", "index"), ("rle", "index"): ("index", "rle"), ("plain", "rle"): ("index", "plain"), ("index", "plain"): ("index", "plain")}
    for (x, y), (k_and, k_or) in kinds.items():
        p, q = masks[x](a), masks[y](b)
        assert (p & q).kind == k_and and pos(p & q) == a & b
        assert (p | q).kind == k_or and pos(p | q) == a | b
    for x in masks:
        assert pos(~masks[x](a)) == set(range(n)) - a
    ra, rb = M.index_to_rle(index(a)), M.index_to_rle(index(b))
    assert rows(M.union(ra, rb)) == sorted(ranges_of(a | b), key=str)
    assert rows(M.complement(ra, n)) == sorted(ranges_of(set(range(n)) - a), key=str)
    assert rows(M.index_in_rle(index(b), ra)) == sorted(((i,) for i in a & b), key=str)
    assert rows(M.rle_holding_index(index(b), ra)) == sorted((r for r in ranges_of(a) if b & set(range(r[0], r[1] + 1))), key=str)
    at, want = 0, []
    for s, e in ranges_of(a):
        want.append((at, at + e - s))
        at += e - s + 1
    assert rows(M.compact(ra)) == sorted(want, key=str)
    assert M.check_ranges(ra).count() == 0
    empty = index(set())
    assert M.index_to_rle(empty).count() == 0 and rows(M.complement_index(empty, n)) == [(0, n - 1)] and M.complement(M.index_to_rle(index(set(range(n)))), n).count() == 0
    with pytest.raises(UnsupportedPlanError):
        masks["rle"](a) & M.Mask("rle", rb, n + 1)
    with pytest.raises(UnsupportedPlanError):
        M.Mask("bitmap", rb, n)


def test_run_length_aggregates(spark):
    runs = spark.createDataFrame([(0, 3, 5.0), (4, 4, -1.0)], "start long, end long, value double")
    assert rows(M.rle_aggregates(runs)) == [(5, 19.0, -1.0, 5.0, 3.8)]
    assert rows(M.rle_aggregates(runs.limit(0))) == [(0, None, None, None, None)]
    assert rows(M.concatenated_ranges(spark.createDataFrame([(3, 2), (9, 0)], "s long, n long"), "s", "n")) == [(3,), (4,)]


def test_dictionary_keeps_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "w string")
    first = M.dictionary(spark, df, "w")
    assert rows(first) == [(0, "a"), (1, "b")]
    grown = M.dictionary(spark, df.union(spark.createDataFrame([("aa",), ("0",)], "w string")), "w", first)
    assert rows(grown) == [(0, "a"), (1, "b"), (2, "0"), (3, "aa")]
    assert sorted(r["code"] for r in M.encode(df, "w", first, "code").collect()) == [-1, 0, 0, 1]


def test_sources_and_sinks(spark, tmp_path):
    df = X.from_columns(spark, {"a": [1, 2], "b": ["x", None], "d": [datetime.date(2024, 1, 1), None]})
    assert sinks.rows(df) == list(sinks.iterate(df)) and X.from_rows(spark, [{"a": 1, "b": None}], "a int, b string").count() == 1
    sinks.write_parquet(df, str(tmp_path / "p"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(UnsupportedPlanError):
        X.from_columns(spark, {"a": [1], "b": []})
    with pytest.raises(UnsupportedPlanError):
        R.rename(df, ["a", "b", "c", "d"])


def test_files_keep_their_rows(spark, tmp_path):
    rows = [(1, "a,b", 1.5, datetime.date(2020, 1, 2)), (2, None, None, None), (3, "", float("inf"), datetime.date(1999, 12, 31)), (None, 'say "x"\nnext', -0.25, None)]
    df = spark.createDataFrame(rows, "k long, s string, d double, day date")
    for kind, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": True, "multiLine": True, "escape": '"'}), ("csv", {"sep": "|", "multiLine": True, "escape": '"', "compression": "gzip"})):
        path = str(tmp_path / f"{kind}{len(options)}")
        write_files(df, path, kind, **options)
        back = read_files(spark, path, kind, df.schema if kind in ("json", "csv") else None, **options)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())), kind
        with pytest.raises(Exception, match="exist"):
            write_files(df, path, kind, **options)
    for bad in (("csv", None), ("json", None), ("xml", "k long")):
        with pytest.raises(UnsupportedPlanError):
            read_files(spark, str(tmp_path), *bad)


def test_a_range_reads_only_its_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "ten"))
    path = str(tmp_path / "ten")
    every = [r[0] for r in X.scan(spark, path).select("*", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    for first, last in ((0, 1), (95, 305), (990, 2000), (5, 5), (3000, 4000), (0, 1000)):
        part = X.scan(spark, path, rows=(first, last))
        assert sorted(r[0] for r in part.collect()) == sorted(every[first:last])
        if last <= 305 and first < last:
            assert len(part.inputFiles()) <= 4


def test_positional_and_batch_join(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(10, 13).select(F.col("id").alias("b")).coalesce(1).write.parquet(str(tmp_path / "b"))
    got = J.positional_join(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(0, 10), (1, 11), (2, 12), (3, None), (4, None)]))
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (1, "w")], "k long, v string")
    right = spark.createDataFrame([(1, 1.5), (1, 2.5), (None, 9.0), (7, 0.0)], "r long, d double")
    assert sorted(map(tuple, J.batch_join(left, right, "k", "r").collect())) == [(1, "w", 1, 1.5), (1, "w", 1, 2.5), (1, "x", 1, 1.5), (1, "x", 1, 2.5)]
    assert J.batch_join(left, right.limit(0), "k", "r").count() == 0
    for bad in (right.withColumnRenamed("d", "v"), spark.range(J.BATCH_SIDE + 1).withColumnRenamed("id", "r")):
        with pytest.raises(UnsupportedPlanError):
            J.batch_join(left, bad, "k", "r")


def test_resident_tables_are_released(spark):
    df = X.resident(spark.range(10), "ten")
    again = X.resident(spark.range(20), "ten")
    assert not df.is_cached and again.is_cached and again.count() == 20
    X.release(spark)
    assert not again.is_cached


def test_guard_fails_where_it_must(spark):
    df = spark.createDataFrame([(1,), (-1,)], "k long")
    assert df.where("k > 0").select(S.guard(F.col("k") >= 0, F.col("k"), "negative key")).collect() == [(1,)]
    with pytest.raises(Exception, match="negative key"):
        df.select(S.guard(F.col("k") >= 0, F.col("k"), "negative key")).collect()


def test_asof_join_in_cells(spark):
    """Cells cut a key's line without changing what is found, nulls and ties included."""
    rng = random.Random(21)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), k) for k in range(200)], "u int, at int, k int")
    right = spark.createDataFrame([(rng.choice([1, 2, 3, None]), rng.choice([None, *range(60)]), rng.choice([None, *range(5)])) for _ in range(60)], "u int, at int, v int")
    plain = rows(J.asof_join(left, right, "u", "at", "v", "found"))
    known = [tuple(r) for r in right.collect() if r["u"] is not None and r["at"] is not None and r["v"] is not None]
    last = lambda u, at: max(((t, v) for k, t, v in known if k == u and at is not None and t <= at), default=(None, None))[1]
    assert plain == sorted(((u, at, k, last(u, at)) for u, at, k in map(tuple, left.collect())), key=str)
    for width in (1, 7, 100):
        assert rows(J.asof_join(left, right, "u", "at", "v", "found", cell=lambda at, n=width: F.floor(at / n))) == plain
