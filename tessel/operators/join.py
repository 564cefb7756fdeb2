"""Joins. Sides are sent to all tasks only by Spark's own size check; hot keys are left to adaptive skew joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.errors import UnsupportedPlanError
from tessel.sources.scan import with_row_id

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def _condition(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str], null_safe: bool) -> Column:
    pairs = on.items() if isinstance(on, Mapping) else zip(on, on, strict=True)
    out = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        out = c if out is None else out & c
    if out is None:
        raise UnsupportedPlanError("a join without a key")
    return out


def equi_join(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str], how: str = "inner", residual: Column | None = None, null_safe: bool = False) -> DataFrame:
    """Join on equal keys, with a further condition on the pairs if given. Null keys meet only if ``null_safe``."""
    if how not in KINDS:
        raise UnsupportedPlanError(f"join kind {how!r}")
    condition = _condition(left, right, on, null_safe)
    return left.join(right, condition if residual is None else condition & residual, how)


def right_semi(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Rows of the right side that have a partner."""
    return right.join(left, _condition(left, right, on, False), "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str]) -> DataFrame:
    return right.join(left, _condition(left, right, on, False), "left_anti")


def mark_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "mark") -> DataFrame:
    """All left rows with IN's three-valued answer.

    True if the key is there; null if it is not but the list holds a null, or the key is null and the list has rows;
    else false. The list is made distinct first, so no row is doubled.
    """
    keys = right.select(F.col(right_key).alias("__k")).where("__k is not null").distinct().withColumn("__hit", F.lit(True))
    facts = right.agg(F.count("*").alias("__n"), F.count_if(F.col(right_key).isNull()).alias("__nulls"))
    joined = left.join(keys, left[left_key] == keys["__k"], "left").crossJoin(facts)  # one row of facts
    unknown = (F.col(left_key).isNull() & (F.col("__n") > 0)) | (F.col("__nulls") > 0)
    mark = F.when(F.col("__hit"), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    return joined.select(*(left[c] for c in left.columns), mark.alias(name))


def lookup(fact: DataFrame, dim: DataFrame, key: Mapping[str, str], value: str, missing: object, name: str | None = None) -> DataFrame:
    """All fact rows with the dimension's value, or ``missing``; the dimension must have one row per key."""
    own = dim.select(*(F.col(d).alias(f"__k{i}") for i, d in enumerate(key.values())), F.col(value).alias("__v"))
    condition = None
    for i, f in enumerate(key):
        c = fact[f] == own[f"__k{i}"]
        condition = c if condition is None else condition & c
    return fact.join(own, condition, "left").select(*(fact[c] for c in fact.columns), F.coalesce("__v", F.lit(missing)).alias(name or value))


def scalar_join(left: DataFrame, right: DataFrame, column: str, operator: str, scalar: str) -> DataFrame:
    """Rows that compare to the one value of a one-row, one-column relation."""
    if operator not in (">", ">=", "<", "<=", "=", "!=", "<>"):
        raise UnsupportedPlanError(f"comparison {operator!r}")
    if len(right.columns) != 1:
        raise UnsupportedPlanError("a scalar subquery has one column")
    one = right.agg(F.count("*").alias("__n"), F.first(scalar).alias("__v"))
    value = F.when(F.col("__n") <= 1, F.col("__v")).otherwise(F.raise_error(F.lit("a scalar subquery gave more than one row")))
    return left.crossJoin(one.select(value.alias("__s"))).where(F.expr(f"`{column}` {operator} __s")).select(*left.columns)


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with ``low <= at <= high``.

    Both sides are cut in cells of ``width``, and cells are joined by equality: ranges
    come once per cell that they touch, so choose a width near their usual length.
    """
    if width <= 0:
        raise UnsupportedPlanError("the cell width must be positive")
    cells = ranges.withColumn("__cell", F.explode(F.expr(f"case when `{high}` >= `{low}` then sequence(floor(`{low}` / {width}), floor(`{high}` / {width})) else array() end")))
    cut = points.withColumn("__cell", F.floor(F.col(at) / width))
    return cut.join(cells, "__cell").where(F.col(at).between(F.col(low), F.col(high))).drop("__cell")


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two Parquet scans side by side by position; the shorter one is filled up with nulls."""
    a, b = with_row_id(left, "__a"), with_row_id(right, "__b")
    return a.join(b, F.col("__a") == F.col("__b"), "full").drop("__a", "__b")


#: Rows of a side that goes to every task as Arrow data.
BATCH_SIDE = 100_000


def batch_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join of each Arrow batch, where it is, with a right side of at most ``BATCH_SIDE`` rows and unlike column names; null keys meet nothing."""
    if set(left.columns) & set(right.columns):
        raise UnsupportedPlanError("columns of both sides must have different names")
    side = right.where(F.col(right_key).isNotNull()).limit(BATCH_SIDE + 1).toArrow()
    if side.num_rows > BATCH_SIDE:
        raise UnsupportedPlanError(f"the right side has over {BATCH_SIDE} rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = pa.Table.from_batches([batch]).join(side, left_key, right_key, "inner", coalesce_keys=False)
            yield from met.select([*batch.schema.names, *side.schema.names]).to_batches()

    return left.mapInArrow(run, StructType([*left.schema.fields, *right.schema.fields]))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, name: str, cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """All left rows with the value of the latest right row of the same key that is not later.

    Both sides are laid into one line per key and the last value is carried
    on: one shuffle, no pairs. Of right rows at the same time the largest value counts. A null key or time finds nothing and is not found.

    A key with a great share of all rows is one task's work, unless ``cell`` cuts the line: a function of
    the time that never falls, such as its month. Then each cell of a key is a line of its own, and what stands last in it is
    carried on to the cells after it, of which there is a row each.
    """
    a = left.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    known = right.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    b = known.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    both = a.union(b)
    line = ["__by"]
    if cell is not None:
        both, line = both.withColumn("__cell", cell(F.col("__at"))), ["__by", "__cell"]
    w = Window.partitionBy(*line).orderBy("__at", "__side", F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    if cell is None:
        return carried.select("__row.*", F.col("__last").alias(name))
    ends = both.groupBy(*line).agg(F.max(F.when(F.col("__v").isNotNull(), F.struct("__at", "__v")))["__v"].alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy("__by").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("__by").alias("__b"), F.col("__cell").alias("__c"), before.alias("__before")).where("__before is not null")
    met = carried.join(ends, F.col("__by").eqNullSafe(F.col("__b")) & F.col("__cell").eqNullSafe(F.col("__c")), "left")
    return met.select("__row.*", F.coalesce("__last", "__before").alias(name))
