"""Window functions with explicit null order and frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError
from tessel.operators.relational import ordering


def over(partition: Sequence[str] = (), order: Sequence[str | tuple[str, str]] = (), rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> WindowSpec:
    """A window; nulls last. Without a frame, ordered windows end at the current row's ties, others span the partition."""
    w = Window.partitionBy(*partition)
    if order:
        w = w.orderBy(*ordering(order))
    if rows and range_:
        raise UnsupportedPlanError("one frame only")
    if rows:
        w = w.rowsBetween(*rows)
    if range_:
        w = w.rangeBetween(*range_)
    return w


def add(df: DataFrame, window: WindowSpec, **functions: Column) -> DataFrame:
    """All columns and the named functions over a window."""
    return df.select("*", *(f.over(window).alias(n) for n, f in functions.items()))


def row_number() -> Column:
    return F.row_number()


def rank_columns(df: DataFrame, partition: Sequence[str], order: Sequence[str | tuple[str, str]]) -> DataFrame:
    """row_number, rank and dense_rank as 64-bit numbers."""
    w = over(partition, order)
    return df.select("*", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"))


def whole(df: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates of the whole input on each row: computed once and joined as one row, instead of gathering all rows in one task."""
    return df.crossJoin(df.agg(*(a.alias(n) for n, a in aggs.items())))
