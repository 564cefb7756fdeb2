"""Projection, filter, sort, limit and set operations over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError


def project(df: DataFrame, **columns: Column | str | int | float | bool | None) -> DataFrame:
    """Named columns, expressions or literals."""
    return df.select(*((c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in columns.items()))


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first columns under new names; the others go."""
    if len(names) > len(df.columns):
        raise UnsupportedPlanError(f"{len(names)} names for {len(df.columns)} columns")
    return df.select(*df.columns[: len(names)]).toDF(*names)


def ordering(keys: Sequence[str | tuple[str, str]]) -> list[Column]:
    """Sort keys by name or (name, "desc"); nulls come last either way."""
    out = []
    for key in keys:
        name, way = (key, "asc") if isinstance(key, str) else key
        if way not in ("asc", "desc"):
            raise UnsupportedPlanError(f"sort order {way!r}")
        out.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_last())
    return out


def sort(df: DataFrame, *keys: str | tuple[str, str]) -> DataFrame:
    return df.orderBy(*ordering(keys))


def top(df: DataFrame, n: int, *keys: str | tuple[str, str]) -> DataFrame:
    """The first ``n`` rows of an order: each task keeps its own first, no full sort."""
    if n < 0:
        raise UnsupportedPlanError("a limit must not be negative")
    return df.orderBy(*ordering(keys)).limit(n)


def top_values(df: DataFrame, column: str, n: int, descending: bool = True) -> DataFrame:
    """The ``n`` largest or smallest values; more than there are rows is an error."""
    found = df.select(column).orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()).limit(n)
    if found.count() < n:
        raise UnsupportedPlanError(f"{n} values asked for, fewer rows there")
    return found


def sort_batches(df: DataFrame, *keys: str | tuple[str, str]) -> DataFrame:
    """Each partition sorted by itself."""
    return df.sortWithinPartitions(*ordering(keys))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, by position, named as in the first."""
    for other in others:
        if len(other.columns) != len(first.columns):
            raise UnsupportedPlanError("UNION of different numbers of columns")
        first = first.union(other)
    return first


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    return union_all(first, *others).distinct()


def intersect(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    return a.intersectAll(b) if keep_all else a.intersect(b)


def minus(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_all else a.subtract(b)


def with_tables(df: DataFrame, views: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """SQL over named DataFrames, as if each were a common table expression."""
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)
