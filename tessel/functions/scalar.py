"""Expressions with the SQL standard's answers where Spark's defaults or the oracle's differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError


def all_of(conditions: Sequence[Column]) -> Column:
    """Three-valued AND of at least one condition."""
    if not conditions:
        raise UnsupportedPlanError("no conditions")
    return reduce(and_, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    """Three-valued OR of at least one condition."""
    if not conditions:
        raise UnsupportedPlanError("no conditions")
    return reduce(or_, conditions)


def member(value: Column, accepted: Sequence) -> Column:
    """IN a list of literals: none is never true, one is an equality."""
    if not accepted:
        return F.lit(False)
    return value == F.lit(accepted[0]) if len(accepted) == 1 else value.isin(*accepted)


def divide(a: Column, b: Column) -> Column:
    """True division in double precision; by zero it is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean(value: Column) -> Column:
    """The mean in double precision, for decimals too."""
    return F.avg(value.cast("double"))


def year_of(date: Column) -> Column:
    return F.year(date).cast("long")


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def day_number(date: Column) -> Column:
    """A date as the number YYYYMMDD."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("long")


def like(value: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_`` only: a backslash in the pattern is itself."""
    return value.like(pattern.replace("\\", "\\\\"))


def text_between(value: Column, start: int, length: int) -> Column:
    """Substring from a position counted from 1."""
    if start < 1 or length < 0:
        raise UnsupportedPlanError("positions count from 1 and lengths from 0")
    return F.substring(value, start, length)


def case(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Searched CASE; an unknown condition is one that does not hold."""
    if not branches:
        raise UnsupportedPlanError("CASE without a branch")
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def simple_case(value: Column, branches: Sequence[tuple[object, object]], otherwise: object = None) -> Column:
    """CASE of a value; null equals no branch."""
    return case([(value == F.lit(k), F.lit(v)) for k, v in branches], F.lit(otherwise))


def decimal(value: Column, precision: int = 15, scale: int = 2) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def guard(condition: Column, value: Column, message: str) -> Column:
    """The value where the condition holds; elsewhere the query fails with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def constant_or_null(value: Column, *others: Column) -> Column:
    """The value, unless one of the others is null."""
    return F.when(all_of([o.isNotNull() for o in others]), value)
