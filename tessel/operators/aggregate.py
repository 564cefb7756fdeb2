"""Aggregation, and its explicit two-phase form for chunked or streamed input."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError

FUNCTIONS = ("sum", "count", "avg", "min", "max", "count_star")


@dataclass(frozen=True)
class Agg:
    """An aggregate of a column: sum, count, avg, min, max, or count_star without one."""

    function: str
    column: str | None = None

    def __post_init__(self) -> None:
        if self.function not in FUNCTIONS or (self.column is None) != (self.function == "count_star"):
            raise UnsupportedPlanError(f"aggregate {self.function}({self.column})")


_TEXT = re.compile(r"\s*([a-z_]+)\s*\(\s*(?:\"([^\"]+)\"|([A-Za-z_]\w*)|(\*))?\s*\)\s*", re.IGNORECASE)


def parse_aggregate(text: str) -> Agg:
    """``sum(x)`` and the like as an :class:`Agg`; a text that is no call of a known function on one column is an error."""
    m = _TEXT.fullmatch(text)
    if not m:
        raise UnsupportedPlanError(f"aggregate {text!r}")
    name, column = m[1].lower(), m[2] or m[3]
    name = {"sum_no_overflow": "sum", "mean": "avg"}.get(name, name)
    if name == "count" and m[4] or name == "count_star" and column is None:
        return Agg("count_star")
    return Agg(name, column)


def group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Grouped or, without keys, ungrouped aggregates; combined in each task before the shuffle."""
    named = [a.alias(n) for n, a in aggs.items()]
    return df.groupBy(*keys).agg(*named) if keys else df.agg(*named)


def first_by(value: str, order: str) -> Column:
    """The value of the first row by a key: a FIRST whose answer does not depend on tasks."""
    return F.min_by(value, order)


def local_aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg], chunk: str | None = None) -> DataFrame:
    """Partial states, one row per key (and chunk, if a chunk column is given).

    The state of a mean is its sum and its number of non-null values, so that
    states can be merged in any order and nulls do not count.
    """
    states = []
    for name, a in aggs.items():
        if a.function == "count_star":
            states.append(F.count("*").alias(f"{name}__n"))
        elif a.function == "count":
            states.append(F.count(a.column).alias(f"{name}__n"))
        elif a.function == "avg":
            states += [F.sum(F.col(a.column).cast("double")).alias(f"{name}__s"), F.count(a.column).alias(f"{name}__n")]
        else:
            f = {"sum": F.sum, "min": F.min, "max": F.max}[a.function]
            states.append(f(a.column).alias(f"{name}__v"))
    by = [*([chunk] if chunk else []), *keys]
    return df.groupBy(*by).agg(*states) if by else df.agg(*states)


def merge_states(states: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg]) -> DataFrame:
    """States merged to one row per key; the result is a state again."""
    merged = []
    for name, a in aggs.items():
        if a.function in ("count", "count_star", "avg"):
            merged.append(F.coalesce(F.sum(f"{name}__n"), F.lit(0)).alias(f"{name}__n"))
        if a.function == "avg":
            merged.append(F.sum(f"{name}__s").alias(f"{name}__s"))
        if a.function in ("sum", "min", "max"):
            f = {"sum": F.sum, "min": F.min, "max": F.max}[a.function]
            merged.append(f(f"{name}__v").alias(f"{name}__v"))
    return states.groupBy(*keys).agg(*merged) if keys else states.agg(*merged)


def finalize(states: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg]) -> DataFrame:
    """The aggregates' values from merged states."""
    out = []
    for name, a in aggs.items():
        if a.function in ("count", "count_star"):
            c = F.col(f"{name}__n")
        elif a.function == "avg":
            c = F.try_divide(F.col(f"{name}__s"), F.col(f"{name}__n"))
        else:
            c = F.col(f"{name}__v")
        out.append(c.alias(name))
    return states.select(*keys, *out)


def two_phase(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg], chunk: str | None = None) -> DataFrame:
    """Local states per chunk, merged and finished."""
    return finalize(merge_states(local_aggregate(df, keys, aggs, chunk), keys, aggs), keys, aggs)


def salted(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg], salts: int = 64) -> DataFrame:
    """Two phases over a random salt, for aggregates that Spark cannot combine before the shuffle well: a hot key's rows go to ``salts`` tasks."""
    if salts < 1:
        raise UnsupportedPlanError("at least one salt")
    return two_phase(df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))), keys, aggs, "__salt")
