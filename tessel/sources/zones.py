"""Zone maps: the least and the largest value of columns in each zone of neighbouring rows, and what of a table a filter by ranges must read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.sources.scan import with_chunk


def zone_map(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """``(zone, rows, min_c, max_c, ...)`` for zones of ``rows`` positions of a Parquet scan; a zone of nulls has null bounds."""
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return with_chunk(df, rows, "zone").groupBy("zone").agg(F.count("*").alias("rows"), *bounds)


def touched(zones: DataFrame, ranges: Mapping[str, tuple[object, object]]) -> DataFrame:
    """The zones that may hold rows with all columns in their closed ranges; None leaves an end open."""
    out = zones
    for name, (low, high) in ranges.items():
        out = out.where(F.col(f"max_{name}").isNotNull())
        if low is not None:
            out = out.where(F.col(f"max_{name}") >= F.lit(low))
        if high is not None:
            out = out.where(F.col(f"min_{name}") <= F.lit(high))
    return out


def read_model(zones: DataFrame, ranges: Mapping[str, tuple[object, object]], matching: int) -> DataFrame:
    """``(zones, zones_read, rows, rows_read, amplification)``: rows that must be read for each that matches; null if none does."""
    all_zones = zones.agg(F.count("*").alias("zones"), F.sum("rows").alias("rows"))
    read = touched(zones, ranges).agg(F.count("*").alias("zones_read"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_read"))
    # two tables of one row
    return all_zones.crossJoin(read).select("zones", "zones_read", "rows", "rows_read", F.try_divide(F.col("rows_read").cast("double"), F.lit(matching)).alias("amplification"))
