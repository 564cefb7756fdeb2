"""Result sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[dict]:
    """All rows, for results that are known to be small."""
    return [r.asDict() for r in df.collect()]


def iterate(df: DataFrame) -> Iterator[dict]:
    """The rows one partition at a time, so that the driver holds no more than one."""
    return (r.asDict() for r in df.toLocalIterator(prefetchPartitions=True))


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
