"""Table scans: columns, filters, row positions, row ranges, chunks, Arrow batches, and tables made of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError

ROW_ID = "rowid"


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Sequence[Column] = (), rows: tuple[int, int] | None = None) -> DataFrame:
    """Read ``columns`` of the rows that pass all ``filters``, of the half-open range of row positions ``rows`` if given.

    Of a range only the files that hold some of it are read: a count per file, which reads no column, tells which.
    """
    df = spark.read.parquet(path)
    if rows:
        counts = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().orderBy("file").collect()
        ends = list(accumulate(r["count"] for r in counts))
        parts = [(r["file"], rows[0] - (end - r["count"]), rows[1] - (end - r["count"])) for r, end in zip(counts, ends, strict=True) if rows[0] < end and rows[1] > end - r["count"]]
        whole, index = df, F.col("_metadata.row_index")
        df = whole.limit(0) if not parts else None
        for file, first, last in parts:
            # the files between the first and the last are read whole
            part = spark.read.schema(whole.schema).parquet(file).where((index >= first) & (index < last))
            df = part if df is None else df.unionByName(part)
    if filters:
        df = df.where(reduce(and_, filters))
    return df.select(*columns) if columns else df


_resident: dict[tuple[str, str], DataFrame] = {}


def resident(df: DataFrame, name: str) -> DataFrame:
    """Keep a table in the executors' memory, on disk where that is full. What the name held before is released, so a table that is asked for again and again is held once."""
    key = (df.sparkSession.sparkContext.applicationId, name)
    release(df.sparkSession, name)
    _resident[key] = df.persist()
    return _resident[key]


def release(spark: SparkSession, name: str | None = None) -> None:
    """Give up what :func:`resident` holds under a name, or all."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _resident if k[0] == app and name in (None, k[1])]:
        _resident.pop(key).unpersist()


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Add dense positions 0, 1, ... over a Parquet scan.

    The scan tells a row's position in its file; files follow one another in the
    order of their paths. The number of rows of each file is all that is gathered, and
    one window over files, not rows, adds them up.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = placed.groupBy("__file").agg(F.max("__row").alias("__last"))
    before = F.coalesce(F.sum(F.col("__last") + 1).over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file; Spark decides by its size whether to send it to all tasks
    return placed.join(files.select("__file", before.alias("__before")), "__file").select(*df.columns, (F.col("__before") + F.col("__row")).alias(name))


def row_ranges(rows: int, size: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most ``size`` that cover ``rows`` positions."""
    if size <= 0:
        raise UnsupportedPlanError("the chunk size must be positive")
    return [(a, min(a + size, rows)) for a in range(0, rows, size)]


def with_chunk(df: DataFrame, size: int, name: str = "chunk") -> DataFrame:
    """Add the number of the chunk of ``size`` row positions that a row is in."""
    if size <= 0:
        raise UnsupportedPlanError("the chunk size must be positive")
    return with_row_id(df, "__rowid").withColumn(name, F.floor(F.col("__rowid") / size).cast("long")).drop("__rowid")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``f`` to each Arrow batch where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return df.mapInArrow(run, schema)


def dummy(spark: SparkSession) -> DataFrame:
    """One row without columns of its own, for selections of constants."""
    return spark.range(1).select()


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.limit(0)


def from_rows(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    """A table of equally long columns."""
    if len({len(c) for c in columns.values()}) > 1:
        raise UnsupportedPlanError("columns must be equally long")
    return spark.createDataFrame(pa.table({n: pa.array(c) for n, c in columns.items()}))


def literals(spark: SparkSession, name: str, values: Sequence) -> DataFrame:
    """A literal list as a one-column relation."""
    return spark.createDataFrame([(v,) for v in values], [name])


def selectivity(df: DataFrame, condition: Column) -> DataFrame:
    """``(rows, selected, share)`` of a filter, in one pass."""
    selected = F.count_if(condition)
    return df.agg(F.count("*").alias("rows"), selected.alias("selected")).select("rows", "selected", (F.col("selected") / F.col("rows")).alias("share"))
