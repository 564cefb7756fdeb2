"""Readers and writers of files of the usual kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessel.errors import UnsupportedPlanError

KINDS = ("parquet", "csv", "json", "orc", "text")


def read_files(spark: SparkSession, path: str | list[str], kind: str, schema: StructType | str | None = None, **options: object) -> DataFrame:
    """A table of files.

    CSV and JSON need a schema, for guessing one reads all data twice and may guess
    otherwise tomorrow; a column named ``_corrupt_record`` takes lines that do not fit. In CSV an empty field and ``\\N`` are null;
    an empty text stands in quotes. Parquet and ORC carry theirs; text has one column, ``value``.
    """
    if kind not in KINDS:
        raise UnsupportedPlanError(f"files of kind {kind!r}")
    if kind in ("csv", "json") and schema is None:
        raise UnsupportedPlanError(f"{kind} files need a schema")
    reader = spark.read.format(kind).options(**_options(kind, {k: v for k, v in options.items() if k != "compression"}))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_files(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", **options: object) -> None:
    """Write a table as files; what :func:`read_files` reads back with the same options and schema is equal."""
    if kind not in KINDS:
        raise UnsupportedPlanError(f"files of kind {kind!r}")
    df.write.format(kind).mode(mode).options(**_options(kind, options)).save(path)


def _options(kind: str, given: dict[str, object]) -> dict[str, str]:
    """As text; in CSV a null is told from an empty text unless the caller says how nulls look."""
    options = ({"nullValue": "\\N"} if kind == "csv" else {}) | given
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
