"""Sessions and named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: What parity of results and adaptive plans need; sizes and memory are the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "tessel", **settings: str) -> SparkSession:
    """A session with the engine's settings; a session that runs already is used as it is."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters used later are pushed into its scan.

    The schema is read from the files once in an application; the files are
    listed each time. Call :func:`forget` when a table got other columns.
    """
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def forget() -> None:
    """Read schemas from the files again."""
    _schemas.clear()


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Make a folder's tables known to SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
