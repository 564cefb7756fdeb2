"""Tables written on the way to a result, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without that setting (tests) gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = "file://" + tempfile.mkdtemp(prefix="tessel-")
    return _roots[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, so that any store works."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone when Python exits
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in a folder of this application; deleted by :func:`discard` or when Python exits.

    What a driver leaves that dies before is in the folder that its application id names.
    """
    path = f"{shared_root(spark)}/tessel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    atexit.register(_forget, spark, path)
    return path


def discard(spark: SparkSession) -> None:
    """Delete all tables written so far; results that read them cannot be read afterwards."""
    while _written:
        _forget(spark, _written.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, so that every reader sees the same rows and a lost executor costs them nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
