"""Helpers that several corpus operators share: durable tables, table loading, id-free row keys."""

from __future__ import annotations

import ctypes
import json
import math
import time
from collections.abc import Callable, Iterator
from functools import wraps
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessel.sources.shared import discard, new_path

__all__ = ["Versions", "bounded_sample", "discard", "durable", "encoded", "lean", "new_path", "numbered", "small_batches", "table", "whole_text"]

#: Rows of an Arrow batch of whole texts; Spark's own 10,000 are tens of MB, held by the JVM and by Python at a time.
TEXT_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches hold at most ``TEXT_BATCH`` rows from now on."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_BATCH:
        spark.conf.set(_BATCH, TEXT_BATCH)


def give_back() -> None:
    """Return to the system what this process has freed: Arrow's pool and the C library keep it otherwise, tens of MB a worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task ends, its worker process, which waits for others, gives its memory back."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def durable(df: DataFrame, name: str, narrow: bool = False, files_per_core: int = 0, texts: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the readers nothing, because
    the rows no longer depend on shuffle files or on cached blocks. ``narrow``
    tables hold a few numbers a row; they are written in one file per core
    of the cluster instead of one per shuffle partition, so that rounds over small tables do not make thousands of files.
    ``files_per_core`` does the same for larger tables. ``texts``: Python reads whole texts on the way, in small batches.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow or files_per_core:
        df = df.coalesce(max(2, spark.sparkContext.defaultParallelism * (files_per_core or 1)))
    before = spark.conf.get(_BATCH)
    if texts:
        small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row that every later scan gives again, however Spark splits the files then.

    Rows of a plain Parquet scan are numbered by the place of their file among
    the scan's files and their own place in it; other tables are written with their numbers.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    try:
        placed = df.withColumns({"__file": F.col("_metadata.file_path"), name: F.col("_metadata.row_index")}) if plan.nodeName() == "LogicalRelation" else None
    except AnalysisException:  # not Parquet
        placed = None
    if placed is None:
        return durable(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())
    if len(files) < 2:
        return placed.drop("__file")
    places = df.sparkSession.createDataFrame(list(enumerate(files)), "__place long, __file string")
    # bounded by the number of files, which the driver lists in any case
    return placed.join(F.broadcast(places), "__file").withColumn(name, F.shiftleft("__place", 40) + F.col(name)).drop("__file", "__place")


def whole_text(column: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``columns``.

    The hash is first held under a bound that lets a few more than ``n`` of the
    rows pass, so the task that takes the first ``n`` does not get ``n`` from each other task.
    """
    total = df.count()
    share = min(1.0, (n + 6 * math.sqrt(n) + 50) / max(1, total))
    key = F.xxhash64(*columns)
    if share < 1:
        df = df.where(key < F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(key, *columns).limit(n)


def encoded(batch_id: str) -> str:
    """A file name for any text; none starts with a sign that hides files."""
    return "b" + quote(batch_id, safe="")


class Versions:
    """A folder whose state is a chain of small manifests, one a version; each names the batch that made it.

    What a writer leaves that stops before its manifest is under a name of its own that nothing reads.
    """

    EMPTY: dict = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _create(self, path: str, text: str) -> bool:
        """Write a small file that is not there yet; False if it is."""
        fs, at = self._fs(path)
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _manifest(self, name: str) -> dict | None:
        """A version's manifest; None if its writer stopped while writing it."""
        for _ in range(10):
            fs, at = self._fs(f"versions/{name}")
            source = fs.open(at)
            try:
                size = fs.getFileStatus(at).getLen()
                return json.loads(bytes(source.readNBytes(size)).decode())
            except ValueError:
                time.sleep(0.2)
            finally:
                source.close()
        return None

    def _latest(self) -> dict:
        for name in reversed(self._names("versions")):
            found = self._manifest(name)
            if found:
                # a writer may have stopped between its manifest and its mark
                self._create(f"applied/{encoded(found['batch'])}", "")
                return found
            fs, at = self._fs(f"versions/{name}")
            fs.delete(at, False)
        return self.EMPTY

    def _applied(self, batch_id: str) -> bool:
        return self._exists(f"applied/{encoded(batch_id)}")

    def _publish(self, manifest: dict) -> bool:
        """Make a manifest the version that it names; False if another writer has made one of that number."""
        if not self._create(f"versions/{manifest['version']:012d}", json.dumps(manifest)):
            return False
        self._create(f"applied/{encoded(manifest['batch'])}", "")
        return True
