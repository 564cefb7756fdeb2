"""Two-phase aggregation over a stream: each micro-batch adds its partial states; the states merged are the result so far."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.aggregate import Agg, finalize, local_aggregate, merge_states


def start(stream: DataFrame, keys: Sequence[str], aggs: Mapping[str, Agg], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write each micro-batch's states under its number; a batch that is done again overwrites itself, so it counts once."""

    def add(batch: DataFrame, number: int) -> None:
        local_aggregate(batch, keys, aggs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def result(spark: SparkSession, keys: Sequence[str], aggs: Mapping[str, Agg], path: str) -> DataFrame:
    return finalize(merge_states(spark.read.parquet(path), keys, aggs), keys, aggs)
