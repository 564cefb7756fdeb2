"""A corpus cleaning pipeline in five stages: toxicity, exact dedup, SimHash near-dedup, PII, packing.

Each stage takes the documents that the one before kept, with all columns, and
works on whole texts. Null and empty texts are documents like any other; rows that repeat each other are copies, of
which one stays; an empty table runs through. Stages that hand whole texts to
Python lower the session's Arrow batch size; their Python tasks give their memory back when they end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import exact_dedup, packing, pii, simhash, toxicity
from tessel.llm.common import durable, numbered, small_batches, table

#: Bytes of the token caches of the last stage; its executors still hold the memory that earlier stages took.
CACHE_BYTES = 32_000_000
#: A row's number while a stage decides on it; the same in each scan.
ROW = "__tessel_row"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Numbered ``docs`` without the numbered rows. Those are written first: if few, they go to all tasks; else Spark shuffles by the row's number."""
    return docs.join(durable(dropped.select(ROW), "dropped", narrow=True), ROW, "left_anti").drop(ROW)


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.5 or more go."""
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="__tessel_score").where("__tessel_score < 0.5").select(*docs.columns)


def exact_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (of repeated rows, one)."""
    docs = numbered(docs, ROW)
    rows = docs.select(F.struct("doc_id", ROW).alias("id"), "text")
    dropped = exact_dedup.exact_dedup(rows, id_col="id").where("not kept").select(F.col(f"id.{ROW}").alias(ROW))
    return _without(docs, dropped)


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more (five-word shingles) the row with the smallest doc_id stays."""
    docs = numbered(docs, ROW)
    rows = docs.select(F.struct("doc_id", ROW).alias("id"), "text")
    found = simhash.near_groups_by_similarity(rows.withColumn("row", F.col(f"id.{ROW}")), id_col="id", words=5, similarity=0.8, row_col="row")
    return _without(docs, found.where("id <> component_id").select(F.col(f"id.{ROW}").alias(ROW)))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows."""
    small_batches(spark)
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, cache_bytes=CACHE_BYTES)


STAGES = [
    ("toxicity", toxic_go),
    ("exact_dedup", exact_copies_go),
    ("simhash_near_dedup", near_copies_go),
    ("pii", personal_data_masked),
    ("best_fit_packing", packed),
]

#: No stage but exact dedup has an SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
