"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, whole_text

#: Pages of a survivor bitmap, of small tables and at most; each holds 32,768 bits in 4,096 bytes.
BITMAP_PAGES, MOST_PAGES = 256, 8192


def _survivor_bitmap(keys: DataFrame, key: str, pages: int) -> DataFrame:
    """One row per page of a bitmap over the hashed keys: at most ``pages`` x 4 KB, whatever the input."""
    slot = F.pmod(F.col(key), F.lit(pages * 32768))
    return (
        keys.select(F.floor(slot / 32768).cast("long").alias("__page"), (slot % 32768).alias("__bit"))
        .groupBy("__page")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )


def _flag(df: DataFrame, key: Column, bitmap: DataFrame, pages: int, name: str) -> DataFrame:
    """Add a boolean: whether the key's bit is set. Other keys may share a bit, so it may be true too often, never too seldom."""
    slot = F.pmod(key, F.lit(pages * 32768))
    kept = [c for c in df.columns]
    joined = df.withColumn("__slot", slot).withColumn("__page", F.floor(F.col("__slot") / 32768).cast("long"))
    joined = joined.join(F.broadcast(bitmap), "__page", "left")  # bounded: pages x 4 KB
    bit = F.col("__slot") % 32768
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = joined.select(*kept, byte.alias("__byte"), (bit % 8).cast("int").alias("__at"))
    return found.select(*kept, F.coalesce(F.expr("(shiftright(__byte, __at) & 1) = 1"), F.lit(False)).alias(name))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text: Column | None = None, prefix_chars: int = 64, pages: int | None = None, carry: dict[str, Column] | None = None
) -> DataFrame:
    """``(id, keep_id, group_size, kept, *carry)``, one row per input row.

    Equal texts (null counts as empty) form a group; the row with the largest id
    stays. Each round reads less: all rows give their length; rows whose length
    repeats give the hash of their first ``prefix_chars`` characters; rows whose
    length and prefix repeat are read whole and hashed (SHA-256, with the length
    as part of the key). Survivors pass from round to round as a bitmap of 1 to 32 MB,
    by the number of rows, so no text is ever shuffled and a false bit only costs a hash.

    Cases: null id - the row joins its group and stays only if no row of the
    group has an id (all rows of such a group have ``keep_id`` null and stay);
    repeated rows with the largest id - all of them are marked kept, as they are the same row;
    empty table - no rows; extra columns are ignored. ``carry`` adds columns
    computed from the input row. A group with a third of all rows is counted
    before the shuffle and joined back as one row that Spark can send to all
    splits of the hot key.
    """
    base = df.select(F.col(id_col).alias("__id"), (text if text is not None else whole_text()).alias("__text"), *[c.alias(f"__c_{n}") for n, c in (carry or {}).items()])
    size = F.octet_length("__text").cast("long")
    prefix = F.xxhash64(size, F.substring("__text", 1, prefix_chars))

    lengths = durable(base.groupBy(size.alias("__len")).agg(F.count("*").alias("n")), "lengths", narrow=True)
    # eight bits a row whose length repeats, within the bounds
    again = lengths.agg(F.sum(F.when(F.col("n") > 1, F.col("n")))).first()[0] or 0
    pages = pages or min(MOST_PAGES, max(BITMAP_PAGES, 1 << (8 * again // 32768).bit_length()))
    by_length = durable(_survivor_bitmap(lengths.where("n > 1").select(F.xxhash64("__len").alias("k")), "k", BITMAP_PAGES), "by-length", narrow=True)

    first = _flag(base.select("__text"), F.xxhash64(size), by_length, BITMAP_PAGES, "__again").where("__again")
    prefixes = first.groupBy(prefix.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k")
    by_prefix = durable(_survivor_bitmap(prefixes, "k", pages), "prefixes", narrow=True)

    second = _flag(base, prefix, by_prefix, pages, "__again")
    hashed = second.select("__id", size.alias("__len"), F.when(F.col("__again"), F.sha2("__text", 256)).alias("__full"), *[f"__c_{n}" for n in carry or {}])
    rows = durable(hashed, "hashed")

    groups = rows.where("__full is not null").groupBy("__len", "__full").agg(F.count("*").alias("__n"), F.max("__id").alias("__keep")).where("__n > 1")
    out = rows.join(groups, ["__len", "__full"], "left")
    return out.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__n").isNull() | F.col("__id").eqNullSafe(F.col("__keep"))).alias("kept"),
        *[F.col(f"__c_{n}").alias(n) for n in carry or {}],
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(whole_text(), 256)})


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
