"""WARC archives written and read by Spark's own text source, with verified record boundaries.

A payload may hold bytes that look like a record's start. Every such start is a
candidate with an offset and, from its header, the offset of its successor; the
real records are those that the file's start reaches. Pointer jumping finds
them: within a split each candidate jumps to where its chain leaves the split,
then the few jumps from split to split are doubled until the file's end, then each split marks the chain from its entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, new_path, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Equal payloads shorter than this are stored again.
MIN_REVISIT = 1000


def _header_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT, max_records: int = 100_000
) -> None:
    """One record per row, in files of at most ``max_records``.

    Of rows with equal payloads of at least ``min_revisit`` bytes the one with
    the largest id is a response, the others are revisits of it without a
    payload.

    Cases: null payloads count as empty, null addresses too; a null id is smaller than any;
    rows that repeat the largest id are responses all; payloads may be as long as a row can be, and hold what looks like records; an
    empty table writes a folder without archives; extra columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    size, strong = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    equal = rows.where(size >= min_revisit).groupBy(strong.alias("strong")).agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    # written first, so that its size is known: small, it is sent to all tasks and no payload moves; large, it is shuffled
    joined = rows.withColumn("strong", F.when(size >= min_revisit, strong)).join(durable(equal.drop("n"), "originals", narrow=True), "strong", "left")
    again = F.col("original").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("original")))
    header = F.concat(
        F.when(again, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\n"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), _header_value(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(F.col("payload").cast("binary")),
        F.lit("\r\nWARC-Payload-Length: "), size.cast("string"), F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("original").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(again, "0").otherwise(size.cast("string")), F.lit(END),
    )
    record = F.concat(F.lit(MAGIC), header, F.when(again, "").otherwise(F.col("payload")))
    joined.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)


def _between_starts(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two starts, with its digest. ``block`` and ``idx``, which grows within a split, hold for one reading: another may split the files elsewhere."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("idx"), F.unhex(F.sha2("value", 256)).alias("key"))


def _candidates(spark: SparkSession, path: str, keep_payload: bool) -> DataFrame:
    """What each start's header says, and the digest of its payload if no other start seems to cut it."""
    raw = _between_starts(spark, path)
    head = F.substring_index("value", END, 1)
    field = lambda name: F.regexp_extract("head", f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    parsed = raw.withColumn("head", F.when(F.instr("value", END) > 0, head)).withColumns({"size": F.octet_length("value").cast("long"), "head_size": F.octet_length("head").cast("long") + len(END)})
    parsed = parsed.withColumn("content", F.expr("try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1), '') as bigint)"))
    whole = F.coalesce(F.col("size") == F.col("head_size") + F.col("content") + len(END), F.lit(False))
    payload = F.substring(F.col("value").cast("binary"), F.col("head_size").cast("int") + 1, F.col("content").cast("int"))
    return parsed.select(
        "file", "block", "idx", "key", "size", "head_size", "content", whole.alias("whole"),
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record"), field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers"),
        field("WARC-Payload-Digest").alias("digest"), field("WARC-Payload-Length").alias("length"),
        F.when(whole, F.sha1(payload)).alias("sha1"), *([F.when(whole, payload).alias("payload")] if keep_payload else []),
    )


def _leave_split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, the first offset on its chain that is outside; -1 if the chain breaks off."""
    off, after = pdf["off"].to_numpy(), pdf["after"].to_numpy()
    order = np.argsort(off)
    off, after = off[order], after[order]
    at = np.searchsorted(off, after)
    inside = (at < len(off)) & (off[np.minimum(at, len(off) - 1)] == after)
    jump = np.where(inside, at, np.arange(len(off)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    leaves = after[jump]
    # an offset within the split that is no candidate is a broken chain
    leaves = np.where(leaves > off[-1], leaves, -1)
    return pd.DataFrame({"file": key[0], "off": off, "leaves": leaves})


def _mark_split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates on the chain from a split's entry."""
    successor = dict(zip(pdf["off"].tolist(), pdf["after"].tolist(), strict=True))
    seen = []
    for o in pdf.loc[pdf["entry"], "off"].tolist():
        while o in successor:
            seen.append(o)
            o = successor[o]
    return pd.DataFrame({"file": key[0], "off": np.array(seen, dtype=np.int64)})


def reachable(candidates: DataFrame) -> DataFrame:
    """``(file, off)`` of the candidates that the chain from their file's start reaches; candidates have file, block, off, after."""
    links = candidates.select("file", "block", "off", F.coalesce("after", F.lit(-1)).alias("after"))
    jumps = durable(links.groupBy("file", "block").applyInPandas(_leave_split, "file string, off long, leaves long"), "jumps", narrow=True)
    entries, jump = jumps.where("off = 0").select("file", "off"), jumps
    n, splits = entries.count(), candidates.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(0, splits - 1).bit_length()):
        more = entries.join(jump, ["file", "off"]).select("file", F.col("leaves").alias("off")).join(jumps.select("file", "off"), ["file", "off"], "left_semi")
        entries = durable(entries.union(more).distinct(), "entries", narrow=True)
        found = entries.count()
        if found == n:
            break
        n = found
        onward = jump.select("file", F.col("off").alias("leaves"), F.col("leaves").alias("further"))
        jump = durable(jump.join(onward, ["file", "leaves"]).select("file", "off", F.col("further").alias("leaves")), "jumps", narrow=True)
    told = links.join(entries.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return told.groupBy("file", "block").applyInPandas(_mark_split, "file string, off long")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record: type, record, url, refers, digest (header), length (header), payload_bytes, sha1 of the payload read, and the payload if asked for.

    Cases: records without a payload have the empty one; what stands before a file's first start, after a broken length, or in
    a payload is no record; records that repeat each other are rows each; fields that a header lacks are empty; a folder without archives gives no
    rows; a record is held whole by one task, files and splits are not.
    """
    found = durable(_candidates(spark, path, keep_payload), "candidates")
    step = len(MAGIC.encode())
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + step).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(F.col("size") + step).over(Window.partitionBy("file", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what stands before the first start gets a negative offset and is no candidate
    placed = found.withColumn("within", within).join(blocks.select("file", "block", before.alias("before")), ["file", "block"]).withColumn("off", F.col("before") + F.col("within") - step).drop("before", "within")
    placed = durable(placed.where("off >= 0").withColumn("after", F.col("off") + step + F.col("head_size") + F.col("content") + len(END)), "placed")
    marks = reachable(placed).withColumn("real", F.lit(True))
    told = placed.join(marks, ["file", "off"], "left").withColumn("real", F.coalesce("real", F.lit(False)))
    # numbers of the real records, within a split and after those of the file's splits before it: no window holds more than a split's rows
    told = durable(told.withColumn("real_here", F.sum(F.col("real").cast("long")).over(Window.partitionBy("file", "block").orderBy("off"))), "told")
    reals = told.groupBy("file", "block").agg(F.max("real_here").alias("reals"))
    reals = reals.withColumn("reals_before", F.coalesce(F.sum("reals").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = told.join(reals.drop("reals"), ["file", "block"]).withColumn("n", F.col("reals_before") + F.col("real_here")).drop("reals_before", "real_here")
    fields = ["type", "record", "url", "refers", "digest", "length"]
    whole = told.where("real and whole").select(*fields, F.col("content").alias("payload_bytes"), "sha1", *(["payload"] if keep_payload else []))
    # the rest: a start within the payload cut it; its pieces are put together again
    first = lambda c: F.max(F.when(F.col("real"), F.col(c))).alias(c)
    # few, so written first: their size decides whether the second reading is joined by a broadcast or a shuffle
    pieces = durable(told.where("not (real and whole) and n > 0").select("file", "key", "n", "off", "real", "head_size", "content", *fields), "cut", narrow=True)
    # found again by what they hold, which no split changes; of equal ones in a file one will do
    raw = _between_starts(spark, path).select("file", "key", "value").join(pieces.select("file", "key").distinct(), ["file", "key"], "left_semi").dropDuplicates(["file", "key"])
    pieces = raw.join(pieces, ["file", "key"])
    cut = pieces.groupBy("file", "n").agg(*map(first, [*fields, "head_size", "content"]), F.array_sort(F.collect_list(F.struct("off", F.col("value").alias("raw")))).alias("pieces"))
    whole_raw = F.array_join(F.transform("pieces", lambda p: p["raw"]), MAGIC).cast("binary")
    cut = cut.where("content is not null").withColumn("payload", F.substring(whole_raw, F.col("head_size").cast("int") + 1, F.col("content").cast("int")))
    joined = cut.select(*fields, F.col("content").alias("payload_bytes"), F.sha1("payload").alias("sha1"), *(["payload"] if keep_payload else []))
    return whole.union(joined)


def _page(c: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1), '') as bigint)")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path)
    again = F.col("type") == "revisit"
    return back.select(
        _page("record").alias("page_id"),
        F.when(again, F.expr("try_cast(length as bigint)")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("digest", ":", -1)).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(again, _page("refers")).alias("refers_to"),
    )
