"""Token counts kept by delta: signed changes add up to totals by source, language and tokenizer version.

A ledger is a chain of versions, one small manifest each. A batch is counted and
netted against what the ledger holds of its documents, the signed difference is added to the
totals, and the batch becomes visible by the one manifest that is written last, under the next version's number, which
only one writer can create. A batch whose mark is there is not applied again, so a retry or a replay changes nothing.
Documents' latest counts lie in segments that merge geometrically.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Versions, new_path, table
from .word_bpe import forget, token_bytes

KEYS = ("source", "lang", "version")
MEASURES = ("docs", "tokens", "chars")
DELTA = "source string, lang string, version string, docs long, tokens long, chars long"
HELD = "doc_id long, version string, source string, lang string, tokens long, chars long, live boolean, commit long"
#: Buckets of a segment by id. A batch that touches few of them reads these only.
BUCKETS = 64


def bpe_counter(path: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds ``tokens``: how many ids the tokenizer gives the text."""

    def count(df: DataFrame) -> DataFrame:
        place = df.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
                n = [len(token_bytes(t, path)) // 4 for t in batch.column(place).to_pylist()]
                kept = [i for i in range(batch.num_columns) if i != place]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(n, pa.int64())], names=[*(batch.schema.names[i] for i in kept), "tokens"])
            forget()

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
        return df.mapInArrow(run, f"{kinds}, tokens long")

    return count


def word_counter(df: DataFrame) -> DataFrame:
    """Adds ``tokens``: the text's runs of characters other than ASCII white space."""
    return df.withColumn("tokens", F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")).cast("long")).drop("text")


class TokenLedger(Versions):
    """Totals under a shared path.

    A batch is a DataFrame with ``op`` (insert, delete or revise), ``doc_id``,
    ``source``, ``lang`` and ``text``. A delete takes back what the ledger holds
    for the id; a revision takes that back and adds the new count; an insert of an
    id that the ledger holds is a revision, so that counts stay true when a feed repeats itself.

    Cases: null text counts as empty; null source or language is a key of its own;
    null ids are documents that only their totals keep: inserts and revisions add them, deletes of them do nothing.
    Of a batch's rows with one id the last by ``order_col`` counts; without that column, or at ties in it, deletes come after
    revisions and these after inserts, then the larger count is the later. An operation that is none of the three, or null,
    is an insert. An empty batch commits and changes nothing; extra columns are ignored. Batch ids are any text.

    Two writers may commit at once: the one that comes second to a version's
    number nets its batch against the new version and tries the next number. What a
    writer leaves that stops before its manifest is under a name of its own that nothing reads.
    """

    EMPTY = {"version": 0, "totals": None, "segments": []}

    def _held(self, segments: list[dict], buckets: list[int] | None = None) -> DataFrame:
        """The latest counts of each document and version in some segments; of ``buckets`` only, if given."""
        found = [self.spark.read.schema(f"{HELD}, bucket int").parquet(f"{self.path}/{s['path']}") for s in segments]
        rows = found[0] if found else self.spark.createDataFrame([], f"{HELD}, bucket int")
        for more in found[1:]:
            rows = rows.union(more)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        if len(found) < 2:
            return rows
        latest = F.max_by(F.struct("source", "lang", "tokens", "chars", "live", "commit", "bucket"), "commit").alias("x")
        return rows.groupBy("doc_id", "version").agg(latest).select("doc_id", "version", "x.*")

    def _write_segment(self, rows: DataFrame, name: str) -> dict:
        path = f"segments/{name}-{uuid.uuid4().hex}"
        share = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)  # tasks a bucket
        rows.select(*(c.split()[0] for c in HELD.split(", ")), "bucket").repartition("bucket", F.pmod(F.hash("doc_id"), F.lit(share))).write.partitionBy("bucket").parquet(f"{self.path}/{path}")
        return {"path": path, "rows": self.spark.read.schema(f"{HELD}, bucket int").parquet(f"{self.path}/{path}").count()}

    def commit(self, batch_id: str, changes: DataFrame, version: str, counter: Callable[[DataFrame], DataFrame], order_col: str | None = None) -> bool:
        """Apply a batch once. False: it was applied before, and nothing changes."""
        self._latest()
        if self._applied(batch_id):
            return False
        op = F.when(F.col("op").isin("revise", "delete"), F.col("op")).otherwise("insert")
        rank = F.when(op == "delete", 2).when(op == "revise", 1).otherwise(0)
        ids = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (op != "delete").alias("live"),
            F.struct((F.col(order_col) if order_col else F.lit(0)).alias("turn"), rank.alias("rank")).alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        # deletes are not counted, and each text once: the counts are written before anything reads them
        counted = counter(ids.where("live").withColumn("chars", F.char_length("text").cast("long")))
        gone = ids.where("not live and doc_id is not null").drop("text").withColumns({"chars": F.lit(0).cast("long"), "tokens": F.lit(0).cast("long")})
        path = f"{self.path}/counted/{uuid.uuid4().hex}"
        counted.unionByName(gone).write.parquet(path)
        rows = self.spark.read.parquet(path)
        last = F.max_by(F.struct("source", "lang", "tokens", "chars", "live"), F.struct("turn", "tokens", "chars", "source", "lang")).alias("x")
        new = rows.where("doc_id is not null").groupBy("doc_id").agg(last).select("doc_id", F.lit(version).alias("version"), "x.*")
        while True:
            now = self._latest()
            if self._applied(batch_id):
                return False
            number = now["version"] + 1
            named = new.withColumns({"commit": F.lit(number).cast("long"), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")})
            segment = self._write_segment(named, f"{number:012d}")
            new_rows = self.spark.read.schema(f"{HELD}, bucket int").parquet(f"{self.path}/{segment['path']}")
            deltas = self._signed(new_rows.where("live"), 1).union(self._signed(rows.where("doc_id is null and live").withColumn("version", F.lit(version)), 1))
            if now["segments"] and segment["rows"]:
                touched = [r["bucket"] for r in new_rows.select("bucket").distinct().collect()]  # at most BUCKETS
                before = self._held(now["segments"], touched if len(touched) < BUCKETS else None).where("live")
                deltas = deltas.union(self._signed(before.join(new_rows.select("doc_id", "version"), ["doc_id", "version"], "left_semi"), -1))
            if now["totals"]:
                deltas = deltas.union(self.spark.read.schema(DELTA).parquet(f"{self.path}/{now['totals']}"))
            totals = f"totals/{number:012d}-{uuid.uuid4().hex}"
            summed = deltas.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).where("docs <> 0 or tokens <> 0 or chars <> 0")
            summed.coalesce(1).write.parquet(f"{self.path}/{totals}")  # a row per source, language and version
            segments = [*now["segments"], *([segment] if segment["rows"] else [])]
            while len(segments) > 1 and segments[-2]["rows"] < 2 * segments[-1]["rows"]:
                two = segments[-2:]
                merged = self._held(two)
                # what is dead in the oldest segment hides nothing
                segments[-2:] = [self._write_segment(merged if len(segments) > 2 else merged.where("live"), f"{number:012d}")]
            if self._publish({"version": number, "batch": batch_id, "totals": totals, "segments": segments}):
                return True

    @staticmethod
    def _signed(rows: DataFrame, sign: int) -> DataFrame:
        """Partial totals: summed before any shuffle, so a source with a third of all rows is one row a task."""
        return rows.groupBy(*KEYS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars")).select(*KEYS, *((sign * F.col(m)).alias(m) for m in MEASURES))

    def totals(self) -> DataFrame:
        """``(source, lang, version, docs, tokens, chars)``; keys that have come down to no documents are left out."""
        found = self._latest()["totals"]
        return self.spark.read.schema(DELTA).parquet(f"{self.path}/{found}") if found else self.spark.createDataFrame([], DELTA)


def _inserts(docs: DataFrame, op: str = "insert") -> DataFrame:
    return docs.select(F.lit(op).alias("op"), "doc_id", "source", "lang", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the BPE tokenizer and under word counts; then one language's are deleted, inserted again and revised, and the first batch is replayed."""
    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark, new_path(spark, "ledger"))
    ledger.commit("bpe-1", _inserts(docs), "word_bpe_49k", bpe_counter())
    ledger.commit("words-1", _inserts(docs), "words", word_counter)
    ledger.commit("bpe/less", _inserts(docs.where("lang = 'de'"), "delete"), "word_bpe_49k", bpe_counter())
    ledger.commit("bpe/again", _inserts(docs.where("lang = 'de'")), "word_bpe_49k", bpe_counter())
    ledger.commit("words/revised", _inserts(docs.where("lang = 'de'"), "revise"), "words", word_counter)
    ledger.commit("bpe-1", _inserts(docs), "word_bpe_49k", bpe_counter())
    return ledger.totals()


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts alone, which SQL can express: inserted, deleted for one language, and inserted again."""
    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark, new_path(spark, "ledger"))
    ledger.commit("all", _inserts(docs), "words", word_counter)
    ledger.commit("less", _inserts(docs.where("lang = 'fr'"), "delete"), "words", word_counter)
    ledger.commit("again", _inserts(docs.where("lang = 'fr'")), "words", word_counter)
    return ledger.totals()


WORDS_SQL = r"""
SELECT source, lang, 'words' AS version, count(*) AS docs,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))) AS BIGINT) AS tokens,
       CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars
FROM documents GROUP BY source, lang
"""
