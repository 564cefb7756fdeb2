"""Near-dedup by the exact Jaccard similarity of shingle sets: SimHash probes, prefix filter, exact verification, components.

Fingerprints that probes of :mod:`tessel.llm.simhash` bring together are the first
candidates; they connect most groups of near copies. What they miss - at a similarity of 0.8
fingerprints differ in some 15 % of their bits, which no pigeonhole affords - the prefix filter finds: all
shingles get one order, the ones that are common in a sample last. Of two
sets as similar as asked for, each one's first ``size - ceil(similarity * size) + 1``
shingles in that order have one in common, so buckets by these shingles hold every
pair that is to be found; the order, and so the sample, only decides how full the
buckets are. A pair is linked by the sizes of intersection and union alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, lean, numbered, whole_text
from .components import connected_components
from .exact_dedup import BITMAP_PAGES, _flag, _survivor_bitmap
from .simhash import _labelled, _mix, bucket_links, fingerprints_of, plan_probes, probe_rows, shingle_hashes

#: Documents, of which common shingles are learned: so many, or this share of them if that is more.
SAMPLE, SHARE = 8_000, 0.01
#: The most shingles that have a rank by frequency, the most that are marked as common beside them, and the pages of 4 KB of the marks.
COMMON, MARKED, PAGES = 65_536, 4_000_000, 1024
#: Fingerprints and probes of the first candidates.
BITS, RADIUS, PARTS = 64, 3, 4
#: Bits of the sketches that travel with probes. Those that pairs are held against have at least twice as many bits as their set has shingles.
SKETCH_BITS = 512


def _set_of(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or "", words), dtype=np.uint64))


@dataclass(frozen=True)
class Order:
    """Which shingles are common: some in the order of their frequency, others by a bitmap of fixed size that may mark a few more.

    Shingles are ordered by (not marked, marked, ranked), then by rank or by themselves: any order will do as long as it is the
    same for all sets, and one that has common shingles last keeps buckets small.
    """

    tokens: np.ndarray  # in their own order
    ranks: np.ndarray
    marks: np.ndarray  # bits, as bytes

    def first(self, own: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of a sorted set."""
        ranked = np.zeros(len(own), dtype=bool)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
            ranked = self.tokens[at] == own
        marked = np.zeros(len(own), dtype=bool)
        if len(self.marks):
            slot = own.view(np.int64) % (8 * len(self.marks))
            marked = (self.marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & ~ranked
        parts = [own[~ranked & ~marked][:n], own[marked][:n]]
        if sum(map(len, parts)) < n and ranked.any():
            parts.append(own[ranked][np.argsort(self.ranks[at[ranked]])])
        return np.concatenate(parts)[:n]


def common_shingles(df: DataFrame, words: int) -> Order:
    """The order of shingles, from those that three documents of a sample share. The sample grows with the table; what reaches the driver does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [_set_of(t, words) for t in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    total = df.count()
    share = max(SHARE, SAMPLE / max(1, total))
    sample = df.select("text", "rid")
    if share < 1:
        sample = sample.where(F.xxhash64("rid") < F.lit(int(share * 2**64) - 2**63))
    seen = durable(sample.select("text").mapInArrow(lean(run), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2"), "common", narrow=True)
    top = seen.orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
    token, n = top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(n))
    order = np.argsort(token)
    marks = np.zeros(0, dtype=np.uint8)
    if len(n) == COMMON:
        # the least frequency that leaves few enough to mark; frequencies above a thousand are one
        counts = sorted((r for r in seen.groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect()), reverse=True)
        kept = np.cumsum([r["count"] for r in counts]) <= MARKED
        least = min((r["n"] for r, k in zip(counts, kept, strict=True) if k), default=1000)
        marks = np.zeros(PAGES * 4096, dtype=np.uint8)
        for r in _survivor_bitmap(seen.where(F.col("n") >= least), "token", PAGES).collect():
            marks[r["__page"] * 4096 : r["__page"] * 4096 + 4096] = np.frombuffer(r["__bits"], dtype=np.uint8)
    return Order(token[order], rank[order], marks)


def _prefix(own: np.ndarray, order: Order, similarity: Fraction) -> np.ndarray:
    """The first shingles of a sorted set, as many as a partner cannot miss."""
    return order.first(own, len(own) + int(-similarity.numerator * len(own) // similarity.denominator) + 1 if len(own) else 0)


def _sketch(own: np.ndarray) -> np.ndarray:
    """The parity of the shingles in each cell, as bytes: sets differ in as many shingles as their sketches in bits, at least.

    The number of cells is a power of two; the two halves of a sketch, one upon the other, make the sketch of half as many.
    """
    cells = max(SKETCH_BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else SKETCH_BITS
    counts = np.bincount((_mix(own, 1) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(bool), bitorder="little")


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def _fp(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _bucketed(rows: DataFrame, emit, schema: str) -> DataFrame:
    """``emit`` on whole buckets: tables of (token, size, node, ...) sorted by these, cut only between tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            if kept and (last or kept[-1].column(0)[0].as_py() != token[0]):
                kept.append(batch.slice(0, last))
                yield from emit(pa.Table.from_batches(kept).combine_chunks())
                kept = []
            elif last:
                yield from emit(pa.Table.from_batches([batch.slice(0, last)]))
            kept.append(batch.slice(last))
        if kept:
            yield from emit(pa.Table.from_batches(kept).combine_chunks())

    return rows.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(lean(run), schema)


def _shared(probes: DataFrame, similarity: Fraction) -> DataFrame:
    """The probes whose bucket has another of a size that can be similar."""
    p, q = similarity.numerator, similarity.denominator

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, size = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        meets = (token[1:] == token[:-1]) & (q * size[:-1] >= p * size[1:])
        yield from rows.filter(pa.array(np.append(meets, False) | np.append(False, meets))).to_batches()

    return _bucketed(probes, emit, "token long, size long, node long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each pair once, the smaller node first."""
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs that sizes and sketches leave possible."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for size, x, y in zip((batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = (np.frombuffer(s, dtype=np.uint8) for s in (x, y))
                n = min(len(x), len(y))
                apart = int(np.bitwise_count((_folded(x, n) ^ _folded(y, n)).view(np.uint64)).sum())
                keep.append((p + q) * apart <= (q - p) * size)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = nodes.select("node", "size", "sketch")
    both = pairs.join(side.toDF("a", "m", "x"), "a").join(side.toDF("b", "n", "y"), "b")
    fits = (F.col("m") * q >= F.col("n") * p) & (F.col("n") * q >= F.col("m") * p)
    return both.where(fits).select("a", "b", "m", "n", "x", "y").mapInArrow(lean(run), "a long, b long")


def _probed_pairs(nodes: DataFrame) -> DataFrame:
    """The candidates of SimHash probes: a forest per bucket, and each node of a fingerprint with the first that has it."""
    prints = durable(nodes.groupBy("print").agg(F.min("node").alias("node")).withColumnRenamed("print", "fp"), "prints", narrow=True)
    equal = nodes.join(prints.select(F.col("fp").alias("print"), F.col("node").alias("a")), "print").where("a <> node").select("a", F.col("node").alias("b"))
    groups, thresholds, hot = plan_probes(prints, BITS, RADIUS, PARTS)
    links = bucket_links(probe_rows(prints, BITS, groups, thresholds, hot, RADIUS), BITS, RADIUS)
    return equal.union(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _other_pairs(shared: DataFrame, similarity: Fraction, once: bool) -> DataFrame:
    """All pairs of a bucket that no links connect yet and that sizes and sketches leave possible; ``once``: of each member the nearest."""
    p, q = similarity.numerator, similarity.denominator

    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, size, node, component = (rows.column(k).to_numpy() for k in range(4))
        sketch = np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
        ends = np.searchsorted(token, token, side="right")
        step = 1
        # all members against the one `step` places on, until no bucket is that long
        at = np.arange(len(token))
        while len(at := at[at + step < ends[at]]):
            at = at[q * size[at] >= p * size[at + step]]  # sizes grow, so later ones do not fit either
            i = at[component[at] != component[at + step]]
            apart = np.bitwise_count(sketch[i] ^ sketch[i + step]).sum(1, dtype=np.int64)
            i = i[(p + q) * apart <= (q - p) * (size[i] + size[i + step])]
            if len(i):
                yield _pairs(node[i], node[i + step])
                at = np.setdiff1d(at, i, assume_unique=True) if once else at
            step += 1

    return _bucketed(shared, emit, "a long, b long").distinct()


def near_groups_by_similarity(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, row_col: str | None = None
) -> DataFrame:
    """``(id, fp, component_id)``, one row per input row; fp is a hash of the row's set of shingles.

    Rows whose sets have a Jaccard similarity of ``similarity`` or more are linked, all of
    them and no others, at any number of rows; ``component_id`` is the smallest id that links reach.
    Sets are of 64-bit hashes; equal sets are one node.

    Rounds keep a large group of near copies from making all its pairs: the first
    verifies what SimHash probes link, at most one pair per member of a bucket; the second, of each member of a bucket of the
    prefix filter, one pair that the links so far do not connect; the last all that the links of both do not connect.

    Cases: as :func:`tessel.llm.simhash.near_groups`; texts without words have equal, empty sets. ``row_col``
    names a number of each row that later scans give again; without it rows are numbered first.
    """
    wanted = Fraction(str(similarity))
    placed = numbered(df, "__rid") if row_col is None else df.withColumn("__rid", F.col(row_col))
    docs = placed.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), F.col("__rid").alias("rid"))
    shared_order = df.sparkSession.sparkContext.broadcast(common_shingles(docs, words))  # at most COMMON ranks and PAGES x 4 KB of marks
    kind = docs.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared_order.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                hashes = [shingle_hashes(t, words) for t in part.column(1).to_pylist()]
                prints = fingerprints_of(hashes, BITS)
                sets = [np.unique(np.array(h, dtype=np.uint64)) for h in hashes]
                del hashes
                columns = [part.column(0), part.column(2), pa.array(map(_fp, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
                sketches = [_sketch(s) for s in sets]
                short = [_folded(x, SKETCH_BITS // 8).tobytes() for x in sketches]
                columns += [_lists([_prefix(s, order, wanted) for s in sets]), *(pa.array(c, pa.binary()) for c in ([x.tobytes() for x in sketches], short, prints))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "rid", "fp", "size", "prefix", "sketch", "short", "print"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [_set_of(t, words) for t in batch.column(1).slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 200), _lists(sets)], names=["node", "shingles"])

    rows = durable(docs.select("id", "text", "rid").mapInArrow(lean(describe), f"id {kind}, rid long, fp binary, size long, prefix array<long>, sketch binary, short binary, print binary"), "sets", texts=True)
    classes = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min("rid").alias("node"), F.count("*").alias("n")), "classes", narrow=True)
    again = durable(rows.join(classes.where("n > 1").select("fp", "node"), "fp").where("rid <> node").select("rid"), "again", narrow=True)
    nodes = rows.join(again, "rid", "left_anti").withColumnRenamed("rid", "node")
    shared = durable(_shared(nodes.select(F.explode("prefix").alias("token"), "size", "node"), wanted), "shared", files_per_core=4)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are as similar as asked for, by the shingles of both; only texts of such pairs are hashed again."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(F.xxhash64("node").alias("k"))
        bitmap = durable(_survivor_bitmap(asked, "k", BITMAP_PAGES), "asked", narrow=True)
        # a row that shares an asked one's bit gives a set that no pair asks for
        texts = _flag(docs.select("rid", "text"), F.xxhash64("rid"), bitmap, BITMAP_PAGES, "__any").where("__any").select("rid", "text")
        sets = durable(texts.mapInArrow(lean(whole), "node long, shingles array<long>"), "asked-sets", files_per_core=4, texts=True)
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n"), (F.size("x") + F.size("y")).cast("long").alias("total"))
        return durable(counted.where(F.col("n") * wanted.denominator >= (F.col("total") - F.col("n")) * wanted.numerator).select("a", "b"), "similar", narrow=True)

    def apart(links: DataFrame) -> DataFrame:
        """The shared probes of buckets that links do not connect, with component and a short sketch."""
        placed = shared.join(connected_components(links), "node", "left").select("token", "size", "node", F.coalesce("component", "node").alias("component"))
        placed = durable(placed, "placed", files_per_core=4)
        open_ = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        return placed.join(open_, "token").join(nodes.select("node", F.col("short").alias("sketch")), "node").select("token", "size", "node", "component", "sketch")

    first = durable(_possible(_probed_pairs(nodes), nodes, wanted), "pairs", narrow=True)
    links, tried = verified(first), first
    for once in (True, False):
        other = _other_pairs(apart(links), wanted, once).join(tried, ["a", "b"], "left_anti")
        other = durable(_possible(other, nodes, wanted), "pairs", narrow=True)
        links, tried = links.union(verified(other)), tried.union(other)
    return _labelled(rows, classes.select("fp", "node", "least"), links, id_col)
