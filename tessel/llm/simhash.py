"""SimHash near-dedup: fingerprints, generalised pigeonhole probes, components.

The fingerprint's bits are grouped into partitions of correlated bits. Each
partition gets a threshold of its own, chosen by dynamic programming on the
candidate counts that the partition's value histogram predicts, such that the
thresholds add up to ``radius - parts + 1``: two fingerprints within ``radius``
bits then differ in at most that many bits of some partition, so probing each
partition's values within its threshold finds every link. Probes that meet in a
bucket are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .components import connected_components

SEED = 42
#: Buckets with more members than this are probed again by the bits outside the bucket's partition.
HOT_BUCKET = 4096
_LANES = np.uint64(0x0101010101010101)


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64-bit hashes of a shingle, made from its first; word 0 is the hash itself."""
    if not word:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle of lower-cased words, repeats included; fewer words than a shingle give one."""
    w = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return []
    if len(w) < words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), repeat(SEED)))


def _majorities(hashes: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``bits`` booleans per document: set in over half of its hashes. Counts are the documents' hash counts, none zero."""
    ends = np.cumsum(counts)
    starts = ends - counts
    # byte lanes hold at most 255, so long documents are summed in slices
    slices = -(-counts // 255)
    first = np.cumsum(slices) - slices
    at = np.repeat(starts, slices) + 255 * (np.arange(slices.sum()) - np.repeat(first, slices))
    out = np.empty((len(counts), bits), dtype=bool)
    for word in range(bits // 64):
        h = _mix(hashes, word)
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, at)
            each = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            total = np.add.reduceat(each, first, axis=0)
            out[:, [64 * word + 8 * b + k for b in range(8)]] = 2 * total > counts[:, None]
    return out


def fingerprints_of(got: list[list[int]], bits: int) -> list[bytes]:
    """Big-endian fingerprints of some documents' shingle hashes; documents without words get zero."""
    out = [bytes(bits // 8)] * len(got)
    full = [i for i, h in enumerate(got) if h]
    # a few million hashes at a time bound the memory
    batch, size = [], 0
    for i in [*full, None]:
        if i is None or size + len(got[i]) > 1_000_000:
            if batch:
                counts = np.array([len(got[j]) for j in batch])
                hashes = np.fromiter((x for j in batch for x in got[j]), dtype=np.uint64, count=size)
                packed = np.packbits(_majorities(hashes, counts, bits), axis=1, bitorder="little")[:, ::-1]
                for j, row in zip(batch, packed, strict=True):
                    out[j] = row.tobytes()
            batch, size = [], 0
        if i is not None:
            batch.append(i)
            size += len(got[i])
    return out


def fingerprints(texts: list[str | None], bits: int, words: int) -> list[bytes]:
    """Big-endian fingerprints; texts without words get zero."""
    return fingerprints_of([shingle_hashes(t or "", words) for t in texts], bits)


def with_fingerprint(df: DataFrame, id_col: str, text_col: str, bits: int, words: int) -> DataFrame:
    """``(id, fp)`` per row, fp binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                fps = fingerprints(part.column(1).to_pylist(), bits, words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def _bits_of(column: pa.Array, bits: int) -> np.ndarray:
    """Bits by number, least first."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, bits // 8)[:, ::-1]
    return np.unpackbits(raw, axis=1, bitorder="little")


def correlated_parts(classes: DataFrame, bits: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, correlated bits together.

    The bits' joint counts are summed over all fingerprints (bits x bits numbers);
    each group starts with the free bit that has the strongest tie to any other and grows by the strongest mean tie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits, bits)), 0
        for batch in batches:
            b = _bits_of(batch.column(0), bits).astype(np.float32)
            total += b.T @ b
            n += len(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits * bits + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    sums = dict(classes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    joint = np.array([sums.get(i, 0) for i in range(bits * bits)], dtype=float).reshape(bits, bits) / max(1, sums.get(bits * bits, 0))
    mean = np.diag(joint)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tie = np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = list(range(bits)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda i: (tie[i, free].max(), -i))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda i: (tie[i, group].mean(), -i)))
            free.remove(group[-1])
        out.append(sorted(group))
    return out


def _values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def _flips(width: int, threshold: int) -> np.ndarray:
    """Masks of all values within ``threshold`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(threshold + 1) for c in combinations(range(width), k)], dtype=np.int64)


def allocate_thresholds(candidates: list[list[float]], radius: int) -> list[int]:
    """A threshold of -1 (leave out), 0, 1, ... per partition that adds up to ``radius - parts + 1`` at the least cost.

    ``candidates[i][t + 1]`` is what partition i costs at threshold t. The dynamic
    program goes over partitions and the sum so far.
    """
    parts = len(candidates)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in candidates:
        then: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(costs) - 1):
                new = (cost + costs[t + 1], [*chosen, t])
                if total + t not in then or new < then[total + t]:
                    then[total + t] = new
        best = then
    return best[radius - parts + 1][1]


def plan_probes(classes: DataFrame, bits: int, radius: int, parts: int) -> tuple[list[list[int]], list[int], set[int]]:
    """Partitions, thresholds, and the keys of hot buckets, from the value histograms of all fingerprints.

    A histogram has at most 2^16 values a partition, so what reaches the driver is bounded.
    """
    groups = correlated_parts(classes, bits, parts)
    assert max(map(len, groups)) <= 16, "histograms need partitions of at most 16 bits"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bits_of(batch.column(0), bits)
            for i, g in enumerate(groups):
                v, n = np.unique(_values(b, g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v + (i << 48)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = classes.select("fp").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    histograms = np.zeros((parts, 1 << 16))
    key = counted["key"].to_numpy(dtype=np.int64)
    histograms[key >> 48, key & 0xFFFF] = counted["n"].to_numpy()
    costs, near = [], []
    for i, g in enumerate(groups):
        h, row, within = histograms[i, : 1 << len(g)], [0.0], {}
        for t in range(min(radius, 2) + 1):
            flips = _flips(len(g), t)
            around = sum(h[np.arange(len(h)) ^ f] for f in flips)
            within[t] = around
            row.append(float(h @ around) + len(flips) * h.sum())  # pairs to verify and probes to send
        costs.append(row)
        near.append(within)
    thresholds = allocate_thresholds(costs, radius)
    hot = {(i << 48) + int(v) for i, t in enumerate(thresholds) if t >= 0 for v in np.flatnonzero(near[i][t] > HOT_BUCKET)}
    return groups, thresholds, hot


def probe_rows(classes: DataFrame, bits: int, groups: list[list[int]], thresholds: list[int], hot: set[int], radius: int) -> DataFrame:
    """``(key, node, fp)``: each fingerprint under the keys of its probes.

    In a hot bucket all bits of one partition agree, up to its threshold; the
    other bits are cut in ``radius + 1`` slices, one of which must agree
    exactly, and the bucket's key is joined with each slice's value: an exact way for buckets of any size.
    """
    hot_keys = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bits_of(batch.column(1), bits)
            for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                own = _values(b, g)
                for flip in _flips(len(g), t):
                    keys = (own ^ flip) + (i << 48)
                    busy = np.isin(keys, hot_keys)
                    rest = [x for x in range(bits) if x not in g]
                    cut = [(~busy, keys)] if not busy.all() else []
                    if busy.any():
                        for s in range(radius + 1):
                            piece = rest[s :: radius + 1]
                            cut.append((busy, _mix(_mix(keys.astype(np.uint64), s + 1) ^ _values(b, piece).astype(np.uint64), 1).view(np.int64)))
                    for mask, named in cut:
                        rows = pa.array(np.flatnonzero(mask))
                        yield pa.RecordBatch.from_arrays([pa.array(named[mask]), batch.column(0).take(rows), batch.column(1).take(rows)], names=["key", "node", "fp"])

    return classes.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def _forest(words: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius``: a search that compares each member with those not yet reached."""
    left, out, todo = np.arange(len(nodes)), [], []
    while len(left):
        if todo:
            q = todo.pop()
        else:
            q, left = left[0], left[1:]
        near = np.bitwise_count(words[left] ^ words[q]).sum(1) <= radius
        for i in left[near]:
            out.append((int(nodes[q]), int(nodes[i])))
            todo.append(i)
        left = left[~near]
    return out


def bucket_links(probes: DataFrame, bits: int, radius: int) -> DataFrame:
    """``(a, b)``: within each bucket, verified links that connect all that are linked; at most one a member.

    Buckets come sorted, so a task holds one bucket at a time; a bucket that Arrow batches cut is carried over.
    """

    def links(words: np.ndarray, keys: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
        a, b = [], []
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]  # most buckets: one comparison, all at once
        near = two[np.bitwise_count(words[two] ^ words[two + 1]).sum(1) <= radius]
        a += nodes[near].tolist()
        b += nodes[near + 1].tolist()
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            for x, y in _forest(words[s : s + n], nodes[s : s + n], radius):
                a.append(x)
                b.append(y)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def emit(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            keys, nodes, words = (np.concatenate([p[k] for p in parts]) for k in range(3))
            a, b = links(words, keys, nodes)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, bits // 64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield emit([*kept, (keys[:last], nodes[:last], words[:last])])
                kept = []
            elif kept and kept[-1][0][-1] != keys[0]:
                yield emit(kept)
                kept = []
            kept.append((keys[last:], nodes[last:], words[last:]))
        if kept:
            yield emit(kept)

    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64, radius: int = 3, parts: int = 4
) -> DataFrame:
    """``(id, fp, component_id)``, one row per input row; an id column named as one of the others gives way to it as ``id``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id that links reach. Equal fingerprints
    are one node, however many rows have them, and links between nodes are a
    forest per bucket, so a large group of copies makes neither pairs nor a hot task.
    With at most 16 bits a partition and 4 partitions the probes miss no link.

    Cases: null or blank text - fingerprint zero, linked like any other; null id
    - the row is linked, and ``component_id`` is null only if no row in reach has an
    id; repeated rows - a row each; empty table - no rows; extra columns are ignored.
    """
    rows = durable(with_fingerprint(df, id_col, text_col, bits, words), "fingerprints", texts=True)
    marked = rows.groupBy("fp").agg(F.min("id").alias("least"))
    classes = durable(marked.withColumn("node", F.monotonically_increasing_id()), "classes", narrow=True)
    groups, thresholds, hot = plan_probes(classes, bits, radius, parts)
    links = bucket_links(probe_rows(classes, bits, groups, thresholds, hot, radius), bits, radius)
    return _labelled(rows, classes, links, id_col)


def _labelled(rows: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    found = connected_components(links)
    of = durable(classes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("c")), "members", narrow=True)
    least = of.groupBy("c").agg(F.min("least").alias("component_id"))
    name = "id" if id_col in ("fp", "component_id") else id_col
    return rows.join(of.join(least, "c").select("fp", "component_id"), "fp").select(F.col("id").alias(name), "fp", "component_id")


def near_groups_by_similarity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, row_col: str | None = None) -> DataFrame:
    """``(id, fp, component_id)`` as :func:`near_groups`, for word shingles and a Jaccard similarity, decided on the sets of shingles.

    Cases: as :func:`near_groups`. ``row_col`` names a number of each row that later scans give again, if there is one.
    """
    from .shingle_join import near_groups_by_similarity as by_sets  # which uses this module

    return by_sets(df, id_col, text_col, words, similarity, row_col)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
