"""Removal of repeated passages: every byte of a 200-byte string that also starts anywhere else.

Anchors come first: the gram with the smallest hash in each 200-byte window, so
that equal windows hold equal anchors at equal places. Anchors of one gram with the same
surroundings repeat whole and are counted, not compared. Only where a gram has
different surroundings does it matter how far they agree: there a logarithmic family of
suffix arrays takes the surroundings batch by batch. Each new batch is sorted by
suffix (and by what stands before, read backwards), merge-scanned against the existing levels for matches of full
length, which the common prefixes of neighbours tell, and levels of equal size are merged. A gram with more surroundings than
one task should hold is dealt out by windows, which are counted.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Versions, durable, numbered, table, whole_text
from .exact_dedup import BITMAP_PAGES, _flag, _survivor_bitmap

LENGTH = 200
GRAM = 32
#: A gram with more different surroundings than this, some 16 MB of them, is dealt out by windows instead of meeting in one task.
HOT_GRAM = 16_384
#: Members that a suffix array starts with.
BATCH_MEMBERS = 16_384
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BATCH_BYTES = 2_000_000
_INDEX_BITS = 24


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: int) -> np.uint64:
    return np.uint64(pow(base, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, by position."""
    n = len(data)
    if n < gram:
        return np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE), out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * _powers(n - gram + 1, _inverse(int(_BASE)))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by first position."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document number, position, gram hash)`` of the anchors of some documents."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    width = length - gram + 1
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty.astype(np.uint64)
    if len(data) >= 1 << _INDEX_BITS:
        raise ValueError("too long for one piece")
    h = gram_hashes(data, gram)
    # the position in the low bits breaks ties for the leftmost and tells where the minimum is
    low = np.uint64((1 << _INDEX_BITS) - 1)
    least = _window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= (starts + sizes)[doc]  # windows that end in their document
    at = np.unique(least[inside]).astype(np.int64)
    of = np.searchsorted(starts + sizes, at, "right")
    return of, at - starts[of], h[at]


def document_anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of a document of any length, in overlapping pieces."""
    step, at, seen, hashes = 1 << (_INDEX_BITS - 1), 0, [], []
    while at == 0 or at + length <= len(text):
        _, p, h = anchors([text[at : at + step + length - 1]], length, gram)
        seen.append(p + at)
        hashes.append(h)
        at += step
    p, h = np.concatenate(seen), np.concatenate(hashes)
    p, first = np.unique(p, return_index=True)
    return p, h[first]


def _surroundings(text: bytes, at: int, length: int, gram: int) -> tuple[bytes, int]:
    """The bytes of all windows that hold the gram, and how many stand before it."""
    lo = max(0, at - (length - gram))
    return text[lo : at + length], at - lo


def _combined(gram: np.ndarray, around: np.ndarray) -> np.ndarray:
    """How many equal pairs there are, at each one's first place; 0 at the others."""
    order = np.lexsort((around, gram))
    first = np.flatnonzero(np.append(True, (gram[order[1:]] != gram[order[:-1]]) | (around[order[1:]] != around[order[:-1]])))[: len(order)]
    n = np.zeros(len(gram), dtype=np.int64)
    n[order[first]] = np.diff(np.append(first, len(order)))
    return n


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(gram, around, rid, pos, n)``: each anchor with the hash of its surroundings.

    Equal ones of some neighbouring documents are one row with their number ``n``, and rows with n = 0 for the others: a line that fills
    documents, or a copy beside its original, is known to repeat where it stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            rid = batch.column(0).to_numpy()
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            group: list[int] = []
            size = 0
            for i in [*range(len(texts)), None]:
                if group and (i is None or size + len(texts[i]) > _BATCH_BYTES):
                    if size >= 1 << (_INDEX_BITS - 1):
                        pos, h = document_anchors(texts[group[0]], length, gram)
                        of = np.zeros(len(pos), dtype=np.int64)
                    else:
                        of, pos, h = anchors([texts[g] for g in group], length, gram)
                    around = []
                    for d, p in zip(of.tolist(), pos.tolist(), strict=True):
                        piece, left = _surroundings(texts[group[d]], p, length, gram)
                        around.append(xxhash.xxh3_64_intdigest(piece, left))
                    seen = h.view(np.int64), np.array(around, dtype=np.uint64).view(np.int64)
                    columns = [*seen, rid[np.array(group)][of], pos, _combined(*seen)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "around", "rid", "pos", "n"])
                    group, size = [], 0
                if i is not None:
                    group.append(i)
                    size += len(texts[i])

    return docs.select("rid", "text").mapInArrow(run, "gram long, around long, rid long, pos long, n long")


def _order(keys: np.ndarray) -> np.ndarray:
    """The rows' order by their bytes; runs in order are merged, not sorted again."""
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def _agreement(keys: np.ndarray) -> np.ndarray:
    """How many first bytes each row has in common with the row before; -1 for the first."""
    out = np.full(len(keys), -1, dtype=np.int64)
    for at in range(1, len(keys), 20_000):
        unlike = keys[at : at + 20_000] != keys[at - 1 : at - 1 + len(keys[at : at + 20_000])]
        out[at : at + 20_000] = np.where(unlike.any(1), unlike.argmax(1), keys.shape[1])
    return out


class SuffixLevels:
    """A logarithmic family of sorted suffix arrays over surroundings.

    ``after`` holds, for each member, its gram's hash and the bytes from the gram
    on, ``before`` the hash and the bytes before the gram read backwards; ``sizes`` how many of them there are. A
    level is a set of members in the order of either. ``repeated[i, a]``: the window of member
    i that begins ``a`` bytes before the gram is another member's too.
    """

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.reach, self.tag, self.gram = length - gram, 8, gram
        self.before = np.zeros((0, self.tag + self.reach), dtype=np.uint8)
        self.after = np.zeros((0, self.tag + length), dtype=np.uint8)
        self.sizes = np.zeros((0, 2), dtype=np.int64)
        self.hash = np.zeros(0, dtype=np.int64)
        self.repeated = np.zeros((0, self.reach + 1), dtype=bool)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, gram: np.ndarray, before: np.ndarray, after: np.ndarray, sizes: np.ndarray) -> None:
        """Take a batch: bytes before each gram read backwards, bytes from it on, and how many of both, without the gram's."""
        first = len(self.hash)
        tag = gram.astype(">i8").view(np.uint8).reshape(-1, self.tag)
        self.hash = np.concatenate([self.hash, gram])
        self.before = np.concatenate([self.before, np.concatenate([tag, before], axis=1)])
        self.after = np.concatenate([self.after, np.concatenate([tag, after], axis=1)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.repeated = np.concatenate([self.repeated, np.zeros((len(gram), self.reach + 1), dtype=bool)])
        fresh = np.arange(first, first + len(gram))
        new = self._level(fresh, fresh)
        self._scan(*new)
        grams = np.unique(gram)
        for right, left in self.levels:
            met = [side[np.isin(self.hash[side], grams)] for side in (right, left)]
            if len(met[0]):
                seen = np.isin(gram, self.hash[met[0]])
                self._scan(*self._level(*(np.concatenate([old, own[seen[own - first]]]) for old, own in zip(met, new, strict=True))))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            one, two = self.levels.pop(), self.levels.pop()
            self.levels.append(self._level(*(np.concatenate([x, y]) for x, y in zip(two, one, strict=True))))

    def _level(self, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members by what stands from the gram on and by what stands before it; each comes as runs in order."""
        return right[_order(self.after[right])], left[_order(self.before[left])]

    def _scan(self, right: np.ndarray, left: np.ndarray) -> None:
        """Mark the windows that two of these members share.

        In either order, members that agree in their first bytes are neighbours, and how far is the least agreement
        from one neighbour to the next. A window that begins a bytes before the gram is shared by those that agree
        in a bytes before and in the rest after it.
        """
        agree = {}
        for name, order, keys, known in (("right", right, self.after, self.tag + self.gram), ("left", left, self.before, self.tag)):
            agree[name] = np.maximum(_agreement(keys[order]) - known, -1)
        best = np.full((2, len(self.hash)), -1, dtype=np.int64)
        for k, (name, order) in enumerate((("left", left), ("right", right))):
            near = np.maximum(agree[name], np.append(agree[name][1:], -1))
            best[k, order] = np.minimum(near, self.sizes[order, k])
        hopeful = (best[0] >= 0) & (best[1] >= 0) & (best[0] + best[1] >= self.reach)
        place = np.full(len(self.hash), -1, dtype=np.int64)
        orders = {}
        for name, order in (("right", right), ("left", left)):
            kept = np.flatnonzero(hopeful[order])
            if not len(kept):
                return
            # between two that are left the agreement is the least on the way
            least = np.minimum.reduceat(np.append(agree[name], -1), np.stack([np.append(-1, kept[:-1]) + 1, kept + 1], axis=1).ravel())[::2]
            orders[name] = (order[kept], least)
        members = orders["right"][0]
        place[members] = np.arange(len(members))
        lows, highs = self.reach - best[1, members], best[0, members]
        at_left = place[orders["left"][0]]
        for a in range(int(lows.min()), int(highs.max()) + 1):
            inside = np.flatnonzero((lows <= a) & (a <= highs))
            if len(inside) < 2:
                continue
            same_after = np.cumsum(orders["right"][1] < self.reach - a)
            same_before = np.empty(len(members), dtype=np.int64)
            same_before[at_left] = np.cumsum(orders["left"][1] < a)
            both = same_after[inside] * (len(members) + 1) + same_before[inside]
            by = np.argsort(both, kind="stable")
            equal = both[by[1:]] == both[by[:-1]]
            self.repeated[members[inside[by[np.append(equal, False) | np.append(False, equal)]]], a] = True


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first, last)`` of each run of true."""
    padded = np.pad(flags.astype(np.int8), ((0, 0), (1, 1)))
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return row, first, last - 1


def _settle(surroundings: DataFrame, length: int, gram: int) -> DataFrame:
    """``(rid, first, last)``: ranges of window starts that repeat, for members that stand once."""
    reach = length - gram

    def take(index: SuffixLevels, held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        left, pieces = rows.column("left").to_numpy(), rows.column("piece").to_pylist()
        size = np.array([len(p) for p in pieces])
        before, after = np.zeros((len(pieces), reach), dtype=np.uint8), np.zeros((len(pieces), length), dtype=np.uint8)
        for i, (piece, x) in enumerate(zip(pieces, left.tolist(), strict=True)):
            data = np.frombuffer(piece, dtype=np.uint8)
            before[i, :x] = data[:x][::-1]
            after[i, : len(data) - x] = data[x:]
        index.add(rows.column("gram").to_numpy(), before, after, np.stack([left, size - left - gram], axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, seen = SuffixLevels(length, gram), [], []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                seen.append(batch.select(["n", "rid", "pos"]))
            if sum(b.num_rows for b in held) >= BATCH_MEMBERS:
                take(index, held)
                held = []
        if held:
            take(index, held)
        if seen:
            single, rid, pos = (np.concatenate([b.column(k).to_numpy() for b in seen]) for k in range(3))
            at, first, last = _runs(index.repeated & (single == 1)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(pos[at] - last), pa.array(pos[at] - first)], names=["rid", "first", "last"])

    return surroundings.select("gram", "n", "rid", "pos", "left", "piece").repartition("gram").mapInArrow(run, "rid long, first long, last long")


def _settle_hot(surroundings: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for grams with very many surroundings, by counting, on 128 bits of hash; counts are combined before each shuffle.

    Windows are told by how many bytes they begin before the gram and come in
    stripes of neighbours. What a stripe's windows have in common lies within each of them, so
    only members that share it with another can share one of its windows; those
    members' windows are then counted one by one.
    """
    reach = length - gram
    stripe = max(1, math.isqrt(reach + 1))

    def windows(left: int, size: int, k: int) -> range:
        return range(max(k * stripe, left + length - size), min(k * stripe + stripe - 1, reach, left) + 1)

    def told(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        """Rows of a key first, then the spot: of a key with several spots here all are known to repeat, and the first one speaks for the others."""
        spots: dict[bytes, set] = {}
        for r in rows:
            spots.setdefault(r[0], set()).add(r[1:3])
        spoken: set[bytes] = set()
        columns: list[list] = [[] for _ in range(len(names) + 1)]
        for r in rows:
            columns[0].append(None if r[0] in spoken else r[0])
            spoken.add(r[0])
            for c, x in zip(columns[1:-1], r[1:], strict=True):
                c.append(x)
            columns[-1].append(len(spots[r[0]]) > 1)
        kinds = [pa.binary(), *[pa.int64()] * (len(names) - 1), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*names, "known"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = []
            for rid, pos, left, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(reach // stripe + 1):
                    if windows(left, len(piece), k):
                        shared = piece[left - k * stripe : left - min(k * stripe + stripe - 1, reach) + length]
                        out.append((xxhash.xxh3_128_digest(shared, k), rid, pos, k))
            yield told(out, ["key", "rid", "pos", "k"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            out = []
            for n, rid, pos, left, piece, stripes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in stripes:
                    for a in windows(left, len(piece), k):
                        window = piece[left - a : left - a + length]
                        out.append((xxhash.xxh3_128_digest(window), rid, pos - a, n))
            yield told(out, ["key", "rid", "start", "n"])

    def repeated(rows: DataFrame, *spot: str) -> DataFrame:
        """Rows whose key has another spot, there or known."""
        keys = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(*spot)).alias("a"), F.max(F.struct(*spot)).alias("b")).where("a <> b").select("key")
        return rows.where("known").union(rows.where("not known").join(keys, "key").select(*rows.columns))

    rows = durable(surroundings.select("rid", "pos", "left", "piece").mapInArrow(common, "key binary, rid long, pos long, k long, known boolean"), "stripes", files_per_core=4)
    stripes = repeated(rows, "rid", "pos").groupBy("rid", "pos").agg(F.collect_list("k").alias("stripes"))
    asked = surroundings.join(stripes, ["rid", "pos"]).select("n", "rid", "pos", "left", "piece", "stripes")
    rows = durable(asked.mapInArrow(single, "key binary, rid long, start long, n long, known boolean"), "windows", files_per_core=4)
    return repeated(rows, "rid", "start").where("n = 1").select("rid", F.col("start").alias("first"), F.col("start").alias("last"))


def _kept(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and the rest, from byte ranges with exclusive ends."""
    order = np.argsort(first)
    first, reach = first[order], np.maximum.accumulate(last[order])
    fresh = np.append(True, first[1:] > reach[:-1])
    begin, end = first[fresh], reach[np.append(fresh[1:], True)]
    cuts = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
    rest = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return len(text) - len(rest), len(begin), rest


def _repeats(docs: DataFrame, found: DataFrame, length: int, gram: int, pages: int) -> DataFrame:
    """``(rid, first, last)``: ranges of the starts of strings that stand more than once; those of whole surroundings may reach beyond their document."""
    spot = F.struct("rid", "pos")
    classes = durable(found.where("n > 0").groupBy("gram", "around").agg(F.sum("n").alias("n"), F.min(spot).alias("at")).select("gram", "around", "n", "at.rid", "at.pos"), "anchor-classes", files_per_core=4)
    various = classes.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1")
    asked = durable(classes.join(various, "gram").groupBy("rid").agg(F.collect_list(F.struct("gram", "n", "pos", "d")).alias("asked")), "asked", files_per_core=4)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "replace")
                pieces = [_surroundings(data, w["pos"], length, gram) for w in wanted]
                numbers = [pa.array([w[k] for w in wanted], pa.int64()) for k in ("gram", "n", "pos", "d")]
                yield pa.RecordBatch.from_arrays(
                    [*numbers, pa.array([rid] * len(wanted), pa.int64()), pa.array([x for _, x in pieces], pa.int64()), pa.array([p for p, _ in pieces], pa.binary())], names=["gram", "n", "pos", "d", "rid", "left", "piece"]
                )

    texts = _with_any(docs.select("rid", "text"), asked.select("rid"), pages)
    surroundings = durable(texts.join(asked, "rid").select("rid", "text", "asked").mapInArrow(fetch, "gram long, n long, pos long, d long, rid long, left long, piece binary"), "surroundings", files_per_core=4, texts=True)
    settled = _settle(surroundings.where(F.col("d") <= HOT_GRAM), length, gram).union(_settle_hot(surroundings.where(F.col("d") > HOT_GRAM), length, gram))
    again = found.where("n = 1").join(classes.where("n > 1").select("gram", "around"), ["gram", "around"]).select("rid", "pos").union(found.where("n <> 1").select("rid", "pos"))
    whole = again.select("rid", (F.col("pos") - (length - gram)).alias("first"), F.col("pos").alias("last"))
    return settled.union(whole)


def _removed(docs: DataFrame, ranges: DataFrame, id_col: str, length: int, keep_text: bool, pages: int) -> DataFrame:
    """What :func:`remove_repeats` returns, from the ranges."""
    spans = durable(ranges.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans", files_per_core=4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, removed, runs, sha, rest = [], [], [], [], []
            firsts, lasts = batch.column(2), batch.column(3)
            edges = firsts.offsets.to_numpy() - firsts.offsets[0].as_py()
            first, last = (c.flatten().to_numpy(zero_copy_only=False) for c in (firsts, lasts))
            for r, text, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), edges[:-1], edges[1:], strict=True):
                data = text.encode("utf-8", "replace")
                # window starts to bytes; whole surroundings are clipped to the document
                n, k, left = _kept(data, np.maximum(first[a:b], 0), np.minimum(last[a:b], len(data) - length) + length)
                rid.append(r)
                removed.append(n)
                runs.append(k)
                sha.append(hashlib.sha256(left).hexdigest())
                rest.append(left if keep_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())], names=["rid", "n_removed", "n_spans", "sha", "rest"])

    texts = _with_any(docs.select("rid", "text"), spans.select("rid"), pages)
    changed = texts.join(spans, "rid").select("rid", "text", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts")).mapInArrow(cut, "rid long, n_removed long, n_spans long, sha string, rest binary")
    all_rows = docs.select("rid", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha"), *([F.col("text").cast("binary").alias("whole_text")] if keep_text else []))
    out = all_rows.join(changed, "rid", "left")
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"),
        *([F.coalesce("rest", "whole_text").alias("kept")] if keep_text else []),
    )


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, pages: int = BITMAP_PAGES) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)``, and what is left of the text if asked for, one row per input row.

    Strings are judged on the input's UTF-8 bytes and within documents; what is
    left may end within a character, so the kept text is binary.

    Cases: null, empty and shorter texts - nothing removed; repeated rows - documents that repeat each other;
    null ids - rows like any other; texts of any length are read whole; empty table - no rows; extra columns are ignored.
    """
    docs = numbered(df, "__rid").select(F.col("__rid").alias("rid"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = durable(_anchor_rows(docs, length, gram), "anchors", texts=True)
    return _removed(docs, _repeats(docs, found, length, gram, pages), id_col, length, keep_text, pages)


class SuffixFamily(Versions):
    """Repeated strings over batches that come one after another, kept under a shared path.

    A level holds its documents and their anchors, sorted by gram. A new batch is matched within itself and
    against each level, of which only the anchors of the batch's own grams are read on; then
    levels of nearly equal size are merged, so that there are about as many as the logarithm of the number of batches, and each anchor is
    written as often. The ranges found so far are kept, so nothing is matched twice.

    Cases: as :func:`remove_repeats`; a batch whose id was added before changes nothing; an empty batch is a batch. Two
    writers may add at once: the second one to finish matches its batch against the new family again.
    """

    EMPTY = {"version": 0, "levels": [], "ranges": []}
    DOCS, FOUND, RANGES = "rid long, id {0}, text string", "gram long, around long, rid long, pos long, n long", "rid long, first long, last long"

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, gram: int = GRAM, pages: int = BITMAP_PAGES):
        super().__init__(spark, path)
        self.length, self.gram, self.pages = length, gram, pages

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: str) -> DataFrame:
        rows = self.spark.createDataFrame([], schema)
        for name in names:
            rows = rows.union(self.spark.read.schema(schema).parquet(f"{self.path}/{name}"))
        return rows

    def add(self, batch_id: str, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Take a batch once. False: it was added before, and nothing changes."""
        self._latest()
        if self._applied(batch_id):
            return False
        kind = df.schema[id_col].dataType.simpleString()
        texts = self.spark.read.schema(f"id {kind}, text string").parquet(f"{self.path}/{self._write(df.select(F.col(id_col).alias('id'), whole_text(text_col).alias('text')), 'batches')}")
        while True:
            now = self._latest()
            if self._applied(batch_id):
                return False
            number = now["version"] + 1
            if number >= 512:
                raise ValueError("numbers of rows have room for 511 batches")
            own = numbered(texts, "rid").select((F.col("rid") + F.lit(number << 54)).alias("rid"), "id", "text")
            level = {"docs": [self._write(own, "docs")], "kind": kind}
            docs = self._read(level["docs"], self.DOCS.format(kind))
            level["found"] = self._write(self._sorted(durable(_anchor_rows(docs, self.length, self.gram), "anchors", texts=True)), "found")
            found = self._read([level["found"]], self.FOUND)
            level["rows"] = found.count()
            ranges = [_repeats(docs, found, self.length, self.gram, self.pages)]
            grams = durable(found.select("gram").distinct(), "grams", files_per_core=1)
            for old in now["levels"]:
                met = durable(self._read([old["found"]], self.FOUND).where("n > 0").join(grams, "gram", "left_semi"), "met", files_per_core=1)
                theirs = found.where("n > 0").join(met.select("gram").distinct(), "gram", "left_semi")
                both = durable(met.union(theirs), "both", files_per_core=1)
                ranges.append(_repeats(self._read(old["docs"], self.DOCS.format(kind)).union(docs), both, self.length, self.gram, self.pages))
            every = ranges[0]
            for more in ranges[1:]:
                every = every.union(more)
            levels = [*now["levels"], level]
            while len(levels) > 1 and levels[-2]["rows"] < 2 * levels[-1]["rows"]:
                two = levels[-2:]
                merged = self._write(self._sorted(self._read([x["found"] for x in two], self.FOUND)), "found")
                levels[-2:] = [{"docs": two[0]["docs"] + two[1]["docs"], "kind": kind, "found": merged, "rows": two[0]["rows"] + two[1]["rows"]}]
            if self._publish({"version": number, "batch": batch_id, "levels": levels, "ranges": [*now["ranges"], self._write(every, "ranges")]}):
                return True

    @staticmethod
    def _sorted(found: DataFrame) -> DataFrame:
        """In the order of grams, so that statistics of the files tell where a gram can be."""
        return found.repartitionByRange("gram", "around", "rid").sortWithinPartitions("gram", "around")

    def result(self, id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
        """What :func:`remove_repeats` returns for all batches' rows together."""
        now = self._latest()
        if not now["levels"]:
            raise ValueError("no batch yet")
        docs = self._read([d for level in now["levels"] for d in level["docs"]], self.DOCS.format(now["levels"][0]["kind"]))
        return _removed(docs, self._read(now["ranges"], self.RANGES), id_col, self.length, keep_text, self.pages)


def _with_any(docs: DataFrame, rids: DataFrame, pages: int) -> DataFrame:
    """The documents that may be among ``rids``, by a bitmap of fixed size, so that the others' texts are not shuffled."""
    bitmap = durable(_survivor_bitmap(rids.select(F.xxhash64("rid").alias("k")), "k", pages), "rids", narrow=True)
    return _flag(docs, F.xxhash64("rid"), bitmap, pages, "__any").where("__any").drop("__any")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
