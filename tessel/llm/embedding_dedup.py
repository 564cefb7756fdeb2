"""Near-dedup of embeddings: spherical k-means cells, blocked cosine products within cells, components.

Equal vectors are one node. Each vector is at home in the cell of its nearest
spherical k-means centroid and visits every cell that a link of it can lead to. A
vector counts its links in the homes of its partners, so each is counted once and
no pairs are written: a block of a cell's home members against its visitors gives sums and
a forest of links. Members within half the link angle of a centroid, the cell's core, are all
linked, and a visitor's angle tells which of the core it is surely linked with; these are counted by a
histogram of angles, so a large group of near copies makes no products among its core.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, durable, table
from .components import connected_components

THRESHOLD = 0.95
#: Vectors (smallest hashes first) that the centroids are fitted on; every vector is indexed.
SAMPLE = 20_000
#: Vectors per cell that the number of cells aims at, and home members per block.
CELL, BLOCK = 256, 2048
#: Angular bins of a cell's core, up to half the link angle; all other members are in one more bin.
CORE_BINS = 32
#: Spreads of the difference between partners, along the line between two centroids, that a visit allows for.
SPREADS = 3.0
#: Radians by which computed angles may be off; their arc cosine loses half of a double's digits near zero.
ANGLE_ERROR = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids; x has unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


def _thinned(x: np.ndarray, cosine: float) -> np.ndarray:
    """The rows that no earlier kept row is as close to as ``cosine``: a dense group counts as few."""
    kept = np.zeros((0, x.shape[1]))
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        part = part[(part @ kept.T).max(1, initial=-1) < cosine]
        near = np.tril(part @ part.T >= cosine, -1)
        free = np.zeros(len(part), dtype=bool)
        for j in range(len(part)):
            free[j] = not (near[j] & free).any()
        kept = np.concatenate([kept, part[free]])
    return kept


def _spread_dimensions(x: np.ndarray, c: np.ndarray) -> float:
    """In how many directions members differ from their centroids: the participation ratio of the variances."""
    apart = x - c[_nearest(x, c)]
    values = np.linalg.eigvalsh(apart.T @ apart)
    return float(values.sum() ** 2 / max((values**2).sum(), 1e-300)) if values.sum() > 0 else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Cells:
    """Centroids and the rule of visits.

    Partners x and y with homes A and B lie on either side of the plane halfway
    between the centroids, so y's distance from it is at most the sine of the
    link angle. ``reach`` is the share of that distance that visits allow for: 1 loses no link. Partners differ
    by a vector that has, along the line between the centroids, a spread of its length over the square root
    of the number of directions; reach is ``SPREADS`` such spreads. A core member always has reach 1.
    """

    def __init__(self, centroids: np.ndarray, threshold: float, reach: float):
        self.c, self.reach = centroids, reach
        self.sine = math.sqrt(max(0.0, 1 - threshold * threshold))
        self.angle = math.acos(min(1.0, threshold)) - ANGLE_ERROR
        self.width = self.angle / (2 * CORE_BINS)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's home and its angular bin there; ``CORE_BINS`` is outside the core."""
        dots = x @ self.c.T
        home = dots.argmax(1)
        angle = np.arccos(np.clip(dots[np.arange(len(x)), home], -1, 1))
        return home, np.minimum(angle / self.width if self.width > 0 else np.full(len(x), CORE_BINS), CORE_BINS).astype(np.int64)

    def _reach(self, core: np.ndarray) -> np.ndarray:
        return np.where(core, 1.0, self.reach) * self.sine

    def visits(self, x: np.ndarray, home: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, cell, surely linked bins below)`` of all visits; a row visits its home too."""
        dots = x @ self.c.T
        gap = np.sqrt(np.maximum(2 - 2 * (self.c[home] @ self.c.T), 0))
        row, cell = np.nonzero(dots[np.arange(len(x)), home][:, None] - dots <= self._reach(core)[:, None] * gap + 1e-9)
        angle = np.arccos(np.clip(dots[row, cell], -1, 1))
        return row, cell, np.clip((self.angle - angle) / self.width if self.width > 0 else np.zeros(len(row)), 0, CORE_BINS).astype(np.int64)

    def visited(self, x: np.ndarray, home: np.ndarray, core: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether each row visits the cell beside it."""
        own, other = self.c[home], self.c[cell]
        gap = np.linalg.norm(own - other, axis=1)
        return ((own - other) * x).sum(1) <= self._reach(core) * gap + 1e-9


class Blocks:
    """Home members in groups of neighbouring bins of a cell, of about ``block`` members; a fuller bin is dealt in parts by node."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, block: int):
        self.group = np.zeros(counts.shape, dtype=np.int64)  # by cell and bin; a visitor with s bins surely linked is compared from bin s on
        self.last = np.zeros(len(counts), dtype=np.int64)  # a cell's last group, exclusive
        held: list[int] = []
        for cell, row in enumerate(counts.tolist()):
            held.append(0)
            for b, n in enumerate(row):
                if held[-1] and held[-1] + n > block:
                    held.append(0)
                held[-1] += n
                self.group[cell, b] = len(held) - 1
            self.last[cell] = len(held)
        self.parts = -(-np.array(held, dtype=np.int64) // block)
        self.sure = np.cumsum(np.pad(weights, ((0, 0), (1, 0))), axis=1)  # weight of a cell's first s bins

    @staticmethod
    def part(node: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return ((node * np.int64(2654435761)) >> np.int64(7)) % parts


_DEALT = "key long, role int, node long, n long, home long, bin long, below long, others long, hub long, v array<double>"


def _links_of(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of links from rows to columns: a column of its component for each linked row and column, or -1."""
    row, col = np.nonzero(hits)
    label = np.arange(hits.shape[1])
    if not len(row):
        return np.full(hits.shape[0], -1), np.full(hits.shape[1], -1)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rows = row[starts]
    while True:
        least = np.minimum.reduceat(label[col], starts)
        new = label.copy()
        np.minimum.at(new, col, np.repeat(least, np.diff(np.append(starts, len(row)))))
        new = new[new]
        if (new == label).all():
            break
        label = new
    of_row = np.full(hits.shape[0], -1)
    of_row[rows] = least
    return of_row, np.where(hits.any(0), label, -1)


def embedding_links(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK, spreads: float = SPREADS
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per input row.

    Vectors with a cosine of at least ``threshold`` in double precision are
    linked if one of them visits the other's home. With ``spreads`` at or above the square root of
    the number of directions in which a cell's members differ every link is found; below that, links whose difference
    points more than so many spreads along the line between two centroids can be missed. Vectors that
    are null, empty or zero, that hold a null or non-finite component, or whose length is not
    the table's most frequent one link with nothing. Equal vectors are told by 128 bits of hash.

    Cases: null id - the row's links count, its component is the smallest id in
    reach, or null; repeated rows - links of each other like any equal vectors;
    empty table - no rows; extra columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = durable(df.select(F.col(id_col).alias("id"), F.when(sound, v).alias("v")), "vectors")
    common = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = common["d"] if common else 0
    fits = F.coalesce(F.size("v") == width, F.lit(False)) & F.col("v").isNotNull()
    named = rows.where(fits).select("id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), "v")
    # equal vectors are one node: copies make no pairs
    classes = durable(named.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    drawn = [*bounded_sample(classes.select("k1", "v"), sample, "k1", "v").toPandas()["v"]] if total else [np.ones(1)]
    angle = math.acos(min(1.0, threshold))
    fitted = _thinned(_unit(np.array(drawn)), math.cos(angle / 2))
    centroids = spherical_kmeans(fitted, max(1, min(math.ceil(total / cell), len(fitted) // 4 or 1)))
    cells = Cells(centroids, threshold, min(1.0, spreads / math.sqrt(_spread_dimensions(fitted, centroids))))
    shared = spark.sparkContext.broadcast(cells)  # at most a quarter of the sample

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                home, bins = shared.value.homes(_unit(_matrix(part.column(2))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(bins)], names=["node", "n", "v", "home", "bin"])

    homes = durable(classes.select("node", "n", "v").mapInArrow(settle, "node long, n long, v array<double>, home long, bin long"), "vector-homes")
    # at most CORE_BINS + 1 rows per centroid
    tally = homes.groupBy("home", "bin").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.min("node").alias("least")).collect()
    counts, weights = (np.zeros((len(centroids), CORE_BINS + 1), dtype=np.int64) for _ in range(2))
    hubs = np.full(len(centroids), -1, dtype=np.int64)
    for r in sorted(tally, key=lambda r: -r["bin"]):
        counts[r["home"], r["bin"]], weights[r["home"], r["bin"]] = r["members"], r["weight"]
        if r["bin"] < CORE_BINS:  # a member of the innermost bin: linked with the whole core and with each visitor that has a sure link
            hubs[r["home"]] = r["least"]
    dealing = spark.sparkContext.broadcast((Blocks(counts, weights, block), hubs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, hub_of = dealing.value

        def out(key, role, at, part, below=None, others=None, hub=None, vectors=True):
            take = pa.array(at)
            none = lambda x, kind=pa.int64(): pa.nulls(len(at), kind) if x is None else pa.array(x, kind)
            columns = [pa.array(key), pa.array(np.full(len(at), role, dtype=np.int32)), *(part.column(c).take(take) for c in ("node", "n", "home", "bin")), none(below), none(others), none(hub)]
            columns.append(part.column("v").take(take) if vectors else pa.nulls(len(at), part.column("v").type))
            return pa.RecordBatch.from_arrays(columns, names=["key", "role", "node", "n", "home", "bin", "below", "others", "hub", "v"])

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                node, n, home, bins = (part.column(c).to_numpy() for c in ("node", "n", "home", "bin"))
                group = blocks.group[home, bins]
                yield out((group << 24) + blocks.part(node, blocks.parts[group]), 0, np.arange(len(node)), part)
                row, cell, below = shared.value.visits(_unit(_matrix(part.column("v"))), home, bins < CORE_BINS)
                # the surely linked are counted, and one link to the hub stands for all of them
                sure = blocks.sure[cell, below]
                own = (cell == home[row]) & (bins[row] < below)
                settled = np.flatnonzero((sure - own * n[row] > 0) & (hub_of[cell] >= 0))
                if len(settled):
                    yield out(np.full(len(settled), -1), 2, row[settled], part, others=(sure - own * n[row])[settled], hub=hub_of[cell[settled]], vectors=False)
                first, last = blocks.group[cell, below], blocks.last[cell]
                many = last - first
                at, group = np.repeat(np.arange(len(row)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
                parts = blocks.parts[group]
                at, group, piece = np.repeat(at, parts), np.repeat(group, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                for i in range(0, len(at), 5000):
                    s = at[i : i + 5000]
                    yield out((group[i : i + 5000] << 24) + piece[i : i + 5000], 1, row[s], part, below=below[s])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, members = None, [], None

        def counted(node, others) -> pa.RecordBatch:
            none = pa.nulls(len(node), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(others), none, none], names=["node", "others", "a", "b"])

        def compare(guests: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, x_node, x_n, x_home, x_bin = members
            y_node, y_n, y_home, below = (guests.column(c).to_numpy() for c in ("node", "n", "home", "below"))
            hits = (_unit(_matrix(guests.column("v"))) @ x.T >= threshold) & (y_node[:, None] != x_node) & (x_bin >= below[:, None])
            some = np.flatnonzero(hits.any(1))
            if not len(some):
                return
            yield counted(y_node[some], (hits[some].astype(np.float64) @ x_n.astype(np.float64)).astype(np.int64))
            # a partner that does not visit the guest's home counts the guest here
            i, j = np.nonzero(hits & (y_home != x_home[0])[:, None])
            missed = ~shared.value.visited(x[j], x_home[j], x_bin[j] < CORE_BINS, y_home[i])
            if missed.any():
                yield counted(x_node[j[missed]], y_n[i[missed]])
            of_row, of_col = _links_of(hits)
            a = np.concatenate([y_node[of_row >= 0], x_node[of_col >= 0]])
            b = np.concatenate([x_node[of_row[of_row >= 0]], x_node[of_col[of_col >= 0]]])
            none = pa.nulls(int((a != b).sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(a[a != b]), pa.array(b[a != b])], names=["node", "others", "a", "b"])

        for batch in batches:
            keys, roles = batch.column("key").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])))
            for s, e in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                piece = batch.slice(s, e - s)
                if roles[s] == 2:
                    yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("node", "others", "node", "hub")], names=["node", "others", "a", "b"])
                    continue
                if key != keys[s]:
                    key, held, members = keys[s], [], None
                if roles[s] == 0:
                    held.append(piece)
                    continue
                if members is None:
                    own = pa.Table.from_batches(held).combine_chunks()
                    members = (_unit(_matrix(own.column("v"))), *(own.column(c).to_numpy() for c in ("node", "n", "home", "bin")))
                for at in range(0, piece.num_rows, 512):
                    yield from compare(piece.slice(at, 512))

    dealt = homes.mapInArrow(deal, _DEALT)
    # settled rows need no meeting: their node deals them out
    met = dealt.repartition(F.when(F.col("role") == 2, F.col("node")).otherwise(F.col("key"))).sortWithinPartitions("key", "role")
    found = durable(met.mapInArrow(products, "node long, others long, a long, b long"), "vector-links", files_per_core=4)
    linked = found.where("node is not null").groupBy("node").agg(F.sum("others").alias("others"))
    groups = connected_components(found.where("a is not null and a <> b"))
    of = classes.select("node", "k1", "k2", "least", "n").join(linked, "node", "left").join(groups, "node", "left")
    of = durable(of.select("k1", "k2", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c")), "vector-members", narrow=True)
    least = of.groupBy("c").agg(F.min("least").alias("component_id"))
    placed = named.select("id", "k1", "k2").join(of.join(least, "c").select("k1", "k2", "n_links", "component_id"), ["k1", "k2"])
    with_links = placed.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    # the others never meet in a join
    alone = rows.where(~fits).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return with_links.union(alone).withColumnRenamed("id", id_col)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over each vector and a copy of it whose first component is changed more or less, so that there are links on both sides of the threshold."""
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = found.withColumn("shift", 0.04 * (F.col("vec_id") % 11)).withColumn("moved", F.transform("embedding", lambda x, i: F.when(i == 0, x + F.col("shift")).otherwise(x)))
    return embedding_links(found.union(copies.select(F.col("vec_id") + 1_000_000_000, "moved")))
