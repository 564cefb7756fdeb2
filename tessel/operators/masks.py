"""Row selections as run-length ranges, positions or boolean columns, and their algebra, over DataFrames.

Ranges are ``(start, end)``, inclusive, sorted and apart; positions are ``(pos)``;
plain masks are ``(pos, bit)`` with every position. Positions from 0 are cut in
cells of ``CELL``; runs are found per cell and stitched, and ranges meet by cell, so that no
step gathers all rows in one task: only the cells' summaries, a row each, pass through a single window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError
from tessel.sources.shared import written

CELL = 1 << 16


def check_ranges(r: DataFrame) -> DataFrame:
    """The faults of a table of ranges: negative, upside down, or overlapping the one before. No rows if it is sound."""
    bad = r.where("start < 0 or end < start or start is null or end is null").select("start", "end", F.lit("bounds").alias("fault"))
    pieces = _cells(r)
    w = Window.partitionBy("cell").orderBy("start", "end")
    overlap = pieces.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before >= start").select("start", "end", F.lit("overlap").alias("fault"))
    return bad.union(overlap).distinct()


def _cells(r: DataFrame) -> DataFrame:
    """Each range once per cell that it touches."""
    return r.where("end >= start").withColumn("cell", F.explode(F.expr(f"sequence(floor(start / {CELL}), floor(end / {CELL}))")))


def lengths(r: DataFrame) -> DataFrame:
    return r.select("start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def _islands(pieces: DataFrame) -> DataFrame:
    """Merge ranges that overlap or touch: within cells first, then across the cells' ends.

    ``pieces`` lie within one cell each. What crosses cells are only pieces that reach a cell's
    end and those at the next one's start, at most two rows a cell.
    """
    cut = pieces.withColumn("cell", F.floor(F.col("start") / CELL))
    w = Window.partitionBy("cell").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.withColumn("fresh", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1)))
    merged = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("cell", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    edge = ((F.col("end") + 1) % CELL == 0) | (F.col("start") % CELL == 0)
    inner, outer = merged.where(~edge).select("start", "end"), merged.where(edge).select("start", "end")
    line = Window.orderBy("start")
    fresh = F.coalesce((F.col("start") > F.lag("end").over(line) + 1).cast("int"), F.lit(1))
    stitched = outer.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy("island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return inner.union(stitched.select("start", "end"))


def _split(r: DataFrame) -> DataFrame:
    """Ranges cut at cell ends."""
    return _cells(r).select(F.greatest("start", F.col("cell") * CELL).alias("start"), F.least("end", F.col("cell") * CELL + (CELL - 1)).alias("end"))


def plain_to_rle(mask: DataFrame) -> DataFrame:
    """Runs of true positions; null bits are false."""
    return index_to_rle(mask.where("bit").select("pos"))


def index_to_rle(index: DataFrame) -> DataFrame:
    return _islands(index.distinct().select(F.col("pos").alias("start"), F.col("pos").alias("end")))


def rle_to_index(r: DataFrame) -> DataFrame:
    return _split(r).select(F.explode(F.sequence("start", "end")).alias("pos"))


def rle_to_plain(r: DataFrame, rows: int) -> DataFrame:
    return index_to_plain(rle_to_index(r), rows)


def index_to_plain(index: DataFrame, rows: int) -> DataFrame:
    found = index.distinct().withColumn("hit", F.lit(True))
    return index.sparkSession.range(rows).withColumnRenamed("id", "pos").join(found, "pos", "left").select("pos", F.coalesce("hit", F.lit(False)).alias("bit"))


def compact(r: DataFrame) -> DataFrame:
    """The ranges moved together without gaps, lengths kept."""
    sized = lengths(r).withColumn("cell", F.floor(F.col("start") / CELL))
    cells = sized.groupBy("cell").agg(F.sum("length").alias("n"))
    before = cells.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("cell").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(before, "cell").withColumn("at", F.col("before") + F.coalesce(F.sum("length").over(w), F.lit(0)))
    return placed.select(F.col("at").alias("start"), (F.col("at") + F.col("length") - 1).alias("end"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The overlaps of two tables of ranges, one row per pair that overlaps."""
    x, y = _cells(a).select("cell", "start", "end"), _cells(b).select("cell", F.col("start").alias("s"), F.col("end").alias("e"))
    met = x.join(y, "cell").where("start <= e and s <= end")
    # a pair that meets in several cells is taken where its overlap begins
    low, high = F.greatest("start", "s"), F.least("end", "e")
    return met.where(F.floor(low / CELL) == F.col("cell")).select(low.alias("start"), high.alias("end"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of either, as ranges; those that overlap or touch are merged."""
    return _islands(_split(a.select("start", "end").union(b.select("start", "end"))))


def complement(r: DataFrame, rows: int) -> DataFrame:
    """The gaps within positions 0 to ``rows`` - 1."""
    ends = r.select("start", "end").where(F.col("start") < rows).select("start", F.least("end", F.lit(rows - 1)).alias("end"))
    cells = r.sparkSession.range(-(-rows // CELL)).select(F.col("id").alias("cell"))
    pieces = _split(ends).withColumn("cell", F.floor(F.col("start") / CELL))
    low, high = F.col("cell") * CELL, F.least(F.col("cell") * CELL + CELL, F.lit(rows))
    # a fence at each cell's start and end; gaps lie between what follows one another
    fences = cells.select("cell", low.alias("start"), (low - 1).alias("end")).union(cells.select("cell", high.alias("start"), high.alias("end")))
    w = Window.partitionBy("cell").orderBy("start", "end")
    gap = fences.union(pieces.select("cell", "start", "end")).withColumn("from", F.lag("end").over(w) + 1).where("from < start")
    return _islands(gap.select(F.col("from").alias("start"), (F.col("start") - 1).alias("end")))


def _hits(index: DataFrame, r: DataFrame) -> DataFrame:
    p = index.distinct().withColumn("cell", F.floor(F.col("pos") / CELL))
    return p.join(_cells(r).select("cell", "start", "end"), "cell").where("pos between start and end")


def index_in_rle(index: DataFrame, r: DataFrame) -> DataFrame:
    """Positions within a range."""
    return _hits(index, r).select("pos").distinct()


def rle_holding_index(index: DataFrame, r: DataFrame) -> DataFrame:
    """Ranges that hold a position."""
    return _hits(index, r).select("start", "end").distinct()


def index_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").intersect(b.select("pos"))


def index_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos").union(b.select("pos")).distinct()


def complement_index(index: DataFrame, rows: int) -> DataFrame:
    """The positions that are missing, as ranges."""
    return complement(index_to_rle(index), rows)


def concatenated_ranges(df: DataFrame, start: str, length: str) -> DataFrame:
    """``start, start + 1, ...`` for each row, ``length`` of them; none for a length of 0."""
    return df.where(F.col(length) > 0).select(F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)).alias("pos"))


@dataclass(frozen=True)
class Mask:
    """A selection of ``rows`` positions: kind "plain", "rle" or "index", and its table."""

    kind: str
    data: DataFrame
    rows: int

    def __post_init__(self) -> None:
        if self.kind not in ("plain", "rle", "index") or self.rows < 0:
            raise UnsupportedPlanError(f"mask {self.kind!r} of {self.rows} rows")

    def to_plain(self) -> DataFrame:
        return {"plain": lambda: self.data, "rle": lambda: rle_to_plain(self.data, self.rows), "index": lambda: index_to_plain(self.data, self.rows)}[self.kind]()

    def to_index(self) -> DataFrame:
        return {"plain": lambda: self.data.where("bit").select("pos"), "rle": lambda: rle_to_index(self.data), "index": lambda: self.data.select("pos")}[self.kind]()

    def __and__(self, other: Mask) -> Mask:
        """Ranges of ranges; plain of plain; positions of all other pairs."""
        self._same(other)
        kinds = {self.kind, other.kind}
        if kinds == {"rle"}:
            return Mask("rle", intersect(self.data, other.data), self.rows)
        if kinds == {"plain"}:
            both = self.data.select("pos", "bit").join(other.data.select("pos", F.col("bit").alias("b")), "pos").select("pos", (F.col("bit") & F.col("b")).alias("bit"))
            return Mask("plain", both, self.rows)
        if kinds == {"rle", "index"}:
            r, i = (self, other) if self.kind == "rle" else (other, self)
            return Mask("index", index_in_rle(i.data, r.data), self.rows)
        return Mask("index", index_and(self.to_index(), other.to_index()), self.rows)

    def __or__(self, other: Mask) -> Mask:
        """Ranges of ranges, positions of positions, ranges of the two; plain with plain."""
        self._same(other)
        kinds = {self.kind, other.kind}
        if kinds == {"rle"}:
            return Mask("rle", union(self.data, other.data), self.rows)
        if kinds == {"index"}:
            return Mask("index", index_or(self.data, other.data), self.rows)
        if "plain" not in kinds:
            return Mask("rle", index_to_rle(self.to_index().union(other.to_index())), self.rows)
        return Mask("plain", index_to_plain(index_or(self.to_index(), other.to_index()), self.rows), self.rows)

    def __invert__(self) -> Mask:
        """Ranges of ranges and positions, plain of plain."""
        if self.kind == "plain":
            return Mask("plain", self.data.select("pos", (~F.col("bit")).alias("bit")), self.rows)
        return Mask("rle", complement(self.data, self.rows) if self.kind == "rle" else complement_index(self.data, self.rows), self.rows)

    def _same(self, other: Mask) -> None:
        if self.rows != other.rows:
            raise UnsupportedPlanError(f"masks of {self.rows} and {other.rows} rows")


def mask_of(df: DataFrame, condition: Column, position: str, rows: int, kind: str = "plain") -> Mask:
    """The rows of a table with dense positions that pass a condition."""
    plain = df.select(F.col(position).alias("pos"), F.coalesce(condition, F.lit(False)).alias("bit"))
    if kind == "plain":
        return Mask("plain", plain, rows)
    return Mask("rle", plain_to_rle(plain), rows) if kind == "rle" else Mask("index", plain.where("bit").select("pos"), rows)


def select(df: DataFrame, position: str, mask: Mask) -> DataFrame:
    """The rows that a mask selects."""
    return df.join(mask.to_index().select(F.col("pos").alias(position)), position, "left_semi")


def rle_aggregates(runs: DataFrame, value: str = "value") -> DataFrame:
    """count, sum, min, max and mean of run-length encoded values, never expanded; of no rows an error for min, max and mean is a null here."""
    n = F.col("end") - F.col("start") + 1
    a = runs.agg(F.sum(n).cast("long").alias("n"), F.sum(F.col(value) * n).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return a.select(F.coalesce("n", F.lit(0)).alias("n"), "total", "least", "most", F.try_divide(F.col("total").cast("double"), F.col("n")).alias("mean"))


def dictionary(spark: SparkSession, values: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """``(id, value)``: ids in the order of the values; new values get ids after those that exist, which stay."""
    new = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    first = F.lit(0)
    if existing is not None:
        new = new.join(existing.select("value"), "value", "left_anti")
        first = F.lit((existing.agg(F.max("id")).first()[0] or -1) + 1 if existing.take(1) else 0)
    # values are ranked within ranges of the order, and the ranges follow one another: no single task sorts all
    # the numbers are written once: another reading might cut the ranges elsewhere
    ranged = new.repartitionByRange("value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    ranged = written(ranged, "dictionary")
    w = Window.partitionBy("p").orderBy("m")
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ids = ranged.withColumn("r", F.row_number().over(w)).join(before, "p").select((F.col("before") + F.col("r") - 1 + first).cast("long").alias("id"), "value")
    return ids if existing is None else existing.select("id", "value").union(ids)


def encode(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """Add the id of a column's value; unknown values and null get -1."""
    d = ids.select(F.col("value").alias("__value"), F.col("id").alias("__id"))
    return df.join(d, df[column] == d["__value"], "left").select(*(df[c] for c in df.columns), F.coalesce("__id", F.lit(-1)).cast("long").alias(name))
