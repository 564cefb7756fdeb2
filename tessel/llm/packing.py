"""Best-fit packing of documents into sequences by a linear grouping scheme.

Only the histogram of piece lengths reaches the driver: at most ``capacity``
numbers, whatever the corpus. On it, large lengths are cut into groups of equal
cardinality and rounded up to their group's largest; a linear program over
configurations of these few sizes (column generation with a knapsack) says how
often to use each configuration; its slots are then given to the actual
pieces by rank, and the rest, small pieces above all, goes best-fit into the
room that is left. The plan is a list of runs (length, ranks, sequences), again
bounded by the number of lengths; each piece finds its run from its rank among
the pieces of its length, so rows are placed where they are.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, lean, table
from .word_bpe import CACHE_BYTES, forget, token_bytes

CAPACITY = 4096
#: The id after each document.
END_ID = 1
#: (share of the capacity above which a length is large, groups): each is tried on the histogram, the best plan is used.
SETTINGS = ((1 / 3, 24), (1 / 5, 32), (1 / 8, 40), (1 / 2, 48))


@dataclass
class Plan:
    """Runs: pieces of ``length`` with ranks from ``rank`` on go ``per`` at a time to sequences from ``bin`` on, from ``offset`` on."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, bin, per, offset
    bins: int = 0


def best_configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500) -> list[tuple[list[int], float]]:
    """The linear program of cutting stock: ``(copies of each size, how often)``, covering the demand with the fewest sequences."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.array([d / (capacity // s) for s, d in zip(sizes, demand, strict=True)])
    deepest = capacity // min(sizes)
    for _ in range(rounds):
        y = np.linalg.solve(basis.T, np.ones(n))
        # the most valuable configuration: a knapsack by number of pieces
        value, took = np.zeros(capacity + 1), []
        for _ in range(deepest):
            best, choice = value.copy(), np.full(capacity + 1, -1)
            for g in range(n):
                if y[g] > 1e-12:
                    new = value[: capacity + 1 - sizes[g]] + y[g]
                    tail = best[sizes[g] :]
                    better = new > tail + 1e-12
                    tail[better] = new[better]
                    choice[sizes[g] :][better] = g
            took.append(choice)
            if not (choice >= 0).any():
                break
            value = best
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        for choice in reversed(took):
            if (g := choice[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaves]):
            break
        x = np.maximum(x - ratio[leaves] * step, 0)
        x[leaves] = ratio[leaves]
        basis[:, leaves] = column
    return [(basis[:, k].astype(int).tolist(), float(x[k])) for k in range(n)]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, large_share: float = 1 / 3, groups: int = 24) -> Plan:
    """Place ``counts[length]`` pieces of each length."""
    plan = Plan()
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences
    free: list[int] = []  # its keys, sorted

    def leave(left: int, start: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(free, left)
                room[left] = []
            room[left].append((start, n))

    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    done = dict.fromkeys(lengths, 0)  # ranks given so far
    large = [k for k in lengths if k > large_share * capacity]
    total = sum(counts[k] for k in large)
    if total:
        # ranks of large pieces, longest first; a group may begin and end within a length
        first = np.cumsum([0] + [counts[k] for k in large])
        width = -(-total // groups)
        edges = [*range(0, total, width), total]
        sized: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(edges, edges[1:], strict=False):
            sized.setdefault(large[int(np.searchsorted(first, a, "right")) - 1], []).append((a, b))
        sizes = list(sized)
        spans = {s: (r[0][0], r[-1][1]) for s, r in sized.items()}
        solved = best_configurations(sizes, [spans[s][1] - spans[s][0] for s in sizes], capacity)
        at = {s: spans[s][0] for s in sizes}
        for config, often in sorted(solved, key=lambda c: -c[1]):
            copies = int(often + 1e-6)
            copies = min([copies, *((spans[s][1] - at[s]) // c for s, c in zip(sizes, config, strict=True) if c)])
            if copies <= 0 or not any(config):
                continue
            slots = []
            for s, c in zip(sizes, config, strict=True):
                for _ in range(c):
                    slots.append(at[s])
                    at[s] += copies
            # actual lengths step down with the rank: cut the copies where any slot's length changes
            cuts = {0, copies}
            for slot in slots:
                lo, hi = np.searchsorted(first, [slot, slot + copies], "right")
                cuts |= {int(e) - slot for e in first[lo:hi] if 0 < e - slot < copies}
            for a, b in zip(sorted(cuts), sorted(cuts)[1:], strict=False):
                offset = 0
                for slot in slots:
                    k = int(np.searchsorted(first, slot + a, "right")) - 1
                    plan.runs.append((large[k], slot + a - int(first[k]), b - a, plan.bins + a, 1, offset))
                    offset += large[k]
                leave(capacity - offset, plan.bins + a, b - a)
            plan.bins += copies
        # ranks that no slot took are handled with the small pieces
        rest: dict[int, list[tuple[int, int]]] = {}
        for s in sizes:
            a, end = at[s], spans[s][1]
            while a < end:
                k = int(np.searchsorted(first, a, "right")) - 1
                b = min(end, int(first[k + 1]))
                rest.setdefault(large[k], []).append((a - int(first[k]), b - a))
                a = b
    else:
        rest = {}
    for k in lengths:
        for rank, n in rest.get(k, []) if k in large else [(done[k], counts[k])]:
            while n:
                spot = bisect.bisect_left(free, k)
                if spot == len(free):
                    fresh = -(-n // (capacity // k))
                    leave(capacity, plan.bins, fresh)
                    plan.bins += fresh
                    continue
                left = free[spot]
                start, m = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop(spot)
                per = left // k  # the same sequence stays the tightest until it has no room for another
                used = min(m, n // per)
                if used:
                    plan.runs.append((k, rank, used * per, start, per, capacity - left))
                    leave(left - per * k, start, used)
                    leave(left, start + used, m - used)
                    rank, n = rank + used * per, n - used * per
                else:
                    plan.runs.append((k, rank, n, start, n, capacity - left))
                    leave(left - n * k, start, 1)
                    leave(left, start + 1, m - 1)
                    n = 0
    return plan


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return min((plan_packing(counts, capacity, *s) for s in SETTINGS), key=lambda p: p.bins)


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str | None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Each document's ids, cut after every ``capacity``; ``local_rank`` numbers a task's pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = END_ID.to_bytes(4, "little")
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            row, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = token_bytes(text, tokenizer, cache_bytes) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    row.append(i)
                    out.append((p, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "local_rank"])
        forget()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part long, local_rank long"
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Cases: null or empty text - one piece that holds only the end id; a text of
    any length - as many full pieces as it fills, and the rest; null ids and repeated rows
    - packed like any other row; empty table - no rows; extra columns are ignored.
    The input must be a scan or otherwise give the same rows per task again. ``cache_bytes`` bounds the caches
    of token ids in each Python worker; it has no effect on the result.
    """
    spark = df.sparkSession
    rows = durable(pieces(df, id_col, text_col, capacity, tokenizer, cache_bytes), "pieces", texts=True)
    # ranks within a length over the whole corpus: a task's own ranks, after those of the tasks before it
    counted = durable(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts", narrow=True)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(best_plan(histogram, capacity).runs), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)  # bounded by the number of lengths and configurations

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            hit = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            within = rank - hit[:, 1]
            sequence, offset = hit[:, 3] + within // hit[:, 4], hit[:, 5] + within % hit[:, 4] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # the table of starts grows with the input: never sent whole to all tasks
    ranked = rows.join(starts.hint("merge"), ["part", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("before")).alias("rank"))
    kind = df.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
