"""Chunked execution of one-table plans: scan, filter, project, sort and aggregate, chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import UnsupportedPlanError
from tessel.operators.aggregate import Agg, finalize, local_aggregate, merge_states
from tessel.operators.relational import ordering
from tessel.sources.scan import with_chunk


@dataclass(frozen=True)
class Pipeline:
    """A plan over one table in chunks of ``size`` rows. Each step returns a new pipeline."""

    source: DataFrame
    size: int
    filters: tuple[Column, ...] = ()
    columns: tuple[Column | str, ...] = ()
    order: tuple = ()
    keys: tuple[str, ...] = ()
    aggs: Mapping[str, Agg] | None = None

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise UnsupportedPlanError("the chunk size must be positive")

    def filter(self, condition: Column) -> Pipeline:
        self._before_aggregate("filter")
        return replace(self, filters=(*self.filters, condition))

    def project(self, *columns: Column | str) -> Pipeline:
        self._before_aggregate("project")
        return replace(self, columns=columns)

    def sort(self, *keys: str | tuple[str, str]) -> Pipeline:
        """Each chunk in order; after an aggregate, the result in the ascending order of its keys."""
        if self.aggs is not None and list(keys) != list(self.keys[: len(keys)]):
            raise UnsupportedPlanError("a chunked aggregate can only be sorted by its keys, ascending")
        return replace(self, order=keys)

    def aggregate(self, keys: Sequence[str], aggs: Mapping[str, Agg]) -> Pipeline:
        self._before_aggregate("aggregate")
        return replace(self, keys=tuple(keys), aggs=aggs)

    def join(self, *_: object) -> Pipeline:
        raise UnsupportedPlanError("joins have no chunked form")

    def limit(self, *_: object) -> Pipeline:
        raise UnsupportedPlanError("limits have no chunked form")

    def _before_aggregate(self, step: str) -> None:
        if self.aggs is not None:
            raise UnsupportedPlanError(f"{step} after an aggregate has no chunked form")

    def _chunked(self) -> DataFrame:
        df = with_chunk(self.source, self.size, "__chunk")
        for f in self.filters:
            df = df.where(f)
        return df.select("__chunk", *self.columns) if self.columns else df

    def local(self) -> DataFrame:
        """Partial states, a row per chunk and key."""
        if self.aggs is None:
            raise UnsupportedPlanError("no aggregate")
        return local_aggregate(self._chunked(), self.keys, self.aggs, "__chunk")

    def run(self) -> DataFrame:
        """The result, all chunks in parallel."""
        if self.aggs is None:
            df = self._chunked()
            # a chunk is sorted where it is; the chunks themselves are in no order
            return df.repartition("__chunk").sortWithinPartitions("__chunk", *ordering(self.order)).drop("__chunk") if self.order else df.drop("__chunk")
        out = finalize(merge_states(self.local(), self.keys, self.aggs), self.keys, self.aggs)
        return out.orderBy(*ordering(self.order)) if self.order else out

    def batches(self) -> Iterator[list[dict]]:
        """Chunk by chunk, for a consumer that pulls; one chunk is held at a time."""
        if self.aggs is not None:
            yield [r.asDict() for r in self.run().toLocalIterator()]
            return
        held, at = [], None
        for r in self._chunked().orderBy("__chunk", *ordering(self.order)).toLocalIterator():
            row = r.asDict()
            chunk = row.pop("__chunk")
            if held and chunk != at:
                yield held
                held = []
            at = chunk
            held.append(row)
        if held:
            yield held


def one_mode(**modes: object) -> str | None:
    """The one mode that is asked for; chunked scans, local aggregates by partition and encoded masks are ways of their own that do not combine."""
    known = ("scan_chunk", "partition", "masks")
    asked = [m for m, wanted in modes.items() if wanted]
    if unknown := [m for m in modes if m not in known]:
        raise UnsupportedPlanError(f"mode {unknown[0]!r}")
    if len(asked) > 1:
        raise UnsupportedPlanError(f"modes {' and '.join(asked)} do not combine")
    return asked[0] if asked else None


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]
