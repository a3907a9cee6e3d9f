"""Machines over many small groups of rows, each in order."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import stored
from .sessions import dealt, islands

#: Rows of results that are sent at once.
SENT_ROWS = 10_000


def in_order(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], machine: Callable[[list], Iterable[tuple]], schema: str, count: int = 0) -> DataFrame:
    """What machine returns for each group of rows with the same keys (null is a key
    too), as named tuples by `order`.  Rows are sorted within the partitions of one
    shuffle and read as they come, so millions of groups of a few rows cost what their
    rows cost; no more than one group and one batch is held.  count: how many rows there
    are, if that is known; they are dealt to as many tasks as they need."""
    names, n = [*keys, *[c for c in rows.columns if c not in keys]], len(keys)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        Line = namedtuple("Line", names, rename=True)
        # Columns are lists of plain values; a batch at a time.
        lines = (Line(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out, strict=True)], schema=out)

        for _, group in groupby(lines, key=lambda r: r[:n]):
            held += machine(list(group))
            if len(held) >= SENT_ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return dealt(rows.select(*names).repartition(*keys), count, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_stretches(rows: DataFrame, idle, keys: tuple[str, ...], order: tuple[str, ...], machine: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """in_order where a pause longer than `idle` ends what a machine remembers: a group
    is a stretch of the rows with the same keys between such pauses (see islands)."""
    held = stored(rows)
    count = held.count()
    return in_order(islands(held, idle, keys=keys, order=order, rows=count), (*keys, "island"), order, machine, schema, count)
