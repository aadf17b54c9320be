"""Exact positions inside every group of a table of any size.

A window over a group puts the group into one task. Here one range-partitioned sort on (group, order)
spreads even a single group over many tasks; each task numbers its own rows, and the totals of the groups
at its two edges, prefix-summed over the tasks, turn local numbers into exact ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasieve.plans.scratch import Scratch

#: Columns added on the way; callers see only the position.
_PART, _EDGE, _LOCAL, _TOTAL = "__part", "__edge", "__local", "__total"


def same_as_before(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has the group of the row before it; nulls equal nulls."""
    n = len(columns[0]) - 1
    same = np.ones(n, dtype=bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n)
        equal = pc.fill_null(pc.equal(a, b), False)
        both_null = pc.and_(pc.is_null(a), pc.is_null(b))
        same &= pc.or_(equal, both_null).to_numpy(zero_copy_only=False)
    return same


def global_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    scratch: Scratch,
    name: str,
    *,
    weight: str | None = None,
    keep: int | None = None,
    as_: str = "position",
) -> DataFrame:
    """Adds ``as_``, the number of rows (or the sum of ``weight``) before a row in its group.

    Rows come in the order given; rows equal in ``group`` and ``order`` are numbered arbitrarily, so make
    the order total where that matters. ``keep`` returns only rows with position < keep: a task then passes
    on at most that many rows of each group it holds. Nulls form a group of their own; an empty table gives
    an empty table. The result is a written table, so it is stable when executors are lost.
    """
    group = list(group)
    names = df.columns
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema]
        + [
            T.StructField(_PART, T.IntegerType()),
            T.StructField(_EDGE, T.BooleanType()),
            T.StructField(_LOCAL, T.LongType()),
            T.StructField(_TOTAL, T.LongType()),
        ]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list[pa.Array] | None = None  # the group of the last row seen
        carried = 0  # its weight so far
        edges: list[tuple[pa.RecordBatch, int]] = []  # one row and the total of the first and the last group
        current: pa.RecordBatch | None = None

        def rows(batch: pa.RecordBatch, local: np.ndarray, edge: bool, total: np.ndarray) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, edge)),
                    pa.array(local),
                    pa.array(total),
                ],
                names=[*names, _PART, _EDGE, _LOCAL, _TOTAL],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in group]
            w = np.ones(batch.num_rows, np.int64) if weight is None else batch.column(
                batch.schema.get_field_index(weight)
            ).to_numpy(zero_copy_only=False).astype(np.int64)
            head = [pa.concat_arrays([last[i] if last else c.slice(0, 1), c]) for i, c in enumerate(columns)] if group else []
            same = same_as_before(head) if group else np.ones(batch.num_rows, bool)
            if last is None and current is None:
                same[0] = False
            before = np.cumsum(w) - w
            starts = np.flatnonzero(~same)
            base = np.full(batch.num_rows, -carried, np.int64)
            if len(starts):
                begins = np.zeros(batch.num_rows, np.int64)
                begins[starts] = 1
                nth = np.cumsum(begins)
                base = np.where(nth > 0, before[starts][np.maximum(nth - 1, 0)], -carried)
            local = before - base
            if len(starts):
                closing = carried + int(before[starts[0]])  # of the group that was open before this batch
                if current is not None and not edges:
                    edges.append((current, closing))
                elif not edges and len(starts) > 1:
                    edges.append((batch.slice(int(starts[0]), 1), int(before[starts[1]] - before[starts[0]])))
                carried = int(w.sum() - before[starts[-1]])
                current = batch.slice(int(starts[-1]), 1)
            else:
                carried += int(w.sum())
            last = [c.slice(len(c) - 1, 1) for c in columns]
            if keep is not None:
                kept = np.flatnonzero(local < keep)
                if len(kept) < len(local):
                    batch, local = batch.take(pa.array(kept)), local[kept]
            if batch.num_rows:
                yield rows(batch, local, False, np.zeros(batch.num_rows, np.int64))
        if current is not None:
            edges.append((current, carried))
            for row, total in edges:
                yield rows(row, np.zeros(1, np.int64), True, np.array([total], np.int64))

    numbered = scratch.write(ranged.mapInArrow(number, schema), name)
    # at most two edge groups a task, so this side is bounded by the number of tasks and safe to broadcast
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.filter(F.col(_EDGE))
        .withColumn("__offset", F.coalesce(F.sum(_TOTAL).over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(_PART).alias("__p"), "__offset")
        .filter("__offset > 0")
    )
    rows = numbered.filter(~F.col(_EDGE))
    same_group = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    on = F.col(_PART) == F.col("__p")
    for c in same_group:
        on = on & c
    placed = rows.join(F.broadcast(offsets), on, "left").withColumn("__at", F.col(_LOCAL) + F.coalesce("__offset", F.lit(0)))
    if keep is not None:
        placed = placed.filter(F.col("__at") < keep)
    return placed.select(*names, F.col("__at").alias(as_))
