"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch


def quantiles_of_counts(
    counts: DataFrame,
    group: Sequence[str],
    scratch: Scratch,
    quantiles: Sequence[float],
    name: str = "ranked",
) -> DataFrame:
    """(group, q_0, q_1, ...) by linear interpolation, from (group, value, n); null values are left out.

    Ranks come from global positions, so no group is held in a task; an aggregate then picks the two values around
    each rank. Groups without values are absent.
    """
    values = counts.filter(F.col("value").isNotNull())
    placed = global_positions(values, list(group), [F.col("value")], scratch, name, weight="n")
    totals = values.groupBy(*group).agg(F.sum("n").alias("total"))
    if group:
        on = reduce(lambda a, b: a & b, [placed[g].eqNullSafe(totals[g]) for g in group])
        rows = placed.join(totals, on).select(*[placed[g] for g in group], "value", "n", "position", "total")
    else:
        rows = placed.join(F.broadcast(totals))
    ranks = [f"(total - 1) * {float(q)!r}d" for q in quantiles]
    needed = ", ".join(f"floor({h}), ceil({h})" for h in ranks)
    # at most two rows a quantile and group are left, so that what is collected of a group is bounded
    near = rows.filter(F.expr(f"exists(array({needed}), r -> position <= r and r < position + n)"))
    found = near.groupBy(*group).agg(F.max("total").alias("total"), F.collect_list(F.struct("position", "n", "value")).alias("at"))
    value = lambda rank: f"filter(at, r -> r.position <= {rank} and {rank} < r.position + r.n)[0].value"
    between = lambda h: f"{value(f'floor({h})')} + ({h} - floor({h})) * ({value(f'ceil({h})')} - {value(f'floor({h})')})"
    return found.select(*group, *[F.expr(between(h)).alias(f"q_{i}") for i, h in enumerate(ranks)])
