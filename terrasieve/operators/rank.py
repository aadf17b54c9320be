"""Best rows, top rows and orders, always with a total order so that ties have one answer."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.plans.joins import join_same
from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first n rows of each group; ``name`` keeps the row number.

    The planner cuts each task's groups to n rows before the shuffle, so a hot group moves few rows.
    """
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    top = df.withColumn("__r", r).filter(F.col("__r") <= n)
    return top.withColumnRenamed("__r", name) if name else top.drop("__r")


def best_effect(
    df: DataFrame,
    group: Sequence[str],
    effect: str,
    ties: Sequence[str],
    direction: str = "positive",
    compat: bool = False,
) -> DataFrame:
    """The row of the strongest effect in the wanted direction per group; ties by the columns given, ascending.

    ``compat`` takes the maximum whatever the direction. Null effects don't compete.
    """
    up = compat or direction == "positive"
    order = F.col(effect).desc() if up else F.col(effect).asc()
    return first_rows(df.filter(F.col(effect).isNotNull() & ~F.isnan(effect)), group, [order, *[F.col(t).asc() for t in ties]])


def split_by_direction(best: DataFrame, effect: str, direction: str = "positive") -> tuple[DataFrame, DataFrame]:
    """(rows whose effect has the wanted sign, the others)."""
    wanted = F.coalesce(F.col(effect) > 0 if direction == "positive" else F.col(effect) < 0, F.lit(False))
    return best.filter(wanted), best.filter(~wanted)


def top_weights(df: DataFrame, group: Sequence[str], weight: str, ties: Sequence[str], n: int, mode: str = "abs") -> DataFrame:
    """The n rows of largest |weight| (abs), weight (max), positive (pos) or most negative (neg) weight per group, ranked."""
    w = F.col(weight)
    rows = df.filter(w.isNotNull() & ~F.isnan(w))
    rows = rows.filter(w > 0) if mode == "pos" else rows.filter(w < 0) if mode == "neg" else rows
    key = {"abs": F.abs(w).desc(), "max": w.desc(), "pos": w.desc(), "neg": w.asc()}[mode]
    return first_rows(rows, group, [key, *[F.col(t) for t in ties]], n, "rank")


def pick_peaks(weights: DataFrame, peaks: DataFrame, keys: Sequence[str], mode: str = "best_zscore") -> DataFrame:
    """Peaks of the selected weights: the one of highest zscore, the first by index, or all; unmatched weights go."""
    joined = weights.join(peaks, list(keys))
    if mode == "all":
        return joined
    order = [F.col("zscore").desc_nulls_last(), F.col("peak_index")] if mode == "best_zscore" else [F.col("peak_index")]
    return first_rows(joined, keys, order)


def weight_mass(df: DataFrame, group: Sequence[str], weight: str, shares: Sequence[float] = (0.5, 0.8)) -> DataFrame:
    """Per group: how many of the largest |weight| together reach each share of the sum; 0 where the sum is 0.

    The running sum is in whole steps of a power of ten, 1e-12 or the smallest with which the sum of all weights stays
    exact, so it is the same for any partitioning. Groups of any size: positions are global. Writes a table.
    """
    every = F.when(~F.isnan(weight), F.abs(F.col(weight)))
    sum_of_all = df.agg(F.sum(every)).first()[0] or 0.0
    unit = 10.0 ** min(12, math.floor(math.log10(4e18 / sum_of_all)) if sum_of_all else 12)
    w = F.coalesce(F.when(~F.isnan(weight), F.abs(F.col(weight))), F.lit(0.0))
    rows = df.select(*group, F.round(w * unit).cast("long").alias("w"))
    scratch = Scratch(df.sparkSession, "mass")
    counts = rows.groupBy(*group, "w").agg(F.count(F.lit(1)).alias("n")).withColumn("mass", F.col("w") * F.col("n"))
    by_n = global_positions(
        counts,
        list(group),
        [F.col("w").desc()],
        scratch,
        "rows",
        weight="n",
    ).withColumnRenamed("position", "rows_before")
    both = global_positions(by_n, list(group), [F.col("w").desc()], scratch, "mass", weight="mass")
    totals = counts.groupBy(*group).agg(F.sum("mass").alias("total"))
    placed = join_same(both, totals, group)
    reach = lambda p: F.min(F.when((F.col("total") > 0) & (F.col("w") > 0) & (F.col("position") + F.col("mass") >= F.lit(p) * F.col("total")), F.col("rows_before") + F.ceil(F.greatest(F.lit(p) * F.col("total") - F.col("position"), F.lit(1.0)) / F.col("w"))))
    return placed.groupBy(*group).agg(*[F.coalesce(reach(p), F.lit(0)).cast("long").alias(f"n_{round(p * 100)}") for p in shares])


def extremes(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n lowest (``bottom``) and n highest (``top``) rows; a row can be both in a small table. Two limited sorts."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(key, value)
    low = rows.orderBy(F.col(value).asc(), F.col(key).asc()).limit(n).withColumn("side", F.lit("bottom"))
    high = rows.orderBy(F.col(value).desc(), F.col(key).desc()).limit(n).withColumn("side", F.lit("top"))
    return low.unionByName(high)


def hashed_order(df: DataFrame, key: str, seed: int, group: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds a reproducible shuffled place from 0 within each group, by a hash of the key. Groups of any size; writes a table."""
    rank = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    placed = global_positions(
        df.withColumn("__h", rank),
        list(group),
        [F.col("__h"), F.col(key)],
        Scratch(df.sparkSession, "shuffle"),
        "placed",
    )
    return placed.drop("__h").withColumnRenamed("position", name)


def listed_order(df: DataFrame, order: DataFrame, key: str, rank: str) -> DataFrame:
    """Rows with ``rank`` from an order table; keys that it doesn't list come after all that it does, by key."""
    return df.join(order.select(key, rank), key, "left").orderBy(F.col(rank).asc_nulls_last(), F.col(key))


def first_pairs(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """Rows for a list without weights: those whose ``a`` and whose ``b`` each occur among the first ``n`` distinct pairs, in order of (a, b).

    The two are looked up one by one, so a pair that isn't among the first can come out too. Nulls sort first.
    """
    pairs = df.select(a, b).dropDuplicates().orderBy(F.col(a).asc_nulls_first(), F.col(b).asc_nulls_first()).limit(n)
    out = df
    for c in (a, b):
        out = join_same(out, pairs.select(c).dropDuplicates(), [c], "left_semi")
    return out.select(*df.columns)
