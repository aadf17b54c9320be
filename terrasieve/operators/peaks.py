"""Peaks in attribution series, windows around them, and maps between gapped and ungapped coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.plans.joins import join_same
from terrasieve.plans.scratch import Scratch


def series_zscore(df: DataFrame, group: Sequence[str], value: str, absolute: bool = False, name: str = "z") -> DataFrame:
    """Adds the z-score of ``value`` within its series (population deviation), of |value| with ``absolute``; a constant series has none and its rows go."""
    v = F.col(value).cast("double")
    v = F.when(v.isNotNull() & ~F.isnan(v), F.abs(v) if absolute else v)
    stats = df.groupBy(*group).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s")).filter("__s > 0")
    return join_same(df, stats, group).withColumn(name, (v - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def greedy_peaks(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    value: str,
    *,
    window: int = 10,
    max_peaks: int = 3,
    threshold: float = 1.96,
) -> DataFrame:
    """(group, peak_index, position, zscore): up to ``max_peaks`` positions of highest z, each more than half a window from those before.

    Each peak is one aggregate over what the peaks before leave, so a series of any length is never gathered. Ties
    go to the smaller position. The candidates and each round's peaks are written tables, so no round runs twice.
    """
    half = window // 2
    scratch = Scratch(df.sparkSession, "peaks")
    left = series_zscore(df, group, value, absolute=True).filter(F.col("z") >= threshold).select(
        *group,
        F.col(position).alias("p"),
        "z",
    )
    left = scratch.write(left, "candidates")
    found = None
    for i in range(max_peaks):
        top = left.groupBy(*group).agg(F.max(F.struct("z", (-F.col("p")).alias("np"))).alias("t")).select(
            *group,
            F.lit(i).alias("peak_index"),
            (-F.col("t.np")).alias("at"),
            F.col("t.z").alias("zscore"),
        )
        top = scratch.write(top, f"peak_{i}")
        found = top if found is None else found.unionByName(top)
        left = join_same(left, top.select(*group, "at"), group).filter(F.abs(F.col("p") - F.col("at")) > half).drop("at")
    return found.select(*group, "peak_index", F.col("at").alias(position), "zscore")


def shifted_window(centre: Column, length: Column, width: int) -> tuple[Column, Column]:
    """First and last (exclusive) place of a window of ``width`` around a centre, moved inwards at the ends and cut to short sequences."""
    first = F.greatest(F.lit(0), F.least(centre - width // 2, length - width))
    return first, F.least(first + width, length)


def clipped_slice(seq: Column, centre: Column, half: int) -> Column:
    """The part of a sequence within ``half`` places of a centre (from 0), cut at its ends."""
    first = F.greatest(centre - half, F.lit(0))
    last = F.least(centre + half + 1, F.length(seq))
    return F.substring(seq, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def alignment_map(df: DataFrame, key: Sequence[str], aligned: str) -> DataFrame:
    """(key, column, base, ungapped): each alignment column of each sequence, and its ungapped index; NULL at gaps.

    The running count is a window over one sequence's letters.
    """
    chars = F.filter(F.split(F.col(aligned), ""), lambda c: c != "")
    rows = df.select(*key, F.posexplode(chars).alias("column", "base"))
    letter = F.col("base") != "-"
    so_far = Window.partitionBy(*key).orderBy("column").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("ungapped", F.when(letter, F.sum(letter.cast("int")).over(so_far) - 1).cast("int"))


def scores_on_alignment(alignment: DataFrame, scores: DataFrame, key: Sequence[str], position: str, score: str) -> DataFrame:
    """``alignment_map`` rows with the score of their ungapped position; NULL at gaps and where there is none."""
    placed = scores.select(*key, F.col(position).alias("ungapped"), score)
    return alignment.join(placed, [*key, "ungapped"], "left")


def series_overlay(a: DataFrame, b: DataFrame, position: Sequence[str], value: str) -> DataFrame:
    """Two series on their common positions, as ``left`` and ``right``."""
    return a.select(*position, F.col(value).alias("left")).join(b.select(*position, F.col(value).alias("right")), list(position))
