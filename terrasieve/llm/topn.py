"""Top N items within every group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch


def top_n_per_group(df: DataFrame, group: Sequence[str], score: Column, ties: Sequence[str], n: int) -> DataFrame:
    """``group``, ``ties``, ``score`` and ``rank`` (from 1) of the n rows of highest score in each group.

    One global range-partitioned sort on group, score and tie columns; positions are local counts plus prefix
    sums of the groups that cross a partition edge, so a group of any size is spread over many tasks and no
    task holds more than its share. A null or NaN score isn't ranked; rows equal in group, score and ties count
    once; groups smaller than n give all they have; null keys form groups of their own; an empty table gives no
    rows. Equal scores are ordered by the tie columns, ascending, nulls first. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "topn")
    ranked = df.select(*group, *ties, score.cast("double").alias("__score"))
    ranked = ranked.filter(F.col("__score").isNotNull() & ~F.isnan("__score"))
    # copies are combined before they are shuffled; one group of copies may be a large part of the table
    distinct = ranked.dropDuplicates()
    order = [F.col("__score").desc(), *[F.col(c).asc() for c in ties]]
    placed = global_positions(distinct, list(group), order, scratch, "placed", keep=n, as_="__position")
    return placed.select(*group, *ties, F.col("__score").alias("score"), (F.col("__position") + 1).cast("int").alias("rank"))
