"""What the accession problems share: one clean row per accession, and the splits it is listed in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.values import as_number, is_present

#: A coordinate of exactly this value marks a missing place.
NO_PLACE = -9.0
#: Identifiers that stand for no identifier.
NO_FID = (0, -9)


def _placed(x: Column, y: Column) -> Column:
    given = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return given & (x != NO_PLACE) & (y != NO_PLACE) & (F.abs(x) <= 180) & (F.abs(y) <= 90)


def accessions(coords: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """(iid, x, y, fid) once per accession: its place, null unless both coordinates are valid, and its fid, null if missing.

    An accession may be delivered again with gaps filled, so each field takes its known value. The null iid is left out.
    """
    x, y = F.col("long").cast("double"), F.col("lat").cast("double")
    ok = _placed(x, y)
    rows = coords.filter(F.col("iid").isNotNull()).select(
        F.col("iid").cast("long").alias("iid"),
        F.when(ok, x).alias("x"),
        F.when(ok, y).alias("y"),
        F.when(~F.col("fid").isin(*NO_FID) & (F.col("fid") > -1e30), F.col("fid").cast("long")).alias("fid"),
    )
    return rows.groupBy("iid").agg(
        F.max(F.when(F.col("x").isNotNull(), F.struct("x", "y"))).alias("p"),
        F.max("fid").alias("fid"),
    ).select("iid", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "fid")


def listed_splits(splits: DataFrame) -> DataFrame:
    """(iid, split), distinct, with iid as a number and split as train, val or test; other rows are left out."""
    name = F.lower(F.regexp_replace("split", r"[^\p{L}]", ""))
    kind = F.when(name.startswith("train"), "train").when(name.startswith("val"), "val").when(name.startswith("test"), "test")
    return splits.select(as_number("iid").alias("iid"), kind.alias("split")).dropna().dropDuplicates()


def in_both(coords: DataFrame, normalized: DataFrame) -> DataFrame:
    """``accessions`` of ``coords`` that ``normalized`` also has."""
    ids = normalized.select(F.col("iid").cast("long").alias("iid")).dropna().dropDuplicates()
    return accessions(coords).join(ids, "iid", "left_semi")


def measured(normalized: DataFrame, columns: list[str]) -> DataFrame:
    """(iid, columns), distinct, of rows in which none of the columns is missing."""
    rows = normalized.filter(reduce(lambda a, b: a & b, [is_present(c) for c in columns], F.col("iid").isNotNull()))
    return rows.select(
        F.col("iid").cast("long").alias("iid"),
        *[F.col(c).cast("double").alias(c) for c in columns],
    ).dropDuplicates()
