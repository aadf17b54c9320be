"""Cells of a grid as rows (row, column, value): filling masked cells from the nearest valid one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_valid(cells: DataFrame, row: str, column: str, value: str, reach: int) -> DataFrame:
    """(row, column, value, distance): every cell with its own value (distance 0) or that of the nearest valid cell within ``reach``.

    Euclidean distance within a square of ``reach`` rows and columns; ties go to the smaller row, then the smaller
    column; NULL where none is in reach. Done in two steps, as a distance transform is: first the nearest valid cells
    above and below within each column, then the best of the columns in reach of each masked cell. Cells must be
    distinct; null and NaN values are masked.
    """
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value).cast("double"))
    grid = cells.select(F.col(row).cast("long").alias("r"), F.col(column).cast("long").alias("c"), v.alias("v"))
    valid, masked = grid.filter("v is not null"), grid.filter("v is null").select("r", "c")
    # candidates: for each row in which a masked cell lies and each column, the nearest valid cell above and below
    rows = masked.select("r").dropDuplicates()
    bucket = lambda c: F.floor(c / max(reach, 1))
    near_rows = valid.withColumn(
        "b",
        F.explode(F.sequence(bucket(F.col("r") - reach), bucket(F.col("r") + reach))),
    ).join(rows.select(
        F.col("r").alias("at"),
        bucket(F.col("r")).alias("b"),
    ), "b").filter(F.abs(F.col("r") - F.col("at")) <= reach)
    best = near_rows.groupBy("at", "c").agg(F.min(F.struct(F.abs(F.col("r") - F.col("at")).alias("d"), "r", "v")).alias("m"))
    lines = best.select(
        "at",
        F.col("c").alias("from_c"),
        "m.d",
        F.col("m.r").alias("from_r"),
        F.col("m.v").alias("v"),
        F.explode(F.sequence(bucket(F.col("c") - reach), bucket(F.col("c") + reach))).alias("b"),
    )
    pairs = masked.withColumn("b", bucket(F.col("c"))).join(
        lines.withColumnRenamed("at", "r"),
        ["r", "b"],
    ).filter(F.abs(F.col("c") - F.col("from_c")) <= reach)
    square = F.col("d") * F.col("d") + (F.col("c") - F.col("from_c")) * (F.col("c") - F.col("from_c"))
    filled = pairs.groupBy("r", "c").agg(F.min(F.struct(square.alias("s"), "from_r", "from_c", "v")).alias("m"))
    out = masked.join(filled, ["r", "c"], "left").select(
        "r",
        "c",
        F.col("m.v").alias("v"),
        F.sqrt(F.col("m.s").cast("double")).alias("distance"),
    )
    every = valid.select("r", "c", "v", F.lit(0.0).alias("distance")).unionByName(out)
    return every.select(F.col("r").alias(row), F.col("c").alias(column), F.col("v").alias(value), "distance")
