"""Which grid cells hold points within a tolerance of each other, without listing pairs of points.

Cells are as wide as the tolerance, so points of one cell are always close, and points of different cells
can only be close in adjacent ones. For cells side by side the extremes decide; for cells that touch at a
corner a sweep over the few points nearest that corner does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to a tolerance, so that differences equal to it in decimals are not lost in binary.
FLOAT_SLACK = 1e-9
#: A cell is thinned in parts of about so many points before its nearest points are found.
PART_POINTS = 5_000


def with_cells(points: DataFrame, x: str, y: str, tolerance: float) -> DataFrame:
    """Adds cx and cy, the cell of each point; x and y must not be null or NaN."""
    w = F.lit(tolerance + FLOAT_SLACK)
    return points.withColumn("cx", F.floor(F.col(x) / w)).withColumn("cy", F.floor(F.col(y) / w))


def _near_corner(points: DataFrame, right: int, up: int) -> DataFrame:
    """Points of a cell that no point of the same part of it beats in both directions (``right``, ``up`` = 1 or -1); ``n`` is the cell's number of points."""
    px, py = F.col("x") * right, F.col("y") * up
    part = F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n") / PART_POINTS))
    before = Window.partitionBy("cx", "cy", "part").orderBy(
        F.col("px").desc(),
        F.col("py").desc(),
    ).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("py").over(before)
    return points.withColumns({"px": px, "py": py, "part": part}).withColumn("best", best).filter(
        F.col("best").isNull() | (F.col("py") > F.col("best"))
    ).select("cx", "cy", "x", "y")


def cell_links(points: DataFrame, tolerance: float) -> DataFrame:
    """(ax, ay, bx, by): adjacent cells of which some pair of points differs by at most ``tolerance`` in x and in y.

    ``points`` has cx, cy, x, y as ``with_cells`` makes them; repeated points count once. The result has at most
    four rows per cell.
    """
    points = points.select("cx", "cy", "x", "y").dropDuplicates()
    w = tolerance + FLOAT_SLACK
    cells = points.groupBy("cx", "cy").agg(
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("n"),
    )
    a = cells.select(
        F.col("cx").alias("ax"),
        F.col("cy").alias("ay"),
        F.col("x1").alias("a_x1"),
        F.col("y0").alias("a_y0"),
        F.col("y1").alias("a_y1"),
    )
    steps = F.explode(
        F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))])
    )
    near = (
        a.withColumn("step", steps)
        .select("*", (F.col("ax") + F.col("step.dx")).alias("cx"), (F.col("ay") + F.col("step.dy")).alias("cy"))
        .join(cells, ["cx", "cy"])
        .select(
            "ax",
            "ay",
            F.col("cx").alias("bx"),
            F.col("cy").alias("by"),
            "step.dx",
            "step.dy",
            "a_x1",
            "a_y0",
            "a_y1",
            "x0",
            "y0",
            "y1",
        )
    )
    x_close, up_close, down_close = F.col("x0") - F.col("a_x1") <= w, F.col("y0") - F.col("a_y1") <= w, F.col("a_y0") - F.col("y1") <= w
    straight = near.filter(F.when(F.col("dy") == 0, x_close).when(F.col("dx") == 0, up_close).otherwise(False))
    # for corners the extremes are necessary, not sufficient: they may belong to different points
    corner = near.filter(
        (F.col("dx") == 1) & (F.col("dy") != 0) & x_close & F.when(F.col("dy") == 1, up_close).otherwise(down_close)
    )
    links = straight.select("ax", "ay", "bx", "by")
    sized = points.join(cells.select("cx", "cy", "n"), ["cx", "cy"])
    for up in (1, -1):
        pairs = corner.filter(F.col("dy") == up).select("ax", "ay", "bx", "by")
        from_a = pairs.join(_near_corner(sized, 1, up), (F.col("ax") == F.col("cx")) & (F.col("ay") == F.col("cy")))
        from_b = pairs.join(_near_corner(sized, -1, -up), (F.col("bx") == F.col("cx")) & (F.col("by") == F.col("cy")))
        # sweep along x: a point of A reaches x + w; the lowest point of B so far decides
        events = from_a.select(
            "ax",
            "ay",
            "bx",
            "by",
            (F.col("x") + w).alias("at"),
            F.lit(1).alias("of_a"),
            (F.col("y") * up).alias("h"),
        ).unionByName(
            from_b.select("ax", "ay", "bx", "by", F.col("x").alias("at"), F.lit(0).alias("of_a"), (F.col("y") * up).alias("h"))
        )
        so_far = Window.partitionBy("ax", "ay", "bx", "by").orderBy("at", "of_a").rowsBetween(Window.unboundedPreceding, -1)
        lowest = F.min(F.when(F.col("of_a") == 0, F.col("h"))).over(so_far)
        met = events.withColumn("lowest", lowest).filter((F.col("of_a") == 1) & (F.col("lowest") - F.col("h") <= w))
        links = links.unionByName(met.select("ax", "ay", "bx", "by").dropDuplicates())
    return links
