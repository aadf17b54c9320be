"""Grouping records into similarity clusters on a grid."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.llm.gridlinks import cell_links, with_cells
from terrasieve.plans.scratch import Scratch


def propagate_minimum(cells: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, label): the smallest cell number of each connected part, by minimum labels passed on until none changes.

    ``cells`` has ``cell``; ``links`` has (a, b). Each round also lets a cell take its label's label, so long
    chains converge in far fewer rounds than they have links. Only counts come to the driver.
    """
    both = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = scratch.write(cells.select("cell", F.col("cell").alias("label")), "labels_0")
    for r in count(1):  # labels only fall, so this ends
        offered = both.join(
            labels.select(F.col("cell").alias("b"), "label"),
            "b",
        ).groupBy(F.col("a").alias("cell")).agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "cell", "left").select(
            "cell",
            "label",
            F.least("label", F.coalesce("offer", "label")).alias("new"),
        )
        jump = labels.select(F.col("cell").alias("new"), F.col("label").alias("beyond"))
        after = lower.join(jump, "new", "left").select(
            "cell",
            F.least("new", F.coalesce("beyond", "new")).alias("label"),
            (F.least("new", F.coalesce("beyond", "new")) < F.col("label")).alias("changed"),
        )
        step = scratch.write(after, f"labels_{r}")
        scratch.drop(f"labels_{r - 1}")
        labels = step.select("cell", "label")
        if step.filter("changed").isEmpty():
            return labels


def grid_clusters(records: DataFrame, key: str, x: str, y: str, tolerance: float, *, min_cell_rows: int = 1) -> DataFrame:
    """(key, cluster, size, cell_rows): density clusters of records whose x and y are close.

    Cells of width ``tolerance`` are counted; dense cells (at least ``min_cell_rows`` records) are joined where
    some of their records differ by at most the tolerance in both features, and minimum labels run to
    convergence. A cluster is named by its smallest key and ``size`` counts its records; ``cell_rows`` is the
    density of the record's cell. Records of cells that aren't dense are left out. Rows with a null or NaN
    feature or null key are ignored, and equal rows count once. A record with several different rows can lie in
    several cells; these count as one where it is the smallest key of each, and otherwise stay apart.
    """
    scratch = Scratch(records.sparkSession, "clusters")
    points = records.select(
        F.col(key).alias("key"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    ).dropna().filter(~F.isnan("x") & ~F.isnan("y")).dropDuplicates()
    celled = with_cells(points, "x", "y", tolerance)
    counted = celled.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("cell_rows"), F.min("key").alias("cell"))
    dense = scratch.write(counted.filter(F.col("cell_rows") >= min_cell_rows), "dense")
    kept = celled.join(dense, ["cx", "cy"]) if min_cell_rows > 1 else celled
    a = dense.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("cell").alias("a"))
    b = dense.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("cell").alias("b"))
    links = cell_links(kept, tolerance).join(a, ["ax", "ay"]).join(b, ["bx", "by"]).select("a", "b")
    # a cell is named by its smallest key, so the smallest label of a cluster is its smallest key
    labels = propagate_minimum(dense.select("cell").dropDuplicates(), links, scratch)
    named = dense.join(labels, "cell")
    sizes = named.groupBy("label").agg(F.sum("cell_rows").alias("size"))
    members = celled.join(named.join(sizes, "label"), ["cx", "cy"])
    return members.select(F.col("key").alias(key), F.col("label").alias("cluster"), "size", "cell_rows")


def describe_clusters(members: DataFrame, key: str, *, typical: int = 3, min_size: int = 2) -> DataFrame:
    """(cluster, size, densest_cell, typical): each cluster's size and the smallest keys of its densest cell, as a list.

    A window limited to ``typical`` rows a cluster lets every task cut its rows before the shuffle.
    """
    order = Window.partitionBy("cluster").orderBy(F.col("cell_rows").desc(), F.col(key).asc())
    top = members.filter(F.col("size") >= min_size).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= typical)
    return top.groupBy("cluster", "size").agg(
        F.max("cell_rows").alias("densest_cell"),
        F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda s: s[key]).alias("typical"),
    )
