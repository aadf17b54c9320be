"""Graphs as edge tables: components, representatives, co-occurrence, and sets of sets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.operators.rank import first_rows
from terrasieve.plans.scratch import Scratch


def correlated_edges(pairs: DataFrame, threshold: float = 0.9, exclude_perfect: bool = False) -> DataFrame:
    """Pairs (a, b, r) with |r| above the threshold; ``exclude_perfect`` drops |r| = 1 as well."""
    r = F.abs(F.col("r"))
    return pairs.filter((r > threshold) & (r < 1.0) if exclude_perfect else r > threshold)


def similar_edges(table: DataFrame, a: str, b: str, q: str, threshold: float) -> DataFrame:
    """(a, b, q): links below a q-value, without loops, each pair once with its smallest q."""
    rows = table.filter((F.col(q) < threshold) & (F.col(a) != F.col(b)))
    return rows.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.min(q).alias("q"))


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    node: str = "node",
    a: str = "a",
    b: str = "b",
) -> DataFrame:
    """(node, component): every node with the smallest node of its component; lone nodes are their own.

    Minimum labels pass along edges and a node also takes its label's label, so rounds grow with the logarithm of a
    component's width; each round is a written table and only whether it changed anything comes to the driver.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = scratch.write(
        both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").dropDuplicates(),
        "edges",
    )
    every = nodes.select(F.col(node).alias("x")).unionByName(both.select("x")).dropna().dropDuplicates()
    labels = scratch.write(every.select("x", F.col("x").alias("label")), "labels_0")
    for r in count(1):  # labels only fall, so this ends
        offers = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("offer"))
        lower = labels.join(offers, "x", "left").select(
            "x",
            F.col("label").alias("old"),
            F.least("label", F.coalesce("offer", "label")).alias("to"),
        )
        above = labels.select(F.col("x").alias("to"), F.col("label").alias("up"))
        moved = lower.join(above, "to", "left").select("x", F.least("to", F.coalesce("up", "to")).alias("label"), "old")
        step = scratch.write(moved.select("x", "label", (F.col("label") < F.col("old")).alias("changed")), f"labels_{r}")
        labels = step.select("x", "label")
        scratch.drop(f"labels_{r - 1}")
        if step.filter("changed").isEmpty():
            return labels.select(F.col("x").alias(node), F.col("label").alias("component"))


def clusters_of_size(components: DataFrame, node: str, least: int = 2) -> DataFrame:
    """Components of at least ``least`` nodes, with ``size``."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return components.join(sizes, "component").select(node, "component", "size")


def representatives(components: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(component, node, distance): the node of each component with the smallest sum of q to its other members, ties by name.

    A missing pair counts 1, so the sum is (size - 1) less, for each link, what its q saves: no pairs are listed.
    """
    links = edges.select(F.col("a").alias(node), "q").unionByName(edges.select(F.col("b").alias(node), "q"))
    saved = links.groupBy(node).agg(F.sum(1 - F.col("q")).alias("saved"))
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    scored = components.join(sizes, "component").join(saved, node, "left").withColumn(
        "distance",
        F.col("size") - 1 - F.coalesce("saved", F.lit(0.0)),
    )
    return first_rows(scored, ["component"], [F.round("distance", 9), F.col(node)]).select("component", node, "distance", "size")


def cooccurrence(df: DataFrame, group: Sequence[str], item: str) -> DataFrame:
    """(a, b, n): in how many groups two different items stand together. Groups are small sets, such as one accession's step."""
    rows = df.select(*group, F.col(item).alias("a")).dropna(subset=["a"]).dropDuplicates()
    sets = rows.groupBy(*group).agg(F.array_sort(F.collect_list("a")).alias("items")).filter(F.size("items") > 1)
    pairs = sets.select(F.posexplode("items").alias("i", "a"), "items").select(
        "a",
        F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"),
    )
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def compare_partitions(left: DataFrame, right: DataFrame, cluster: str, member: str) -> DataFrame:
    """(side, members): clusters as sorted sets, in both partitions, only left, or only right."""
    sets = lambda df: df.groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members")).select("members").dropDuplicates()
    a, b = sets(left).withColumn("l", F.lit(1)), sets(right).withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, "members", "full").select(side.alias("side"), "members")


def supported(df: DataFrame, item: str, run: str, n_runs: int, how: str = "majority", least: int | None = None) -> DataFrame:
    """(item, n): items found in any, in all, in a majority (n // 2 + 1) or in at least ``least`` of the runs."""
    need = least or {"any": 1, "all": n_runs, "majority": n_runs // 2 + 1}[how]
    return df.groupBy(item).agg(F.count_distinct(run).alias("n")).filter(F.col("n") >= need)


def best_matches(
    table: DataFrame,
    query: str,
    target: str,
    p: str,
    q: str,
    threshold: float,
    queries: DataFrame | None = None,
) -> DataFrame:
    """(query, target, p, q, status): each query's best match; significant below the threshold, else non, and novel without any match."""
    best = first_rows(table, [query], [F.col(q).asc(), F.col(p).asc(), F.col(target).asc()]).select(query, target, p, q)
    status: Column = F.when(F.col(q) < threshold, "significant").otherwise("non")
    if queries is None:
        return best.withColumn("status", status)
    every = queries.select(query).dropDuplicates().join(best, query, "left")
    return every.withColumn("status", F.when(F.col(target).isNull(), "novel").otherwise(status))
