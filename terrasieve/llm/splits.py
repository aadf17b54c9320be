"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasieve.llm.gridlinks import cell_links, with_cells
from terrasieve.plans.joins import join_same
from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch

#: Groups above this share of all weight are placed one by one; there are fewer than its inverse of them.
LARGE_SHARE = 0.005


def random_mate_components(edges: DataFrame, scratch: Scratch, *, seed: int = 0) -> DataFrame:
    """(node, root) for every node of an edge: nodes of one component, and only those, share a root.

    Random-mate contraction: each round every node draws a coin from a hash; a tail joins its smallest head
    neighbour, edges are renamed, and loops and repeated edges vanish. A round removes a fixed share of the
    connected nodes in expectation, whatever the shape, hubs and chains included. A node is contracted once, so
    all joins form a forest that pointer doubling then unwinds. Edges (u, v) are longs; nulls and loops are
    ignored; no edges give no rows. Each round is a written table, and only counts come to the driver.
    """
    u, v = F.col("u"), F.col("v")
    current = scratch.write(
        edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u < v").dropDuplicates(),
        "edges_0",
    )
    mates: list[DataFrame] = []
    for r in count(1):  # every round draws new coins, so edges run out
        if current.isEmpty():
            break
        head = lambda c, r=r: F.xxhash64(F.col(c), F.lit(seed), F.lit(r)).bitwiseAND(F.lit(1)) == 1
        directed = current.unionByName(current.select(v.alias("u"), u.alias("v")))
        chosen = scratch.write(
            directed.filter(~head("u") & head("v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")),
            f"mates_{r}",
        )
        mates.append(chosen)
        a = chosen.select(F.col("node").alias("u"), F.col("parent").alias("to_u"))
        b = chosen.select(F.col("node").alias("v"), F.col("parent").alias("to_v"))
        # an edge between two heads stays, one between two tails may move at both ends
        renamed = current.join(a, "u", "left").join(b, "v", "left").select(
            F.coalesce("to_u", "u").alias("p"),
            F.coalesce("to_v", "v").alias("q"),
        )
        current = scratch.write(
            renamed.filter("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).dropDuplicates(),
            f"edges_{r}",
        )
        scratch.drop(f"edges_{r - 1}")
    if not mates:
        return edges.select(u.cast("long").alias("node"), v.cast("long").alias("root")).limit(0)
    forest = mates[0]
    for m in mates[1:]:
        forest = forest.unionByName(m)
    forest = scratch.write(forest, "forest_0")
    for i in count(1):  # doubling ends after the logarithm of the longest path
        up = forest.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        forest = scratch.write(
            forest.join(up, "parent", "left").select(
                "node",
                F.coalesce("above", "parent").alias("parent"),
                F.col("above").isNotNull().alias("moved"),
            ),
            f"forest_{i}",
        )
        moved = forest.filter("moved").isEmpty()
        scratch.drop(f"forest_{i - 1}")
        forest = forest.select("node", "parent")
        if moved:
            break
    roots = forest.select(F.col("parent").alias("node"), F.col("parent").alias("root")).dropDuplicates()
    return forest.select("node", F.col("parent").alias("root")).unionByName(roots)


def place_edges(records: DataFrame, key: str, x: str, y: str, tolerance: float) -> DataFrame:
    """(u, v): a number of edges linear in the records that ties all records within ``tolerance`` in x and y, also by way of others.

    Records of one cell form a star around its smallest key; linked cells are tied by theirs.
    """
    placed = with_cells(
        records.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
            F.col(key).alias("node"),
            F.col(x).alias("x"),
            F.col(y).alias("y"),
        ),
        "x",
        "y",
        tolerance,
    )
    centre = placed.groupBy("cx", "cy").agg(F.min("node").alias("centre"))
    stars = placed.join(centre, ["cx", "cy"]).select(F.col("centre").alias("u"), F.col("node").alias("v")).filter("u <> v")
    a = centre.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("centre").alias("u"))
    b = centre.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("centre").alias("v"))
    links = cell_links(placed, tolerance).join(a, ["ax", "ay"]).join(b, ["bx", "by"]).select("u", "v")
    return stars.unionByName(links)


def shared_value_edges(records: DataFrame, key: str, field: str) -> DataFrame:
    """(u, v): a star around the smallest key of each value of ``field``; nulls tie nothing."""
    given = records.filter(F.col(field).isNotNull()).select(F.col(key).alias("v"), F.col(field).alias("value"))
    centre = given.groupBy("value").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return given.join(centre, "value").filter("u <> v").select("u", "v")


def related_groups(records: DataFrame, key: str, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, group): every record with the smallest key of its component; records without edges are groups of one."""
    roots = random_mate_components(edges, scratch)
    names = roots.groupBy("root").agg(F.min("node").alias("group"))
    named = roots.join(names, "root").select(F.col("node").alias(key), "group")
    return records.select(key).dropDuplicates().join(named, key, "left").select(key, F.coalesce("group", key).alias("group"))


def assign_splits(
    groups: DataFrame,
    group: str,
    weight: str,
    scratch: Scratch,
    *,
    shares: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.1), ("test", 0.1)),
    seed: int = 0,
) -> DataFrame:
    """``groups`` (one row per group, with a weight) with ``split``: groups in hashed order, cut where the cumulative weight reaches each share.

    Groups above ``LARGE_SHARE`` of all weight, fewer than 200 whatever the table's size, are placed before, heaviest
    first: into the split that lacks the largest part of its share among those with room for the group, or where none
    has room into the one with most room. The others fill what is then left of each share, to within one group. Null
    weights count as 0. An empty table gives no rows.
    """
    weighted = groups.withColumn("w", F.coalesce(F.col(weight), F.lit(0)).cast("long"))
    total = weighted.agg(F.sum("w")).first()[0] or 0
    rank = F.xxhash64(F.col(group), F.lit(seed))
    large = F.col("w") > F.lit(LARGE_SHARE * total)
    target = {name: share * total for name, share in shares}
    left = dict(target)
    placed_in = {}
    for row in weighted.filter(large).select(group, "w").orderBy(F.col("w").desc(), rank, F.col(group)).collect():
        roomy = [name for name in left if left[name] >= row["w"]]
        chosen = max(roomy, key=lambda s: left[s] / max(target[s], 1e-9)) if roomy else max(left, key=left.__getitem__)
        left[chosen] -= row["w"]
        placed_in[row[group]] = chosen
    small = weighted.filter(~large).withColumn("rank", rank)
    placed = global_positions(small, [], [F.col("rank"), F.col(group)], scratch, "cumulative", weight="w")
    middle = F.col("position") + F.col("w") / 2
    reached, split = 0.0, None
    for name, _ in shares[:-1]:
        reached += max(left[name], 0.0)
        split = F.when(middle < reached, name) if split is None else split.when(middle < reached, name)
    split = split.otherwise(shares[-1][0]) if split is not None else F.lit(shares[-1][0])
    out = placed.withColumn("split", split).select(*groups.columns, "split")
    if not placed_in:
        return out
    known = groups.sparkSession.createDataFrame(list(placed_in.items()), T.StructType([groups.schema[group], T.StructField("split", T.StringType())]))
    return out.unionByName(join_same(groups, known, [group]).select(*groups.columns, "split"))
