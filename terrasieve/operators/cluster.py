"""Clustering of records and of columns, and splits that keep places together within clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.plans.joins import join_same
from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch


def kmeans_labels(df: DataFrame, columns: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """Adds ``cluster`` by distributed k-means on complete rows."""
    rows = df.dropna(subset=list(columns)).withColumn(
        "__v",
        array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])),
    )
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__v")


def in_sample(key: str, run: int, share: float, seed: int = 0):  # noqa: ANN201
    """Whether a record is in a run's sample: a hash of its key, so no row moves."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(run), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def consensus_agreement(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    ks: Sequence[int],
    runs: int = 5,
    share: float = 0.5,
    seed: int = 0,
    bins: int = 20,
    labels: Callable[..., DataFrame] = kmeans_labels,
) -> DataFrame:
    """(k, bin, pairs): for each k, how often two records fall into one cluster of those runs that sample both, over all pairs.

    Agreement depends only on a record's labels over the runs, so records are counted by these, at most (k + 1) ** runs
    combinations, and the counts multiplied pairwise; with many runs the combinations near the number of records. As
    in a consensus matrix, pairs that no run samples together agree 0; a pair counts once, and no record with itself.
    Each (k, run) is one clustering job; ``labels`` may be any function with the arguments of ``kmeans_labels``. A
    density over the agreement in ``bins`` bins.
    """
    scratch = Scratch(df.sparkSession, "consensus")
    out = None
    for k in ks:
        seen = df.select(F.col(key).alias("id"), F.lit(-1).alias("run"), F.lit(-1).alias("cluster"))
        for r in range(runs):
            got = labels(
                df.filter(in_sample(key, r, share, seed)),
                columns,
                k,
                seed + r,
            ).select(F.col(key).alias("id"), F.lit(r).alias("run"), "cluster")
            seen = seen.unionByName(scratch.write(got, f"labels_{k}_{r}"))
        label = lambda r: F.coalesce(F.max(F.when(F.col("run") == r, F.col("cluster"))), F.lit(-1))
        signed = seen.groupBy("id").agg(F.array(*[label(r) for r in range(runs)]).alias("s"))
        counts = scratch.write(signed.groupBy("s").agg(F.count(F.lit(1)).alias("n")), f"signatures_{k}")
        other = counts.select(F.col("s").alias("t"), F.col("n").alias("m"))
        pairs = F.when(F.col("s") == F.col("t"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("m"))
        tally = lambda hit: F.aggregate(F.zip_with("s", "t", hit), F.lit(0), lambda acc, v: acc + v.cast("int"))
        both = tally(lambda x, y: (x >= 0) & (y >= 0))
        same = tally(lambda x, y: (x >= 0) & (x == y))
        agreed = counts.join(other, F.col("s") <= F.col("t")).select(
            pairs.alias("pairs"),
            F.coalesce(same / F.nullif(both, F.lit(0)), F.lit(0.0)).alias("m"),
        )
        hist = agreed.filter("pairs > 0").groupBy(
            F.least(F.floor(F.col("m") * bins), F.lit(bins - 1)).cast("int").alias("bin")
        ).agg(F.sum("pairs").alias("pairs")).withColumn("k", F.lit(k))
        out = hist if out is None else out.unionByName(hist)
    return out.select("k", "bin", "pairs")


def area_under_cdf(hist: DataFrame, bins: int = 20) -> DataFrame:
    """(k, area, gain): area under the cumulative agreement of each k and its relative gain over the k before; a few dozen rows."""
    so_far = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("pairs").over(Window.partitionBy("k"))
    width = (F.coalesce(F.lead("bin").over(Window.partitionBy("k").orderBy("bin")), F.lit(bins)) - F.col("bin")) / bins
    areas = hist.withColumn("part", F.sum("pairs").over(so_far) / total * width).groupBy("k").agg(F.sum("part").alias("area"))
    before = F.lag("area").over(Window.orderBy("k"))
    return areas.select(
        "k",
        "area",
        F.when(before.isNull(), F.col("area")).otherwise((F.col("area") - before) / F.nullif(before, F.lit(0.0))).alias("gain"),
    )


def linkage_labels(distances: np.ndarray, cut: float | None = None, n: int | None = None, how: str = "average") -> np.ndarray:
    """Agglomerative clusters of a few dozen items from their distance matrix (average or ward), cut at a distance or a number.

    For columns, of which a table has tens; records are clustered by the distributed operators.
    """
    d = np.array(distances, np.float64)
    size = np.ones(len(d))
    label = np.arange(len(d))
    alive = list(range(len(d)))
    np.fill_diagonal(d, np.inf)
    while len(alive) > (n or 1):
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        if cut is not None and sub[i, j] > cut:
            break
        a, b = sorted((alive[i], alive[j]))
        for c in alive:
            if c in (a, b):
                continue
            if how == "ward":
                t = size[a] + size[b] + size[c]
                d[a, c] = d[c, a] = np.sqrt(
                    ((size[a] + size[c]) * d[a, c] ** 2 + (size[b] + size[c]) * d[b, c] ** 2 - size[c] * d[a, b] ** 2) / t
                )
            else:
                d[a, c] = d[c, a] = (size[a] * d[a, c] + size[b] * d[b, c]) / (size[a] + size[b])
        size[a] += size[b]
        label[label == b] = a
        alive.remove(b)
    _, out = np.unique(label, return_inverse=True)
    return out


def simplified_silhouette(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """One row ``silhouette``: mean of (b - a) / max(a, b) with a and b the distances to the own and the nearest other centroid.

    Distances to centroids replace those to all records, which would be quadratic. The centroids, one row a
    cluster, are broadcast.
    """
    rows = df.dropna(subset=[*columns, cluster])
    centres = rows.groupBy(F.col(cluster).alias("__c")).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)])
    number = F.array(*[F.col(c).cast("double") for c in columns])
    one = centres.agg(
        F.collect_list(F.struct("__c", F.array(*[F.col(f"__m{i}") for i in range(len(columns))]).alias("m"))).alias("cs")
    )
    dist = lambda m: F.sqrt(F.aggregate(F.zip_with(number, m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    own = F.array_max(F.transform(F.filter("cs", lambda c: c["__c"] == F.col(cluster)), lambda c: dist(c["m"])))
    other = F.array_min(F.transform(F.filter("cs", lambda c: c["__c"] != F.col(cluster)), lambda c: dist(c["m"])))
    scored = rows.join(F.broadcast(one)).select(own.alias("a"), other.alias("b"))
    return scored.agg(F.avg((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))).alias("silhouette"))


def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str,
    place: Sequence[str],
    *,
    test: float = 0.2,
    val: float = 0.08,
    least: int = 3,
    seed: int = 0,
) -> DataFrame:
    """(key, split): within each stratum places are shuffled by hash and cut by their records: test, then val, then train.

    All records of a place share a split. Strata of fewer than ``least`` places go to train. Strata may be of any
    size: cumulative counts come from global positions.
    """
    rows = df.select(key, stratum, F.xxhash64(*place).alias("place"))
    places = rows.groupBy(stratum, "place").agg(F.count(F.lit(1)).alias("n"))
    totals = places.groupBy(stratum).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("places"))
    placed = global_positions(
        places.withColumn("h", F.md5(F.concat_ws(":", F.col("place").cast("string"), F.lit(str(seed))))),
        [stratum],
        [F.col("h")],
        Scratch(df.sparkSession, "stratified"),
        "places",
        weight="n",
    )
    on = placed[stratum].eqNullSafe(totals[stratum])
    at = F.col("position") / F.col("total")
    split = F.when(F.col("places") < least, "train").when(at < test, "test").when(at < test + val, "val").otherwise("train")
    cut = placed.join(totals, on).select(placed[stratum].alias("s"), F.col("place").alias("p"), split.alias("split"))
    return rows.join(cut, rows[stratum].eqNullSafe(cut["s"]) & (rows["place"] == cut["p"])).select(key, "split")


def group_split(
    df: DataFrame,
    key: str,
    stratum: str,
    place: Sequence[str],
    *,
    test: float = 0.2,
    val: float = 0.08,
    seed: int = 0,
) -> DataFrame:
    """(key, split): keys of each stratum shuffled by hash, each standing for as many rows as its place has keys, and cut by rows.

    The keys of the first ``test`` share of rows are test, those of the next ``val`` share of the rest val, the others
    train; a share is rounded down, to one row at least. A stratum of one key gives test only, one of two keys no
    train. Rows are one per key; strata of any size: cumulative counts come from global positions.
    """
    at = df.groupBy(*place).agg(F.count(F.lit(1)).alias("repeats"))
    rows = join_same(df.select(key, stratum, *place), at, list(place)).select(key, stratum, "repeats")
    shuffled = rows.withColumn("h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    scratch = Scratch(df.sparkSession, "groups")
    placed = global_positions(shuffled, [stratum], [F.col("h"), F.col(key)], scratch, "keys", weight="repeats")
    totals = rows.groupBy(stratum).agg(F.sum("repeats").alias("total"), F.count(F.lit(1)).alias("keys"))
    wide = join_same(placed, totals, [stratum])
    in_test = F.col("position") < F.greatest(F.floor(F.lit(test) * F.col("total")), F.lit(1))
    taken = wide.filter(in_test).groupBy(stratum).agg(F.sum("repeats").alias("taken"))
    wide = join_same(wide, taken, [stratum])
    in_val = F.col("position") - F.col("taken") < F.greatest(F.floor(F.lit(val) * F.col("total")), F.lit(1))
    split = F.when(in_test, "test").when(in_val & (F.col("keys") >= 2), "val").when(F.col("keys") >= 3, "train")
    return wide.select(key, split.alias("split")).filter("split is not null")


def split_report(splits: DataFrame, total: str = "n") -> DataFrame:
    """(split, n, share) of a table of keys and splits."""
    counts = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(
        "split",
        "n",
        (F.col("n") / F.col("all")).alias("share"),
    )
