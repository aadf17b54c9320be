"""Effects of mutations under a linear model.

With a linear model, replacing one region's vector changes the prediction by a dot product with that region's
coefficients, so no mutated copy of the whole input is built; effects of different sites add up, so applying the
best mutations one after another is a running sum, and a sweep over how many to apply is a filter on its steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.operators.rank import first_rows
from terrasieve.operators.stats import quantiles
from terrasieve.plans.joins import join_same

#: How many accessions a packed list shows before it is cut.
LISTED = 50


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; NULL if either is NULL or their lengths differ."""
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def coefficient_rows(coefs: DataFrame, dim: int) -> DataFrame:
    """(variable, snp_index, w): coefficients over scale of each region as one array, from (variable, feature_index, coef, scale).

    A scale of 0 counts as 1. A region has ``dim`` features, so the lists are bounded.
    """
    w = F.col("coef") / F.when(F.coalesce(F.col("scale"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("scale"))
    rows = coefs.select(
        "variable",
        F.floor(F.col("feature_index") / dim).cast("int").alias("snp_index"),
        F.pmod(F.col("feature_index"), F.lit(dim)).alias("d"),
        w.alias("w"),
    )
    return rows.groupBy("variable", "snp_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda s: s["w"]).alias("w")
    )


def mutation_deltas(mutated: DataFrame, base: DataFrame, weights: DataFrame) -> DataFrame:
    """``mutated`` (accession, snp_index, ..., new_row) with ``variable`` and ``delta``, its change of the prediction.

    ``base`` has (accession, snp_index, old_row), ``weights`` (variable, snp_index, w). Rows with a NaN go.
    """
    rows = mutated.join(base, ["accession", "snp_index"]).join(weights, "snp_index")
    delta = dot(F.col("w"), F.zip_with("new_row", "old_row", lambda a, b: a.cast("double") - b.cast("double")))
    return rows.withColumn("delta", delta).filter(F.col("delta").isNotNull() & ~F.isnan("delta")).drop("new_row", "old_row", "w")


def cumulative_effects(
    df: DataFrame,
    accession: str,
    site: str,
    delta: str,
    ties: Sequence[str],
    direction: str = "positive",
) -> DataFrame:
    """Each accession's mutations in order of application: one per site, strongest first, with ``step`` and ``cumulative_delta``.

    Only mutations of the wanted sign are applied. An accession has a bounded number of sites.
    """
    up = direction == "positive"
    order = F.col(delta).desc() if up else F.col(delta).asc()
    wanted = df.filter(F.col(delta) > 0 if up else F.col(delta) < 0)
    per_site = first_rows(wanted, [accession, site], [order, *[F.col(t) for t in ties]])
    w = Window.partitionBy(accession).orderBy(order, F.col(site), *[F.col(t) for t in ties])
    return per_site.withColumn("step", F.row_number().over(w)).withColumn(
        "cumulative_delta",
        F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )


def scenarios(
    steps: DataFrame,
    accessions: DataFrame,
    accession: str,
    delta: str,
    tops: Sequence[int],
    baseline: str | None = None,
) -> DataFrame:
    """(top_n, accession, baseline, final, cumulative_delta, n_steps) for each N; 0 applies all. Accessions with nothing to apply get a zero row."""
    sweep = F.explode(F.array(*[F.lit(n) for n in tops]))
    base = F.col(baseline) if baseline else F.lit(0.0)
    every = accessions.select(accession, base.alias("baseline_pred")).withColumn("top_n", sweep)
    used = steps.select(F.col(accession).alias("__a"), "step", delta)
    joined = every.join(
        used,
        (F.col(accession) == F.col("__a")) & ((F.col("top_n") == 0) | (F.col("step") <= F.col("top_n"))),
        "left",
    )
    out = joined.groupBy("top_n", accession, "baseline_pred").agg(
        F.coalesce(F.sum(delta), F.lit(0.0)).alias("cumulative_delta"),
        F.count("step").alias("n_steps"),
    )
    return out.withColumn("final_pred", F.col("baseline_pred") + F.col("cumulative_delta"))


def joined_list(values: Column, limit: int = LISTED, separator: str = ";") -> Column:
    """The first ``limit`` values joined, with ``;...`` if there are more."""
    return F.concat(
        F.array_join(F.slice(values, 1, limit), separator),
        F.when(F.size(values) > limit, F.lit(f"{separator}...")).otherwise(F.lit("")),
    )


def variant_overlap(df: DataFrame, variant: Sequence[str], accession: str, delta: str, n_accessions: int) -> DataFrame:
    """Per variant: how many accessions share it, their fraction of ``n_accessions``, mean/median/max/min effect, and the first 50 ids.

    Ids are cut to 51 a task before they are shuffled, so a variant of very many accessions stays small.
    """
    rows = df.select(*variant, F.col(accession).alias("__a"), delta)
    stats = rows.groupBy(*variant).agg(
        F.count(F.lit(1)).alias("n_accessions"),
        F.avg(delta).alias("mean_delta"),
        F.max(delta).alias("max_delta"),
        F.min(delta).alias("min_delta"),
    )
    middle = quantiles(rows, variant, delta, (0.5,)).withColumnRenamed("q_0", "median_delta")
    ids = first_rows(rows.select(*variant, "__a").dropDuplicates(), variant, [F.col("__a")], LISTED + 1).groupBy(*variant).agg(
        joined_list(F.array_sort(F.collect_list(F.col("__a").cast("string")))).alias("accession_ids")
    )
    return join_same(join_same(stats, middle, variant, "left"), ids, variant, "left").withColumn(
        "accession_fraction",
        F.col("n_accessions") / F.lit(float(n_accessions)),
    )


def site_overlap(overlap: DataFrame, site: str, kind: str, variant: str) -> DataFrame:
    """Per site: how many distinct single and combined variants, and the most shared of each with its count ('' and 0 if none)."""
    n = lambda k: F.count(F.when(F.col(kind) == k, 1)).alias(f"n_distinct_{k}")
    counts = overlap.groupBy(site).agg(n("single"), n("combo"))
    order = [F.col("n_accessions").desc(), F.col("mean_delta").desc(), F.col(variant)]
    top = first_rows(overlap, [site, kind], order).select(site, kind, F.col(variant).alias("v"), F.col("n_accessions").alias("n"))
    for k in ("single", "combo"):
        own = top.filter(F.col(kind) == k).select(site, F.col("v").alias(f"top_{k}"), F.col("n").alias(f"top_{k}_count"))
        counts = join_same(counts, own, [site], "left").fillna({f"top_{k}": "", f"top_{k}_count": 0})
    return counts


def effect_magnitude(df: DataFrame, group: Sequence[str], effect: str, key: str) -> DataFrame:
    """Per group: n, mean, median and largest |effect| with the key it belongs to (smallest key on ties)."""
    rows = df.select(*group, key, F.abs(F.col(effect)).alias("size")).dropna(subset=["size"])
    top = first_rows(rows, group, [F.col("size").desc(), F.col(key)]).select(
        *group,
        F.col(key).alias("largest_key"),
        F.col("size").alias("largest"),
    )
    means = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean_size"))
    middle = quantiles(rows, group, "size", (0.5,)).withColumnRenamed("q_0", "median_size")
    return join_same(join_same(means, middle, group), top, group)


def common_items(df: DataFrame, item: str, unit: str, value: str, order: Sequence[str]) -> DataFrame:
    """Per item: in how many units it occurs, statistics of its value, and the first unit in the given order."""
    stats = df.groupBy(item).agg(
        F.count_distinct(unit).alias("n_units"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    return join_same(
        stats,
        first_rows(df, [item], [F.col(o) for o in order]).select(item, F.col(unit).alias("first_unit")),
        [item],
    )


def trajectory(steps: DataFrame, stats: DataFrame, variable: str) -> DataFrame:
    """Predictions and effects in the variable's own units: predictions are z * std + mean, effects z * std. ``stats`` has one row a variable."""
    wide = steps.join(stats.select(variable, "mean", "std"), variable)
    return wide.select(
        *[c for c in steps.columns if c not in ("cumulative_delta", "final_pred", "baseline_pred")],
        *[(F.col(c) * F.col("std") + F.col("mean")).alias(c) for c in ("baseline_pred", "final_pred")],
        (F.col("cumulative_delta") * F.col("std")).alias("cumulative_delta"),
    )


def write_intermediates(scenario: DataFrame, path: str) -> None:
    """The predictions of every scenario (top_n, accession, baseline_pred, cumulative_delta, final_pred, n_steps), a folder for each N."""
    scenario.write.mode("overwrite").partitionBy("top_n").parquet(path)


def intermediates_index(rows: DataFrame, accession: str) -> DataFrame:
    """(top_n, n_accessions, n_changed, n_steps, first, last): what the intermediates hold, one row a scenario."""
    return rows.groupBy("top_n").agg(
        F.count_distinct(accession).alias("n_accessions"),
        F.count_if(F.col("n_steps") > 0).alias("n_changed"),
        F.sum("n_steps").alias("n_steps"),
        F.min(accession).alias("first"),
        F.max(accession).alias("last"),
    )


def shared_sites(df: DataFrame, accession: str, site: str, delta: str, ties: Sequence[str], tops: Sequence[int]) -> DataFrame:
    """(direction, top_n, site, n_accessions, mean_delta): how many accessions have a site among the ``top_n`` they would apply, in either direction."""
    out = None
    for direction in ("positive", "negative"):
        steps = cumulative_effects(df, accession, site, delta, ties, direction)
        runs = steps.withColumn("top_n", F.explode(F.array(*[F.lit(n) for n in tops]))).filter("step <= top_n")
        n = runs.groupBy("top_n", site).agg(F.count_distinct(accession).alias("n_accessions"), F.avg(delta).alias("mean_delta"))
        part = n.select(F.lit(direction).alias("direction"), "top_n", site, "n_accessions", "mean_delta")
        out = part if out is None else out.unionByName(part)
    return out
