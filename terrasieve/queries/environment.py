"""Cleaning, merging, scaling, ranking and model comparison on the environment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions.values import present
from terrasieve.operators import clean, cluster, graph, models, rank, raster, stats
from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch
from terrasieve.queries import table
from terrasieve.queries.quality import sound_loads

COORDS, FIXED, COMBINED, NORMALIZED = "coords_with_bioclim", "coords_with_bioclim_30s_fixed", "combined_variables_dataset", "combined_variables_dataset_normalized"
BIO = [f"bio{i}" for i in range(1, 20)]
CORRELATED = ["bio1", "bio5", "bio6", "bio10", "bio11", "bio12", "bio13", "bio16"]


def _r(c: str, digits: int = 6, name: str | None = None):  # noqa: ANN202
    return F.round(F.col(c), digits).alias(name or c)


def ok(c: str) -> str:
    return f"({c} is not null and not isnan({c}) and {c} > -1e30)"


def val(c: str) -> str:
    return f"case when {ok(c)} then {c} end"


def clean_complete(spark: SparkSession, d: str) -> DataFrame:
    return clean.complete_rows(table(spark, d, FIXED), BIO).select("iid", "load_no", "bio1", "bio12", "bio19")


def missing_by_column(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each numeric column are missing, found from the schema."""
    df = table(spark, d, FIXED)
    columns = clean.value_columns(df, exclude=("iid", "fid", "load_no"))
    wide = clean.null_no_data(df, columns).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "name", "n_missing")


def merge_inner(spark: SparkSession, d: str) -> DataFrame:
    columns = ["bio1", "bio2"]
    left, right = (clean.null_no_data(table(spark, d, t), columns) for t in (COORDS, NORMALIZED))
    return clean.merge_tables(left, right).select("iid", "bio1", "bio1_right", "bio2", "bio2_right")


def merge_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Left join where the exact join of differently rounded coordinates gives fewer than five rows, else that."""
    left = table(spark, d, FIXED).select("fid", "iid", "long", "lat", "bio1")
    merged = clean.merge_tables(left, table(spark, d, COORDS).select("fid", "iid", "long", "lat", "source"), least=5)
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def ids_semi(spark: SparkSession, d: str) -> DataFrame:
    return clean.keep_ids(table(spark, d, COORDS), table(spark, d, "splits"), "iid").select("iid", "source")


def ids_anti(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_ids(table(spark, d, COORDS), table(spark, d, "splits"), "iid").select("iid", "source")


def places_in_box(spark: SparkSession, d: str) -> DataFrame:
    return clean.in_box(
        table(spark, d, COORDS),
        "long",
        "lat",
        (-10.0, 30.0, 35.0, 60.0),
    ).select("iid", "long", "lat").dropDuplicates()


def places_by_source(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_place(table(spark, d, COORDS)).groupBy("source").agg(F.count(F.lit(1)).alias("n_placed"))


def frequent_sources(spark: SparkSession, d: str) -> DataFrame:
    return clean.frequent_classes(table(spark, d, COORDS), "source", 60).select("iid", "source")


def split_labels(spark: SparkSession, d: str) -> DataFrame:
    names = {"training": "train", "validation": "val", "valid": "val"}
    label = clean.relabel(F.lower(F.trim("split")), names)
    return cluster.split_report(table(spark, d, "splits").select("iid", label.alias("split"))).select("split", "n", _r("share"))


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A dimension looked up by key, unmatched rows kept."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        table(spark, d, "region"),
        F.col("n_regionkey") == F.col("r_regionkey"),
        "left",
    ).select("c_custkey", "n_name", "r_name")


def ratio_and_denormalise(spark: SparkSession, d: str) -> DataFrame:
    """Relative width of the range of each accession, and a z-score put back on the scale of the raw table."""
    raw = clean.complete_rows(table(spark, d, COORDS), ["bio2", "bio7"]).select("iid", "bio2", "bio7").dropDuplicates()
    mean_sd = raw.agg(F.avg("bio2").alias("m"), F.stddev_samp("bio2").alias("s"))
    z = table(spark, d, NORMALIZED).select("iid", present("bio2").alias("z")).dropna().dropDuplicates()
    return raw.join(z, "iid").join(F.broadcast(mean_sd)).select(
        "iid",
        F.round(F.try_divide("bio2", "bio7"), 6).alias("ratio"),
        F.round(F.col("z") * F.col("s") + F.col("m"), 6).alias("denormalised"),
    )


def names_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Column names taken apart: the mean of every bio<number> column per load."""
    df = table(spark, d, FIXED)
    long = clean.named_parts(clean.null_no_data(df, BIO).select("load_no", *BIO), ["load_no"], r"^bio(\d+)$", ["number"])
    return long.groupBy("load_no", "number").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def row_means(spark: SparkSession, d: str) -> DataFrame:
    df = clean.null_no_data(table(spark, d, FIXED), ["bio8", "bio9", "bio10"])
    return df.select("iid", "load_no", F.round(clean.row_mean([F.col(c) for c in ("bio8", "bio9", "bio10")]), 6).alias("mean"))


def _scaled(method: str):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        return stats.scale(table(spark, d, COMBINED), ["bio1", "bio3", "bio_11_6"], method).select(
            "iid",
            "load_no",
            *[_r(c) for c in ("bio1", "bio3", "bio_11_6")],
        )

    query.__doc__ = f"Columns scaled by {method}, one of them constant."
    return query


def scale_train_apply(spark: SparkSession, d: str) -> DataFrame:
    return stats.scale(
        table(spark, d, COMBINED),
        ["bio1", "bio5"],
        "zscore0",
        fit_on=F.col("load_no") == 1,
    ).select("iid", "load_no", _r("bio1"), _r("bio5"))


def combine_correlated(spark: SparkSession, d: str) -> DataFrame:
    name = stats.cluster_name(["bio6", "bio11"])
    out = stats.combine_columns(table(spark, d, COORDS).select("iid", "bio6", "bio11"), {name: ["bio6", "bio11"]})
    return out.select("iid", _r(name))


def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_pairs(table(spark, d, COORDS), CORRELATED).select("a", "b", _r("r"))


def corr_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every pair of columns by their correlation."""
    pairs = stats.correlation_pairs(table(spark, d, COORDS), CORRELATED)
    return pairs.select("a", "b", F.round(stats.correlation_distance(F.col("r")), 6).alias("distance"))


def _variable_components(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = graph.correlated_edges(stats.correlation_pairs(table(spark, d, COORDS), CORRELATED), 0.8)
    nodes = spark.createDataFrame([(c,) for c in CORRELATED], "node string")
    return graph.connected_components(nodes, edges), edges


def corr_components(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _variable_components(spark, d)
    return graph.clusters_of_size(found, "node")


def corr_representatives(spark: SparkSession, d: str) -> DataFrame:
    found, edges = _variable_components(spark, d)
    return graph.representatives(
        found,
        edges.select("a", "b", (1 - F.abs("r")).alias("q")),
    ).select("component", "node", _r("distance"), "size")


def partitions_compared(spark: SparkSession, d: str) -> DataFrame:
    """Every accession grouped by raw fid, marks of missing ones included, in the two environment tables, as sets of sets."""
    pick = lambda t: table(spark, d, t).filter("iid is not null").select("fid", "iid")
    return graph.compare_partitions(pick(COORDS), pick(NORMALIZED), "fid", "iid").groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("members").alias("first_set"),
    )


def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = clean.null_no_data(table(spark, d, COMBINED).select("load_no", "iid", "bio1"), ["bio1"])
    return stats.average_rank(rows, "bio1", ["load_no"])


def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well bio6 stands in for bio11, per collection."""
    m = stats.prediction_metrics(table(spark, d, COORDS).filter("source is not null"), ["source"], "bio11", "bio6")
    return m.select("source", "n", *[_r(c) for c in ("mse", "mae", "r2", "r2_cor", "spearman")])


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    m = stats.score_summary(table(spark, d, "gradient_peaks_summary"), ["variable"], "zscore")
    return m.select("variable", "n", *[_r(c, 9) for c in ("mean", "sem", "median", "mean_top")])


def quantiles_by_load(spark: SparkSession, d: str) -> DataFrame:
    q = stats.quantiles(table(spark, d, FIXED), ["load_no"], "bio12", (0.05, 0.5, 0.95))
    return q.select("load_no", *[_r(f"q_{i}") for i in range(3)])


def histogram(spark: SparkSession, d: str) -> DataFrame:
    h = stats.density_histogram(table(spark, d, NORMALIZED), "bio1", 24, -3.0, 3.0)
    return h.select("bin", _r("density"), _r("cdf"))


def area_changes(spark: SparkSession, d: str) -> DataFrame:
    """Relative change of a series of one number per load."""
    rows = table(spark, d, FIXED).groupBy("load_no").agg(F.avg(present("bio12")).alias("area"))
    return stats.relative_change(rows, "load_no", "area").select("load_no", _r("change"))


def explained_count(spark: SparkSession, d: str) -> DataFrame:
    """How many variables, by name, hold eight tenths of all peaks."""
    rows = table(spark, d, "gradient_peaks_summary").groupBy("variable").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return stats.smallest_reaching(rows, "variable", "n", 0.8)


def median_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return stats.closest_to_median(
        table(spark, d, "customer"),
        "c_custkey",
        "c_acctbal",
    ).select("c_custkey", "c_acctbal", _r("distance"))


def extreme_climates(spark: SparkSession, d: str) -> DataFrame:
    return rank.extremes(
        clean.complete_rows(table(spark, d, NORMALIZED), ["bio1"]).select("iid", "bio1").dropDuplicates(),
        "iid",
        "bio1",
        10,
    )


def consensus_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank over three variables; the ten lowest and highest accessions."""
    rows = clean.complete_rows(
        table(spark, d, NORMALIZED),
        ["bio1", "bio5", "bio_11_6"],
    ).select("iid", "bio1", "bio5", "bio_11_6").dropDuplicates()
    for c in ("bio1", "bio5", "bio_11_6"):
        rows = stats.average_rank(rows, c, name=f"r_{c}")
    mean = rows.select("iid", clean.row_mean([F.col(f"r_{c}") for c in ("bio1", "bio5", "bio_11_6")]).alias("mean_rank"))
    return rank.extremes(mean.withColumn("mean_rank", F.round("mean_rank", 4)), "iid", "mean_rank", 10)


def _model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score per variable (as model) and block of sites, from the peaks."""
    rows = table(spark, d, "gradient_peaks_summary").withColumn("block", F.pmod("snp_index", F.lit(40)))
    return rows.groupBy("block", "variable").agg(
        (F.sum(F.round(present("zscore") * 1000).cast("long")) / F.count(present("zscore"))).alias("score")
    )


def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return stats.win_tie_loss(_model_scores(spark, d), "block", "variable", "score").select(
        "a",
        "b",
        "wins",
        "ties",
        "losses",
        _r("mean_diff", 9),
    )


def friedman_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.friedman(
        _model_scores(spark, d),
        "block",
        "variable",
        "score",
    ).select("variable", "n_blocks", _r("mean_rank"), _r("chi2"))


def wilcoxon_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, COORDS).filter("source is not null").select(
        "source",
        F.round(present("bio10"), 2).alias("x"),
        F.round(present("bio5") - 7.5, 2).alias("y"),
    )
    rows = rows.withColumns({"x": F.round(F.col("x") - F.col("y"), 2), "y": F.lit(0.0)})
    return stats.wilcoxon(rows, ["source"], "x", "y").select("source", "n", "w_plus", "w_minus", _r("z"))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return stats.bootstrap_mean(rows, "o_orderkey", "o_totalprice", group=["o_orderpriority"], reps=100)


def bootstrap_r2(spark: SparkSession, d: str) -> DataFrame:
    """How well bio6 stands in for bio11, per collection, with an interval from 1,000 resamples; deliveries of one accession are drawn together."""
    rows = table(spark, d, COORDS).filter("source is not null")
    return stats.bootstrap_r2(rows, "iid", "bio11", "bio6", group=["source"])


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and differences of the accessions of two tables, counted."""
    a, b = (table(spark, d, t).select("iid").dropna().dropDuplicates() for t in (COORDS, NORMALIZED))
    parts = {
        "union": a.union(b).dropDuplicates(),
        "both": a.intersect(b),
        "only_raw": a.exceptAll(b),
        "only_normalized": b.exceptAll(a),
    }
    out = None
    for name, rows in parts.items():
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.min("iid").alias("first_iid")).withColumn("part", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def loads_appended(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of different columns appended with a tag."""
    a, b = (table(spark, d, t).withColumn("src", F.lit(t)) for t in (FIXED, COMBINED))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("src", "load_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("bio_11_6").isNotNull(), 1)).alias("n_combined"),
        F.count(F.when(F.col("bio6").isNotNull(), 1)).alias("n_raw"),
    )


def pivoted_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("language", F.lower("lang"))
    wide = docs.groupBy("variable").pivot("language", ["en", "de", "es", "fr"]).agg(F.count(F.lit(1)))
    return wide.select("variable", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in ("en", "de", "es", "fr")])


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, COORDS).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("source"))


def global_range(spark: SparkSession, d: str) -> DataFrame:
    v = present("bio12")
    return table(spark, d, FIXED).agg(
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.count_distinct(v).alias("n_distinct"),
        F.count(v).alias("n"),
    )


def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    """A variant's row once for each of its positions."""
    rows = table(spark, d, "variant_overlap_summary").filter("size is not null").select(
        "variant_id",
        "snp_index",
        F.explode(F.array_repeat(F.lit(1), F.col("size"))).alias("one"),
    )
    return rows.groupBy("snp_index").agg(F.sum("one").alias("n"))


def loads_majority(spark: SparkSession, d: str) -> DataFrame:
    return graph.supported(table(spark, d, COMBINED).filter("iid is not null"), "iid", "load_no", 8)


def loads_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.supported(table(spark, d, COMBINED).filter("iid is not null"), "iid", "load_no", 8, "all")


def loads_any(spark: SparkSession, d: str) -> DataFrame:
    return graph.supported(table(spark, d, COMBINED).filter("iid is not null"), "iid", "load_no", 8, "any")


def shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, NORMALIZED).select("iid").dropna().dropDuplicates()
    return rank.hashed_order(rows, "iid", 7)


def listed_order(spark: SparkSession, d: str) -> DataFrame:
    """Sources in the order of their most southern place, those without any last."""
    first = clean.with_place(table(spark, d, COORDS)).groupBy("source").agg(F.min("lat").alias("south")).filter("source is not null")
    every = table(spark, d, COORDS).select("source").dropna().dropDuplicates()
    return rank.listed_order(every, first, "source", "south")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, COORDS).filter("iid is not null").select("iid", "source", "long", "lat").dropDuplicates(["iid"])
    return cluster.stratified_split(rows, "iid", "source", ["long", "lat"])


def kmeans_silhouette(spark: SparkSession, d: str) -> DataFrame:
    columns = ["bio1", "bio5", "bio_11_6"]
    rows = clean.complete_rows(table(spark, d, NORMALIZED), columns)
    return cluster.simplified_silhouette(cluster.kmeans_labels(rows, columns, 6), columns, "cluster")


def consensus_areas(spark: SparkSession, d: str) -> DataFrame:
    columns = ["bio1", "bio5"]
    rows = clean.complete_rows(table(spark, d, NORMALIZED), columns).select("iid", *columns).dropDuplicates(["iid"])
    return cluster.area_under_cdf(cluster.consensus_agreement(rows, "iid", columns, (2, 3), runs=3))


def nearest_cells(spark: SparkSession, d: str) -> DataFrame:
    """A half-degree grid of mean bio1; cells whose records all lack it take the nearest valid cell's."""
    rows = clean.with_place(table(spark, d, COORDS)).filter("abs(long) <= 180 and abs(lat) <= 90")
    cells = rows.groupBy(
        F.floor(F.col("lat") * 2).alias("r"),
        F.floor(F.col("long") * 2).alias("c"),
    ).agg(F.min(present("bio1")).alias("v"))
    out = raster.nearest_valid(cells, "r", "c", "v", 6)
    return out.select("r", "c", "v", F.round("distance", 6).alias("distance"))


def conover_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = stats.conover_pairs(_model_scores(spark, d), "block", "variable", "score")
    return out.select("a", "b", _r("rank_difference"), _r("t"))


def smoothed_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """How the relative yearly range changes with the mean temperature."""
    rows = clean.complete_rows(table(spark, d, COORDS), ["bio1", "bio2", "bio7"])
    return stats.smooth_curve(rows.withColumn("ratio", F.try_divide("bio2", "bio7")), "bio1", "ratio")


def support_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.scale(sound_loads(spark, d, COMBINED), ["bio1", "bio2", "bio5", "bio9"], "zscore0")
    return models.linear_svr(rows, ["bio1", "bio2", "bio5", "bio9"], ["bio_11_6", "bio_10_5"])


def column_groups(spark: SparkSession, d: str) -> DataFrame:
    """Columns grouped by average linkage on their correlation distance, cut where they share nine tenths."""
    pairs = stats.correlation_pairs(table(spark, d, COORDS), CORRELATED).collect()  # one row per pair of columns
    at = {c: i for i, c in enumerate(CORRELATED)}
    gaps = [[0.0] * len(at) for _ in at]
    for p in pairs:
        gaps[at[p["a"]]][at[p["b"]]] = gaps[at[p["b"]]][at[p["a"]]] = (2 * (1 - min(1.0, abs(p["r"] or 0.0)))) ** 0.5
    labels = cluster.linkage_labels(gaps, cut=(2 * 0.1) ** 0.5)
    return spark.createDataFrame([(c, int(k)) for c, k in zip(CORRELATED, labels, strict=True)], "variable string, cluster int")


def aligned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Accessions of three tables at once, in the order of their identifiers, with a place."""
    key = lambda t: table(spark, d, t).select("iid").dropna().dropDuplicates()
    common = key(COORDS).join(key(NORMALIZED), "iid").join(key(COMBINED), "iid")
    return global_positions(common, [], [F.col("iid")], Scratch(spark, "aligned"), "ids")


def family_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents by family of sources (the name before the first dash or dot) and by source within it."""
    docs = table(spark, d, "documents").filter("source is not null").withColumn(
        "family",
        F.regexp_extract("source", r"^([^.-]+)", 1),
    )
    by_source = docs.groupBy("family", "source").agg(F.count(F.lit(1)).alias("n"))
    total = by_source.groupBy("family").agg(F.sum("n").alias("n_family"))
    return by_source.join(total, "family").select(
        "family",
        "source",
        "n",
        "n_family",
        F.round(F.col("n") / F.col("n_family"), 6).alias("share"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        nearest_cells, conover_pairs, smoothed_uncertainty, support_vectors, column_groups, aligned_ids, family_shares, clean_complete, missing_by_column, merge_inner, merge_fallback, ids_semi, ids_anti, places_in_box, places_by_source, frequent_sources, split_labels, label_lookup,
        ratio_and_denormalise, names_parsed, row_means, scale_train_apply, combine_correlated, corr_pairs, corr_distances, corr_components, corr_representatives, partitions_compared, average_ranks,
        prediction_metrics, score_summary, quantiles_by_load, histogram, area_changes, explained_count, median_neighbours, extreme_climates, consensus_extremes, win_tie_loss,
        friedman_ranks, wilcoxon_by_source, bootstrap_interval, bootstrap_r2, id_sets, loads_appended, pivoted_languages, source_counts, global_range, repeated_rows, loads_majority, loads_all,
        loads_any, shuffled_order, listed_order, stratified_split, kmeans_silhouette, consensus_areas,
    )
} | {"partitions_compared_all": partitions_compared} | {f"scale_{m}": _scaled(m) for m in ("zscore", "zscore0", "minmax", "robust")}

_PLACED = f"{ok('long')} and {ok('lat')} and long <> -9 and lat <> -9"
_SCALE = {
    "zscore": ("avg({x})", "stddev_samp({x})"),
    "zscore0": ("avg({x})", "stddev_pop({x})"),
    "minmax": ("min({x})", "max({x}) - min({x})"),
    "robust": ("median({x})", "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"),
}


def _scale_sql(method: str) -> str:
    columns = ("bio1", "bio3", "bio_11_6")
    centre, spread = _SCALE[method]
    agg = ", ".join(f"{centre.format(x=c)} c_{c}, {spread.format(x=c)} s_{c}" for c in columns)
    out = ", ".join(f"round(({c} - c_{c}) / coalesce(nullif(s_{c}, 0), 1), 6) + 0.0 {c}" for c in columns)
    return f"with v as (select iid, load_no, {', '.join(f'{val(c)} {c}' for c in columns)} from {COMBINED}), a as (select {agg} from v) select iid, load_no, {out} from v, a"


def _corr_sql() -> str:
    v = ", ".join(f"{val(c)} {c}" for c in CORRELATED)
    pairs = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]
    return f"v as (select {v} from {COORDS}), r as ({' union all '.join(f'''select '{a}' a, '{b}' b, corr({a}, {b}) r from v''' for a, b in pairs)})"


_COMPONENTS = f"""with recursive {_corr_sql()}, e as (select a, b, 1 - abs(r) q from r where abs(r) > 0.8), u as (select a, b from e union select b, a from e),
reach as (select a node, a root from u union select u.b, reach.root from reach join u on reach.node = u.a),
n as (select node from (values {', '.join(f"('{c}')" for c in CORRELATED)}) t(node)),
c as (select n.node, coalesce(min(root), n.node) component from n left join reach on reach.node = n.node group by n.node)"""
_SCORES = f"s as (select snp_index % 40 block, variable, sum(cast(round({val('zscore')} * 1000) as bigint)) / count({val('zscore')}) score from gradient_peaks_summary group by 1, 2)"
_RANK = "(rank() over (partition by {p} order by {o}) + (count(*) over (partition by {p}, {v}) - 1) / 2.0)"
_SUPPORT = f"select iid, count(distinct load_no) n from {COMBINED} where iid is not null group by iid having count(distinct load_no) >= "

ORACLES = {
    "nearest_cells": f"""with g as (select cast(floor(lat * 2) as bigint) r, cast(floor(long * 2) as bigint) c, min(case when {ok('bio1')} then bio1 end) v from {COORDS} where {_PLACED} and abs(long) <= 180 and abs(lat) <= 90 group by 1, 2),
m as (select a.r, a.c, b.v, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) s, row_number() over (partition by a.r, a.c order by (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c) k
 from g a left join g b on b.v is not null and abs(a.r - b.r) <= 6 and abs(a.c - b.c) <= 6 where a.v is null)
select r, c, v, cast(0 as double) distance from g where v is not null union all select r, c, v, round(sqrt(s), 6) from m where k = 1""",
    "conover_pairs": f"""with {_SCORES}, k as (select count(distinct variable) k from s where score is not null), w as (select * from s where score is not null and block in (select block from s where score is not null group by 1 having count(*) = (select k from k))),
r as (select *, {_RANK.format(p='block', o='score desc', v='score')} rk from w), m as (select variable, count(*) n, sum(rk) r, sum(rk * rk) q from r group by 1), e as (select sqrt(2 * (max(n) * sum(q) - sum(r * r)) / ((max(n) - 1) * (count(*) - 1))) e from m)
select a.variable a, b.variable b, round((a.r - b.r) / a.n, 6) rank_difference, round(abs(a.r - b.r) / e.e, 6) t from m a join m b on a.variable < b.variable, e""",
    "aligned_ids": f"""select iid, row_number() over (order by iid) - 1 "position" from (select iid from {COORDS} where iid is not null intersect select iid from {NORMALIZED} intersect select iid from {COMBINED})""",
    "family_shares": """with f as (select regexp_extract(source, '^([^.-]+)', 1) family, source, count(*) n from documents where source is not null group by 1, 2) select *, cast(sum(n) over (partition by family) as bigint) n_family, round(n / (sum(n) over (partition by family)), 6) share from f""",
    "clean_complete": f"select iid, load_no, bio1, bio12, bio19 from {FIXED} where {' and '.join(ok(c) for c in BIO)}",
    "missing_by_column": " union all ".join(
        f"select '{c}' \"name\", count(*) - count({val(c)}) n_missing from {FIXED}" for c in ["long", "lat", *BIO]
    ),
    "merge_inner": f"select a.iid, {val('a.bio1')} bio1, {val('b.bio1')} bio1_right, {val('a.bio2')} bio2, {val('b.bio2')} bio2_right from {COORDS} a join {NORMALIZED} b on a.fid = b.fid and a.iid = b.iid and a.long = b.long and a.lat = b.lat",
    "merge_fallback": f"""with l as (select * from {FIXED}), i as (select r.source from l join {COORDS} r on l.fid = r.fid and l.iid = r.iid and l.long = r.long and l.lat = r.lat),
o as (select r.source from l left join {COORDS} r on l.fid = r.fid and l.iid = r.iid and l.long = r.long and l.lat = r.lat)
select source, count(*) n from (select source from i where (select count(*) from i) >= 5 union all select source from o where (select count(*) from i) < 5) group by 1""",
    "ids_semi": f"select iid, source from {COORDS} where cast(iid as varchar) in (select iid from splits where iid is not null)",
    "ids_anti": f"select iid, source from {COORDS} c where not exists (select 1 from splits s where s.iid = cast(c.iid as varchar))",
    "places_in_box": f"select distinct iid, long, lat from {COORDS} where long between -10 and 30 and lat between 35 and 60",
    "places_by_source": f"select source, count(*) n_placed from {COORDS} where {_PLACED} group by 1",
    "frequent_sources": f"select iid, source from {COORDS} where source in (select source from {COORDS} group by 1 having count(*) >= 60)",
    "split_labels": "with s as (select case lower(trim(split)) when 'training' then 'train' when 'validation' then 'val' when 'valid' then 'val' else lower(trim(split)) end split from splits) select split, count(*) n, round(count(*) / (select count(*) from s), 6) share from s group by 1",
    "label_lookup": "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "ratio_and_denormalise": f"""with r as (select distinct iid, bio2, bio7 from {COORDS} where {ok('bio2')} and {ok('bio7')}), m as (select avg(bio2) m, stddev_samp(bio2) s from r),
z as (select distinct iid, bio2 z from {NORMALIZED} where {ok('bio2')}) select r.iid, round(bio2 / nullif(bio7, 0), 6) ratio, round(z * s + m, 6) denormalised from r join z using (iid), m""",
    "names_parsed": " union all ".join(
        f"select load_no, '{i}' \"number\", round(avg({val(f'bio{i}')}), 6) mean, count({val(f'bio{i}')}) n from {FIXED} group by load_no" for i in range(1, 20)
    ),
    "row_means": f"select iid, load_no, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 6) mean from (select iid, load_no, {val('bio8')} a, {val('bio9')} b, {val('bio10')} c from {FIXED})",
    **{f"scale_{m}": _scale_sql(m) for m in _SCALE},
    "scale_train_apply": f"with v as (select iid, load_no, {val('bio1')} bio1, {val('bio5')} bio5 from {COMBINED}), a as (select avg(bio1) m1, stddev_pop(bio1) s1, avg(bio5) m5, stddev_pop(bio5) s5 from v where load_no = 1) select iid, load_no, round((bio1 - m1) / s1, 6) + 0.0 bio1, round((bio5 - m5) / s5, 6) + 0.0 bio5 from v, a",
    "combine_correlated": f"""with v as (select iid, {val('bio6')} a, {val('bio11')} b from {COORDS}), s as (select avg(a) ma, stddev_samp(a) sa, avg(b) mb, stddev_samp(b) sb from v)
select iid, round((coalesce((a - ma) / sa, 0) + coalesce((b - mb) / sb, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 6) + 0.0 bio_11_6 from v, s""",
    "corr_pairs": f"with {_corr_sql()} select a, b, round(r, 6) + 0.0 r from r",
    "corr_components": f"{_COMPONENTS} select c.node, c.component, z.size from c join (select component, count(*) size from c group by 1 having count(*) > 1) z using (component)",
    "corr_representatives": f"""{_COMPONENTS}, k as (select a node, q from e union all select b, q from e), d as (select c.component, c.node, round(z.size - 1 - coalesce(sum(1 - k.q), 0), 6) distance, z.size
 from c join (select component, count(*) size from c group by 1) z using (component) left join k on k.node = c.node group by c.component, c.node, z.size)
select component, node, distance, size from (select *, row_number() over (partition by component order by distance, node) r from d) where r = 1""",
    "partitions_compared": f"""with a as (select distinct members from (select fid, string_agg(distinct cast(iid as varchar), ',' order by cast(iid as varchar)) members from {COORDS} where iid is not null group by fid)),
b as (select distinct members from (select fid, string_agg(distinct cast(iid as varchar), ',' order by cast(iid as varchar)) members from {NORMALIZED} where iid is not null group by fid))
select case when a.members is null then 'right' when b.members is null then 'left' else 'both' end side, count(*) n, min(coalesce(a.members, b.members)) first_set from a full join b on a.members = b.members group by 1""",
    "average_ranks": f"""with v as (select load_no, iid, {val('bio1')} x from {COMBINED}), k as (select *, {_RANK.format(p='load_no', o='x', v='x')} r from v where x is not null)
select load_no, iid, x bio1, r "rank" from k union all select load_no, iid, null, null from v where x is null""",
    "prediction_metrics": f"""with v as (select source, {val('bio11')} y, {val('bio6')} p from {COORDS} where source is not null), c as (select *, {_RANK.format(p='source', o='y', v='y')} ry, {_RANK.format(p='source', o='p', v='p')} rp from v where y is not null and p is not null)
select source, count(*) n, round(avg((y - p) * (y - p)), 6) mse, round(avg(abs(y - p)), 6) mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) r2, round(corr(y, p) * corr(y, p), 6) r2_cor, round(corr(ry, rp), 6) spearman from c group by 1""",
    "score_summary": f"""with v as (select variable, zscore v, row_number() over (partition by variable order by zscore desc) r from gradient_peaks_summary where {ok('zscore')})
select variable, count(*) n, round(avg(v), 9) mean, round(stddev_samp(v) / sqrt(count(*)), 9) sem, round(median(v), 9) median, round(avg(case when r <= 5 then v end), 9) mean_top from v group by 1""",
    "quantiles_by_load": f"select load_no, round(quantile_cont(x, 0.05), 6) q_0, round(quantile_cont(x, 0.5), 6) q_1, round(quantile_cont(x, 0.95), 6) q_2 from (select load_no, {val('bio12')} x from {FIXED}) where x is not null group by 1",
    "histogram": f"""with v as (select least(cast(floor((bio1 + 3.0) / 0.25) as integer), 23) bin from {NORMALIZED} where {ok('bio1')} and bio1 between -3 and 3), c as (select bin, count(*) n from v group by 1)
select bin, round(n / (sum(n) over ()) / 0.25, 6) density, round((sum(n) over (order by bin)) / (sum(n) over ()), 6) cdf from c""",
    "area_changes": f"with a as (select load_no, avg({val('bio12')}) x from {FIXED} group by 1) select load_no, round(coalesce((x - lag(x) over (order by load_no)) / lag(x) over (order by load_no), x), 6) change from a",
    "explained_count": "with c as (select variable, count(*) n from gradient_peaks_summary group by 1), s as (select row_number() over (order by variable) r, (sum(n) over (order by variable)) / (sum(n) over ()) share from c) select cast(min(r) as integer) k from s where share >= 0.8",
    "median_neighbours": "select c_custkey, c_acctbal, round(abs(c_acctbal - (select median(c_acctbal) from customer)), 6) distance from customer order by abs(c_acctbal - (select median(c_acctbal) from customer)), c_custkey limit 10",
    "extreme_climates": f"with v as (select distinct iid, bio1 from {NORMALIZED} where {ok('bio1')}) (select iid, bio1, 'bottom' side from v order by bio1, iid limit 10) union all (select iid, bio1, 'top' from v order by bio1 desc, iid desc limit 10)",
    "consensus_extremes": f"""with v as (select distinct iid, bio1, bio5, bio_11_6 from {NORMALIZED} where {ok('bio1')} and {ok('bio5')} and {ok('bio_11_6')}),
m as (select iid, round(({_RANK.format(p='1', o='bio1', v='bio1')} + {_RANK.format(p='1', o='bio5', v='bio5')} + {_RANK.format(p='1', o='bio_11_6', v='bio_11_6')}) / 3.0, 4) mean_rank from v)
(select iid, mean_rank, 'bottom' side from m order by mean_rank, iid limit 10) union all (select iid, mean_rank, 'top' from m order by mean_rank desc, iid desc limit 10)""",
    "win_tie_loss": f"with {_SCORES} select a.variable a, b.variable b, count(case when a.score > b.score then 1 end) wins, count(case when a.score = b.score then 1 end) ties, count(case when a.score < b.score then 1 end) losses, round(avg(a.score - b.score), 9) mean_diff from s a join s b on a.block = b.block and a.variable < b.variable where a.score is not null and b.score is not null group by 1, 2",
    "friedman_ranks": f"""with {_SCORES}, k as (select count(distinct variable) k from s where score is not null), w as (select * from s where score is not null and block in (select block from s where score is not null group by 1 having count(*) = (select k from k))),
r as (select *, {_RANK.format(p='block', o='score desc', v='score')} rk from w), m as (select variable, count(*) n, avg(rk) mr, sum(rk * rk) sq from r group by 1), z as (select max(n) n, count(*) k, sum(sq) sq, sum((mr - (select (k + 1) / 2.0 from k)) * (mr - (select (k + 1) / 2.0 from k))) d from m)
select variable, m.n n_blocks, round(mr, 6) mean_rank, round(z.n * (z.k - 1) * z.n * z.d / (z.sq - z.n * z.k * (z.k + 1) * (z.k + 1) / 4.0), 6) chi2 from m, z""",
    "wilcoxon_by_source": f"""with v as (select source, round(round({val('bio10')}, 2) - round({val('bio5')} - 7.5, 2), 2) d from {COORDS} where source is not null), k as (select source, d, {_RANK.format(p='source', o='abs(d)', v='abs(d)')} r from v where d <> 0),
t as (select source, sum(n * n * n - n) t from (select source, abs(d) m, cast(count(*) as double) n from k group by 1, 2) group by 1),
s as (select source, count(*) n, sum(case when d > 0 then r else 0 end) w_plus, sum(case when d < 0 then r else 0 end) w_minus from k group by 1)
select source, n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - t / 48), 6) z from s join t using (source)""",
    "id_sets": f"""with a as (select distinct iid from {COORDS} where iid is not null), b as (select distinct iid from {NORMALIZED} where iid is not null)
select 'union' part, count(*) n, min(iid) first_iid from (select * from a union select * from b) union all select 'both', count(*), min(iid) from (select * from a intersect select * from b)
union all select 'only_raw', count(*), min(iid) from (select * from a except select * from b) union all select 'only_normalized', count(*), min(iid) from (select * from b except select * from a)""",
    "loads_appended": f"select '{FIXED}' src, load_no, count(*) n, cast(0 as bigint) n_combined, count(bio6) n_raw from {FIXED} group by 2 union all select '{COMBINED}', load_no, count(*), count(bio_11_6), cast(0 as bigint) from {COMBINED} group by 2",
    "pivoted_languages": "select variable, " + ", ".join(
        f"count(case when lower(lang) = '{c}' then 1 end) n_{c}" for c in ("en", "de", "es", "fr")
    ) + " from documents group by 1",
    "source_counts": f"select source, count(*) n from {COORDS} group by 1",
    "global_range": f"select min(x) low, max(x) high, count(distinct x) n_distinct, count(x) n from (select {val('bio12')} x from {FIXED})",
    "repeated_rows": "select snp_index, cast(sum(size) as bigint) n from variant_overlap_summary where size > 0 group by 1",
    "loads_majority": _SUPPORT + "5",
    "loads_all": _SUPPORT + "8",
    "loads_any": _SUPPORT + "1",
    "shuffled_order": f"select iid, row_number() over (order by md5(cast(iid as varchar) || ':7'), iid) - 1 place from (select distinct iid from {NORMALIZED} where iid is not null)",
    "listed_order": f"select s.source, p.south from (select distinct source from {COORDS} where source is not null) s left join (select source, min(lat) south from {COORDS} where {_PLACED} group by 1) p on s.source = p.source",
}
ORACLES["partitions_compared_all"] = ORACLES["partitions_compared"]
ORACLES["corr_distances"] = f"with {_corr_sql()} select a, b, round(sqrt(2 * (1 - least(abs(r), 1))), 6) distance from r"
