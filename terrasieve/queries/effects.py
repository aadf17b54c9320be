"""Mutation effects, shared variants, embeddings and linear models.

Effects are made from the order lines: a supplier stands for an accession, a part for a site, and the price times
the distance of its discount from 0.05 for the change of a prediction. Embeddings and models use their own tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions.values import present
from terrasieve.operators import clean, effects, graph, models, packed, peaks, rank, vectors
from terrasieve.plans.scratch import Scratch
from terrasieve.queries import table
from terrasieve.queries.quality import sound_loads
from terrasieve.sources import tables, text

COORDS, COMBINED = "coords_with_bioclim", "combined_variables_dataset"
TIES = ["site", "position", "line"]
FEATURES = ["bio1", "bio2", "bio5", "bio8", "bio9", "bio15"]
TARGETS = ["bio_11_6", "bio_10_5"]


def mutations(spark: SparkSession, d: str) -> DataFrame:
    """(accession, site, position, line, kind, delta); delta in whole ten-thousandths, so that sums are exact."""
    rows = table(spark, d, "lineitem")
    delta = F.round(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) * 100).cast("long") / 100.0
    return rows.select(
        F.col("l_suppkey").alias("accession"),
        F.col("l_partkey").alias("site"),
        F.col("l_orderkey").alias("position"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "combo").otherwise("single").alias("kind"),
        delta.alias("delta"),
    )


def best_mutation(spark: SparkSession, d: str) -> DataFrame:
    return rank.best_effect(mutations(spark, d), ["accession"], "delta", TIES)


def best_negative_mutation(spark: SparkSession, d: str) -> DataFrame:
    return rank.best_effect(mutations(spark, d), ["accession"], "delta", TIES, "negative")


def direction_split(spark: SparkSession, d: str) -> DataFrame:
    """Best mutations of every accession and site, split by whether they have the wanted sign."""
    best = rank.best_effect(mutations(spark, d), ["accession", "site"], "delta", TIES, "negative", compat=True)
    wanted, other = rank.split_by_direction(best, "delta", "negative")
    n = lambda df, name: df.groupBy("accession").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
    return n(wanted, "wanted").unionByName(n(other, "other"))


def cumulative_effects(spark: SparkSession, d: str) -> DataFrame:
    out = effects.cumulative_effects(mutations(spark, d), "accession", "site", "delta", TIES)
    return out.select(
        "accession",
        "site",
        "position",
        "line",
        "delta",
        "step",
        F.round("cumulative_delta", 2).alias("cumulative_delta"),
    )


def cumulative_scenarios(spark: SparkSession, d: str) -> DataFrame:
    steps = effects.cumulative_effects(mutations(spark, d), "accession", "site", "delta", TIES)
    every = table(spark, d, "supplier").select(F.col("s_suppkey").alias("accession"), F.col("s_acctbal").alias("baseline"))
    out = effects.scenarios(steps, every, "accession", "delta", [1, 3, 10, 0], "baseline")
    return out.select(
        "top_n",
        "accession",
        *[F.round(c, 2).alias(c) for c in ("baseline_pred", "final_pred", "cumulative_delta")],
        "n_steps",
    )


def prediction_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Scenario predictions in the units of each nation's balance."""
    steps = cumulative_scenarios(spark, d).join(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("accession"), F.col("s_nationkey").alias("variable")),
        "accession",
    )
    stats = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("variable")).agg(
        F.avg("c_acctbal").alias("mean"),
        F.stddev_samp("c_acctbal").alias("std"),
    )
    out = effects.trajectory(steps, stats, "variable")
    return out.select(
        "accession",
        "top_n",
        F.round("final_pred", 2).alias("final_pred"),
        F.round("cumulative_delta", 2).alias("cumulative_delta"),
    )


def accession_intermediates(spark: SparkSession, d: str) -> DataFrame:
    """The scenarios stored by N, and what the index says of them."""
    path = f"{Scratch(spark, 'intermediates').root}/rows"
    effects.write_intermediates(cumulative_scenarios(spark, d), path)
    return effects.intermediates_index(spark.read.parquet(path), "accession")


def sites_over_runs(spark: SparkSession, d: str) -> DataFrame:
    out = effects.shared_sites(mutations(spark, d), "accession", "site", "delta", TIES, [1, 3, 10])
    return out.withColumn("mean_delta", F.round("mean_delta", 6))


def model_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A model of the pooled vectors stored and read again with its columns checked."""
    path = f"{Scratch(spark, 'model').root}/model"
    pooled = vectors.pooled(table(spark, d, "embeddings"), ["label"], "embedding", "mean")
    model = pooled.select(F.col("label").cast("string").alias("target"), F.lit(0.1).alias("alpha"), F.col("embedding").alias("coefs"), F.lit(0.0).alias("intercept"))
    vectors.write_model(model, path)
    rows = vectors.read_model(spark, path).select("target", F.posexplode("coefs").alias("dim", "v"))
    return rows.select("target", "dim", F.round("v", 6).alias("v"))


def zipped_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers beside their balances, by position."""
    rows = table(spark, d, "supplier")
    ids, values = rows.select("s_suppkey"), rows.select("s_acctbal", F.col("s_suppkey").alias("__order"))
    return vectors.zipped(ids, values, [F.col("s_suppkey")], [F.col("__order")]).drop("__order")


def variant_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").count()  # the accessions there are, also those without any variant
    out = effects.variant_overlap(mutations(spark, d), ["site", "kind"], "accession", "delta", n)
    return out.select(
        "site",
        "kind",
        "n_accessions",
        F.round("accession_fraction", 6).alias("accession_fraction"),
        "accession_ids",
        *[F.round(c, 9).alias(c) for c in ("mean_delta", "median_delta", "max_delta", "min_delta")],
    )


def site_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "variant_overlap_summary").select(
        "snp_index",
        "variant_type",
        F.coalesce("positions", F.lit("")).alias("variant"),
        "n_accessions",
        "mean_delta",
    ).dropDuplicates()
    return effects.site_overlap(rows, "snp_index", "variant_type", "variant")


def effect_magnitude(spark: SparkSession, d: str) -> DataFrame:
    out = effects.effect_magnitude(mutations(spark, d), ["accession"], "delta", "site")
    return out.select(
        "accession",
        "n",
        F.round("mean_size", 9).alias("mean_size"),
        F.round("median_size", 9).alias("median_size"),
        "largest_key",
        "largest",
    )


def shared_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Accessions by the variants whose packed lists name them: how many, with statistics of their effects."""
    variants = table(spark, d, "variant_overlap_summary").dropDuplicates(["variant_id"])
    items = packed.unpack_variants(variants).filter("field = 'accession_ids'").select("variant_id", "item")
    rows = items.join(variants.select("variant_id", "mean_delta"), "variant_id")
    return effects.common_items(rows, "item", "variant_id", "mean_delta", ["variant_id"])


def common_sites(spark: SparkSession, d: str) -> DataFrame:
    out = effects.common_items(mutations(spark, d), "site", "accession", "delta", ["accession", "position", "line", "delta"])
    return out.select(
        "site",
        "n_units",
        "n",
        F.round("mean", 9).alias("mean"),
        F.round("std", 4).alias("std"),
        "low",
        "high",
        "first_unit",
    )


def position_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Positions by how many variants have them in their packed lists."""
    items = packed.unpack_variants(table(spark, d, "variant_overlap_summary")).filter("field = 'positions'")
    return items.groupBy("item").agg(F.count_distinct("variant_id").alias("n_variants"), F.count(F.lit(1)).alias("n"))


def listed_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each site's positions in one field again, cut at fifty."""
    rows = table(spark, d, "gradient_peaks_summary").filter(
        "max_grad_pos is not null and chromosome is not null"
    ).select("snp_index", "max_grad_pos").dropDuplicates()
    lists = rank.first_rows(rows, ["snp_index"], [F.col("max_grad_pos")], 51).groupBy("snp_index").agg(
        F.array_sort(F.collect_list("max_grad_pos")).alias("ps")
    )
    return lists.select("snp_index", effects.joined_list(F.transform("ps", lambda p: p.cast("string"))).alias("positions"))


def item_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("item"))
    return graph.cooccurrence(rows, ["l_orderkey"], "item")


def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best match of every supplier; novel are those that have none."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("query"),
        F.col("l_partkey").alias("target"),
        F.col("l_tax").alias("p"),
        F.round(F.col("l_discount") * F.col("l_quantity"), 4).alias("q"),
    ).filter("q > 0")
    every = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"))
    return graph.best_matches(rows, "query", "target", "p", "q", 0.015, every).select(
        "query",
        F.coalesce("target", F.lit(-1)).alias("target"),
        "status",
    )


def series_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Every load of a variable beside the next one on their common accessions."""
    rows = clean.complete_rows(table(spark, d, COMBINED), ["bio1"]).filter("iid is not null")
    series = rows.groupBy("load_no", "iid").agg(F.min("bio1").alias("v"))
    following = series.withColumn("load_no", F.col("load_no") - 1)
    return peaks.series_overlay(series, following, ["load_no", "iid"], "v").groupBy("load_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(F.col("left") - F.col("right"))), 6).alias("mean_gap"),
    )


def pool_max(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.pooled(table(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", F.posexplode("embedding").alias("dim", "v")).select(
        "label",
        "dim",
        F.col("v").cast("double").alias("v"),
    )


def pool_mean(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.pooled(table(spark, d, "embeddings"), ["label"], "embedding", "mean")
    return out.select("label", F.posexplode("embedding").alias("dim", "v")).select("label", "dim", F.round("v", 6).alias("v"))


def strand_averages(spark: SparkSession, d: str) -> DataFrame:
    """Each vector averaged with the flipped next one, as the two strands of a region are."""
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    out = a.join(b, "vec_id").select(
        "vec_id",
        F.posexplode(vectors.strand_average(F.col("embedding"), F.col("other"))).alias("dim", "v"),
    )
    return out.select("vec_id", "dim", F.round("v", 6).alias("v"))


def flattened_regions(spark: SparkSession, d: str) -> DataFrame:
    """Every label's vectors joined in order, and the place of each feature."""
    out = vectors.flattened(
        table(spark, d, "embeddings"),
        ["label"],
        "vec_id",
        "embedding",
    ).select("label", F.posexplode("embedding").alias("i", "v"))
    region, dim = vectors.feature_place(F.col("i"), 64)
    return out.groupBy("label", region.alias("region")).agg(
        F.round(F.sum(F.col("v").cast("double") * (dim + 1)), 4).alias("checksum")
    )


def _weights() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 7 - 3) / F.lit(10.0))


def linear_predictions(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.linear_prediction(table(spark, d, "embeddings"), "embedding", _weights(), 1.5)
    return out.select("vec_id", F.round("prediction", 6).alias("prediction"))


def mutation_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change of a linear prediction when a vector is replaced by the one two places on."""
    base = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("accession"),
        F.lit(0).alias("snp_index"),
        F.col("embedding").alias("old_row"),
    )
    mutated = table(spark, d, "embeddings").select(
        (F.col("vec_id") - 2).alias("accession"),
        F.lit(0).alias("snp_index"),
        F.col("embedding").alias("new_row"),
    )
    coefs = spark.range(1).select(
        F.lit("v").alias("variable"),
        F.posexplode(_weights()).alias("feature_index", "coef"),
        F.lit(2.0).alias("scale"),
    )
    weights = effects.coefficient_rows(coefs, 64)
    return effects.mutation_deltas(mutated, base, weights).select("accession", "variable", F.round("delta", 6).alias("delta"))


def explained_weights(spark: SparkSession, d: str) -> DataFrame:
    """A coefficient vector per label taken apart into region and dimension."""
    model = vectors.pooled(table(spark, d, "embeddings"), ["label"], "embedding").select(
        F.col("label").cast("string").alias("variable"),
        F.col("embedding").alias("coefs"),
    )
    return vectors.explained_coefficients(model, "coefs", 16)


def component_shares(spark: SparkSession, d: str) -> DataFrame:
    return vectors.principal_components(table(spark, d, "embeddings"), "embedding", 8).select(
        "component",
        F.round("share", 6).alias("share"),
    )


def reduced_regions(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.truncated_svd(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 4)
    return out.select(
        "label",
        F.size("reduced").alias("n"),
        F.round(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"),
    )


def _training(spark: SparkSession, d: str) -> DataFrame:
    return sound_loads(spark, d, COMBINED).withColumn("fold", F.pmod(F.xxhash64("iid"), F.lit(5)))


def elastic_net(spark: SparkSession, d: str) -> DataFrame:
    out = models.elastic_net(_training(spark, d), FEATURES, TARGETS, fold="fold")
    return out.select(
        "target",
        "alpha",
        "cv_mse",
        F.array_join(F.transform("coefs", lambda c: F.round(c, 6).cast("string")), ";").alias("coefs"),
        "intercept",
        "n",
    )


def elastic_net_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out agreement of models fitted on all sound loads but the last."""
    from terrasieve.operators.stats import prediction_metrics

    rows = _training(spark, d)
    held = F.col("load_no").eqNullSafe(F.lit(rows.agg(F.max("load_no")).first()[0]))
    fitted = models.elastic_net(rows.filter(~held), FEATURES, TARGETS, fold="fold")
    rows = rows.withColumn("row_no", F.xxhash64(*rows.columns))
    scored = models.model_predictions(
        rows,
        fitted,
        FEATURES,
        ["row_no", "load_no"],
        fit_on=~held,
    ).filter(held).dropDuplicates()
    truth = rows.filter(held).select("row_no", *TARGETS).dropDuplicates().unpivot(
        ["row_no"],
        TARGETS,
        "target",
        "observed",
    )
    return prediction_metrics(scored.join(truth, ["row_no", "target"]), ["target"], "observed", "prediction")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The environment table written as CSV, read with the types its header implies, and summed."""
    path = f"{Scratch(spark, 'csv').root}/coords"
    columns = ["fid", "iid", "long", "lat", "bio1", "bio12"]
    tables.write_table(table(spark, d, COORDS).select(*columns), path, "csv", force=True)
    back = tables.read_environment(spark, path)
    return back.groupBy((F.col("iid") % 10).alias("digit")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(present("bio12")), 2).alias("rain"),
        F.count(present("bio1")).alias("n_bio1"),
    )


def phenotype_files(spark: SparkSession, d: str) -> DataFrame:
    """Phenotype files rewritten with each accession's value, read back."""
    path = f"{Scratch(spark, 'fam').root}/fam"
    rows = table(spark, d, COORDS).filter("iid is not null").select("iid").dropDuplicates()
    fam = rows.select(
        *[F.col("iid").cast("string").alias(c) for c in ("fid", "iid")],
        *[F.lit("0").alias(c) for c in ("father", "mother", "sex", "phenotype")],
    )
    values = clean.complete_rows(
        table(spark, d, COORDS),
        ["bio1"],
    ).select("iid", "bio1").groupBy("iid").agg(F.max("bio1").alias("value"))
    tables.phenotype_lines(fam, values).write.mode("overwrite").text(path)
    return text.read_fam(spark, path).select("iid", "phenotype")


def site_names(spark: SparkSession, d: str) -> DataFrame:
    bim = table(spark, d, "gradient_peaks_summary").select(
        F.col("chromosome").alias("chrom"),
        F.col("abs_max_pos").alias("pos"),
    ).dropna().dropDuplicates()
    return tables.rename_sites(bim).select("chrom", "pos", "id")


QUERIES = {
    f.__name__: f
    for f in (
        best_mutation, best_negative_mutation, direction_split, cumulative_effects, cumulative_scenarios, prediction_trajectories, variant_overlap, site_overlap, effect_magnitude, shared_accessions,
        common_sites, position_frequency, listed_positions, item_cooccurrence, best_matches, series_overlay, pool_max, pool_mean, strand_averages, flattened_regions, linear_predictions,
        mutation_deltas, explained_weights, component_shares, reduced_regions, elastic_net, elastic_net_scores, csv_round_trip, phenotype_files, site_names, accession_intermediates, sites_over_runs, model_round_trip, zipped_predictions,
    )
} | {"direction_split_all": direction_split, "best_matches_all": best_matches}

_M = """m as (select l_suppkey accession, l_partkey site, l_orderkey "position", l_linenumber line, case when l_returnflag = 'R' then 'combo' else 'single' end kind,
 cast(round(l_extendedprice * (l_discount - 0.05) * 100) as bigint) / 100.0 delta from lineitem)"""
_STEPS = f"""{_M}, b as (select * from (select *, row_number() over (partition by accession, site order by delta desc, site, "position", line) r from m where delta > 0) where r = 1),
st as (select accession, site, "position", line, delta, row_number() over w step, sum(delta) over w cumulative_delta from b window w as (partition by accession order by delta desc, site, "position", line))"""
_SCEN = f"""{_STEPS}, sc as (select n top_n, s_suppkey accession, s_acctbal baseline, coalesce(sum(delta), 0) cumulative_delta, count(step) n_steps from supplier cross join (values (1), (3), (10), (0)) t(n)
 left join st on st.accession = s_suppkey and (n = 0 or step <= n) group by 1, 2, 3)"""
_E = "e as (select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) dim, cast(unnest(embedding) as double) v from embeddings)"
_WT = "((dim % 7 - 3) / 10.0)"
_BEST = """select accession, site, "position", line, kind, delta from (select *, row_number() over (partition by accession order by delta {o}, site, "position", line) r from m) where r = 1"""

ORACLES = {
    "best_mutation": f"with {_M} {_BEST.format(o='desc')}",
    "best_negative_mutation": f"with {_M} {_BEST.format(o='asc')}",
    "direction_split": f"""with {_M}, b as (select * from (select *, row_number() over (partition by accession, site order by delta desc, site, "position", line) r from m) where r = 1)
select accession, count(*) n, case when delta < 0 then 'wanted' else 'other' end part from b group by 1, 3""",
    "cumulative_effects": f"with {_STEPS} select accession, site, \"position\", line, delta, cast(step as integer) step, round(cumulative_delta, 2) cumulative_delta from st",
    "cumulative_scenarios": f"with {_SCEN} select cast(top_n as integer) top_n, accession, round(baseline, 2) baseline_pred, round(baseline + cumulative_delta, 2) final_pred, round(cumulative_delta, 2) cumulative_delta, n_steps from sc",
    "prediction_trajectories": f"""with {_SCEN}, s as (select c_nationkey k, avg(c_acctbal) mean, stddev_samp(c_acctbal) std from customer group by 1)
select accession, cast(top_n as integer) top_n, round(round(baseline + cumulative_delta, 2) * std + mean, 2) final_pred, round(round(cumulative_delta, 2) * std, 2) cumulative_delta from sc join supplier on accession = s_suppkey join s on k = s_nationkey""",
    "variant_overlap": f"""with {_M}, i as (select site, kind, cast(accession as varchar) a, row_number() over (partition by site, kind order by accession) r from (select distinct site, kind, accession from m)),
j as (select site, kind, string_agg(a, ';' order by a) filter (where r <= 51) ids, count(*) n from i group by 1, 2)
select site, kind, count(*) n_accessions, round(count(*) / (select count(*) from supplier), 6) accession_fraction, any_value(ids) accession_ids, round(avg(delta), 9) mean_delta, round(median(delta), 9) median_delta, round(max(delta), 9) max_delta, round(min(delta), 9) min_delta from m join j using (site, kind) group by 1, 2""",
    "site_overlap": """with v as (select distinct snp_index, variant_type, coalesce(positions, '') variant, n_accessions, mean_delta from variant_overlap_summary),
t as (select * from (select *, row_number() over (partition by snp_index, variant_type order by n_accessions desc, mean_delta desc, variant) r from v) where r = 1)
select v.snp_index, count(case when v.variant_type = 'single' then 1 end) n_distinct_single, count(case when v.variant_type = 'combo' then 1 end) n_distinct_combo,
 coalesce(any_value(s.variant), '') top_single, coalesce(any_value(s.n_accessions), 0) top_single_count, coalesce(any_value(c.variant), '') top_combo, coalesce(any_value(c.n_accessions), 0) top_combo_count
from v left join t s on s.snp_index = v.snp_index and s.variant_type = 'single' left join t c on c.snp_index = v.snp_index and c.variant_type = 'combo' group by 1""",
    "effect_magnitude": f"""with {_M}, t as (select accession, site, abs(delta) s, row_number() over (partition by accession order by abs(delta) desc, site) r from m)
select accession, count(*) n, round(avg(s), 9) mean_size, round(median(s), 9) median_size, max(case when r = 1 then site end) largest_key, max(s) largest from t group by 1""",
    "common_sites": f"""with {_M}, f as (select site, accession, row_number() over (partition by site order by accession) r from m)
select m.site, count(distinct m.accession) n_units, count(*) n, round(avg(delta), 9) mean, round(stddev_samp(delta), 4) std, min(delta) low, max(delta) high, any_value(f.accession) first_unit from m join f on f.site = m.site and r = 1 group by 1""",
    "listed_positions": """with p as (select distinct snp_index, max_grad_pos p from gradient_peaks_summary where max_grad_pos is not null and chromosome is not null), r as (select *, row_number() over (partition by snp_index order by p) r, count(*) over (partition by snp_index) n from p)
select snp_index, string_agg(cast(p as varchar), ';' order by p) || case when max(n) > 50 then ';...' else '' end positions from r where r <= 50 group by 1""",
    "item_cooccurrence": """with i as (select distinct l_orderkey o, l_returnflag || l_linestatus i from lineitem) select x.i a, y.i b, count(*) n from i x join i y on x.o = y.o and x.i < y.i group by 1, 2""",
    "best_matches": """with l as (select l_suppkey query, l_partkey target, l_tax p, round(l_discount * l_quantity, 4) q from lineitem), b as (select *, row_number() over (partition by query order by q, p, target) r from l where q > 0)
select s_suppkey query, coalesce(target, -1) target, case when target is null then 'novel' when q < 0.015 then 'significant' else 'non' end status from supplier left join b on b.query = s_suppkey and r = 1""",
    "pool_max": f"with {_E} select label, dim, max(v) v from e group by 1, 2",
    "pool_mean": f"with {_E} select label, dim, round(avg(v), 6) + 0.0 v from e group by 1, 2",
    "strand_averages": f"with {_E} select a.vec_id, a.dim, round((a.v + b.v) / 2, 6) + 0.0 v from e a join e b on b.vec_id = a.vec_id + 1 and b.dim = 63 - a.dim",
    "flattened_regions": f"with {_E}, r as (select label, cast(dense_rank() over (partition by label order by vec_id) - 1 as integer) region, v * (dim + 1) c from e) select label, region, round(sum(c), 4) checksum from r group by 1, 2",
    "linear_predictions": f"with {_E} select vec_id, round(sum(v * {_WT}) + 1.5, 6) + 0.0 prediction from e group by 1",
    "mutation_deltas": f"with {_E} select a.vec_id accession, 'v' variable, round(sum((b.v - a.v) * {_WT.replace('dim', 'a.dim')} / 2), 6) + 0.0 delta from e a join e b on b.vec_id = a.vec_id + 2 and b.dim = a.dim group by 1",
    "explained_weights": f"with {_E}, m as (select label, dim, max(v) v from e group by 1, 2) select cast(label as varchar) variable, cast(dim // 16 as integer) snp_index, cast(dim % 16 as integer) embedding_dim, v weight from m",
    "csv_round_trip": "select iid % 10 digit, count(*) n, round(sum(case when bio12 is not null and not isnan(bio12) and bio12 > -1e30 then bio12 end), 2) rain, count(case when bio1 is not null and not isnan(bio1) and bio1 > -1e30 then 1 end) n_bio1 from coords_with_bioclim group by 1",
    "phenotype_files": "select cast(iid as varchar) iid, coalesce(max(case when bio1 is not null and not isnan(bio1) and bio1 > -1e30 then bio1 end), -9.0) phenotype from coords_with_bioclim where iid is not null group by iid",
    "site_names": "select distinct chromosome chrom, abs_max_pos pos, chromosome || '_' || abs_max_pos id from gradient_peaks_summary where chromosome is not null and abs_max_pos is not null",
}
ORACLES |= {
    "direction_split_all": ORACLES["direction_split"],
    "best_matches_all": ORACLES["best_matches"],
    "series_overlay": """with s as (select load_no, iid, min(bio1) v from combined_variables_dataset where iid is not null and bio1 is not null and not isnan(bio1) and bio1 > -1e30 group by 1, 2)
select a.load_no, count(*) n, round(avg(abs(a.v - b.v)), 6) mean_gap from s a join s b on b.load_no = a.load_no + 1 and a.iid = b.iid group by 1""",
}

ORACLES |= {
    "accession_intermediates": f"with {_SCEN} select cast(top_n as integer) top_n, count(distinct accession) n_accessions, count(case when n_steps > 0 then 1 end) n_changed, cast(sum(n_steps) as bigint) n_steps, min(accession) first, max(accession) last from sc group by 1",
    "sites_over_runs": f"""with {_M}, u as (select 'positive' direction, *, delta s from m where delta > 0 union all select 'negative', *, -delta from m where delta < 0),
b as (select * from (select *, row_number() over (partition by direction, accession, site order by s desc, site, "position", line) r from u) where r = 1),
st as (select *, row_number() over (partition by direction, accession order by s desc, site, "position", line) step from b)
select direction, cast(n as integer) top_n, site, count(distinct accession) n_accessions, round(avg(delta), 6) mean_delta from st, (values (1), (3), (10)) t(n) where step <= n group by 1, 2, 3""",
    "model_round_trip": f"with {_E} select cast(label as varchar) target, dim, round(avg(v), 6) + 0.0 v from e group by 1, 2",
    "zipped_predictions": "select s_suppkey, s_acctbal from supplier",
}
