"""Packed fields (problem 3) and the column profile (problem 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.operators import packed
from terrasieve.operators import profile as prof
from terrasieve.operators.clean import value_columns
from terrasieve.queries import table

#: table -> (columns, valid range, largest shift of the median), as the data's description fixes them
PROFILED = {
    "coords_with_bioclim_30s_fixed": (["bio6", "bio11"], (-90.0, 60.0), 4.0),
    "combined_variables_dataset": (["bio_11_6"], (-10.0, 10.0), 0.6),
}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack_variants(table(spark, d, "variant_overlap_summary"))


def p3_value_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each value occurs in each packed field."""
    return p3_found(spark, d).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"), F.min("item_no").alias("first_place"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many values each packed field gives, which its row states as well."""
    return p3_found(spark, d).groupBy("variant_id", "field").agg(F.count(F.lit(1)).alias("n"))


def _stated(spark: SparkSession, d: str, names: Sequence[str] = tuple(PROFILED)) -> dict:
    """The columns that the data's description states issues for, with their valid ranges."""
    return {t: (table(spark, d, t), PROFILED[t][0], {c: PROFILED[t][1] for c in PROFILED[t][0]}) for t in names}


def _shifts() -> dict[str, float]:
    return {c: shift for columns, _, shift in PROFILED.values() for c in columns}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    issues = prof.load_issues(prof.profile_tables(_stated(spark, d), "load_no"), max_shift=_shifts())
    return issues.select("tbl", "col", F.col("load_no").cast("int").alias("load_no"), "issue")


def sound_loads(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Rows of a profiled table whose load has no issue of problem 6 in any stated column; rows of no load count as one load."""
    df = table(spark, d, name)
    issues = prof.load_issues(prof.profile_tables(_stated(spark, d, [name]), "load_no"), max_shift=_shifts())
    bad = [r[0] for r in issues.select("load_no").distinct().collect()]  # at most one row a load
    for load in bad:
        df = df.filter(~F.col("load_no").eqNullSafe(F.lit(load)))
    return df


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every numeric column of both tables, with the valid ranges that are stated, and whether its distribution changed."""
    parts = _stated(spark, d)
    every = {
        t: (df, value_columns(df, exclude=("fid", "iid", "load_no")), valid) for t, (df, _, valid) in parts.items()
    }
    out = prof.profile_tables(every, "load_no").withColumn("changed", prof.told_apart())
    return out.select(*[c for c in out.columns if not c.startswith("ref_")])


def p6_base(spark: SparkSession, d: str) -> DataFrame:
    """The exact aggregates alone, which SQL can check."""
    out = prof.profile_tables(_stated(spark, d), "load_no", classify=False)
    return out.select(
        "tbl",
        "col",
        "load_no",
        "n_rows",
        "n_missing",
        "n_distinct",
        "min_value",
        "max_value",
        "n_violations",
        F.round("median", 6).alias("median"),
        F.round("iqr", 6).alias("iqr"),
        F.round("top_share", 9).alias("top_share"),
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_value_frequency": p3_value_frequency,
    "p3_counts": p3_counts,
    "p6_found": p6_found,
    "p6_profile": p6_profile,
    "p6_base": p6_base,
}

_VALUES = " union all ".join(
    f"select '{t}' tbl, '{c}' col, load_no, case when {c} is null or isnan({c}) or {c} <= -1e30 then null else {c} end x, {lo} lo, {hi} hi, {shift} shift from {t}"
    for t, (columns, (lo, hi), shift) in PROFILED.items()
    for c in columns
)
_TOP = "select tbl, col, load_no, max(n) top from (select tbl, col, load_no, x, count(*) n from v where x is not null group by all) group by all"
_BASE = f"""with v as ({_VALUES}), t as ({_TOP}),
b as (select v.tbl, v.col, v.load_no, count(*) n_rows, count(*) - count(x) n_missing, count(distinct x) n_distinct, min(x) min_value, max(x) max_value,
 count(case when x < lo or x > hi then 1 end) n_violations, median(x) median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) iqr, coalesce(max(t.top) / count(x), 0) top_share, max(shift) shift
 from v left join t on v.tbl = t.tbl and v.col = t.col and v.load_no = t.load_no group by v.tbl, v.col, v.load_no)"""

ORACLES = {
    "p3_counts": " union all ".join(
        f"select distinct variant_id, '{c}' field, cast({n} as bigint) n from variant_overlap_summary where variant_id is not null and regexp_matches({c}, '[\\pL\\pN]')"
        for c, n in (("positions", "size"), ("alt_bases", "size"), ("accession_ids", "least(n_accessions, 50)"))
    ),
    "p6_base": f"{_BASE} select tbl, col, load_no, n_rows, n_missing, n_distinct, min_value, max_value, n_violations, round(median, 6) median, round(iqr, 6) iqr, round(top_share, 9) top_share from b",
    "p6_found": f"""{_BASE}, r as (select b.*, ref.median ref_median, ref.iqr ref_iqr from b left join b ref on ref.tbl = b.tbl and ref.col = b.col and ref.load_no = 1)
select tbl, col, load_no, 'missing' issue from r where n_missing > 0.10 * n_rows
union all select tbl, col, load_no, 'impossible' from r where n_violations > 0
union all select tbl, col, load_no, 'shifted' from r where abs(median - ref_median) > shift
union all select tbl, col, load_no, 'rescaled' from r where iqr > 1.6 * ref_iqr or iqr < 0.45 * ref_iqr
union all select tbl, col, load_no, 'stuck' from r where top_share > 0.18""",
}
