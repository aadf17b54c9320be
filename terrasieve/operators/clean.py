"""Cleaning: which columns are values, what is missing, which rows and ids stay, and genotype quality.

Everything here is lazy column work or joins by key. Null keys match nothing; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasieve.functions.values import is_present, present

ID_COLUMNS = ("fid", "iid", "long", "lat")
#: Genotype that stands for a missing call.
MISSING_CALL = 3


def value_columns(
    df: DataFrame,
    exclude: Sequence[str] = ID_COLUMNS,
    exclude_suffix: Sequence[str] = ("_uncertainty",),
) -> list[str]:
    """The numeric columns that are neither identifiers nor carry an excluded suffix, in table order; names compare without case."""
    out = {e.lower() for e in exclude}
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name.lower() not in out and not f.name.lower().endswith(tuple(exclude_suffix))
    ]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, or a ValueError that names the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def null_no_data(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL for null, NaN and no-data marks in ``columns``."""
    return df.withColumns({c: present(F.col(f"`{c}`")) for c in columns})


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of ``columns`` is missing; the test is on the raw columns, so that scans can skip by it."""
    return df.filter(reduce(lambda a, b: a & b, [is_present(F.col(f"`{c}`")) for c in columns])) if columns else df


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``; keys compare as strings, as sources disagree on their type."""
    return df.join(_as_text(ids, key), F.col(f"`{key}`").cast("string") == F.col("__id"), "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids``; a null key is in no set and stays."""
    return df.join(_as_text(ids, key), F.col(f"`{key}`").cast("string") == F.col("__id"), "left_anti")


def _as_text(ids: DataFrame, key: str) -> DataFrame:
    return ids.select(F.col(f"`{key}`").cast("string").alias("__id")).dropna()


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows with (x, y) in the box (x0, x1, y0, y1), ends included; missing coordinates are outside."""
    x0, x1, y0, y1 = box
    return df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def with_place(df: DataFrame, x: str = "long", y: str = "lat", mark: float = -9.0) -> DataFrame:
    """Rows of which neither coordinate is the mark of a missing place; null and NaN count as missing too."""
    return df.filter(is_present(x) & is_present(y) & (F.col(x) != mark) & (F.col(y) != mark))


def without_metadata(df: DataFrame, position: str = "position") -> DataFrame:
    """Rows of positions from 0 on; lower ones mark rows that describe the table. Null positions go."""
    return df.filter(F.col(position) >= 0)


def plain_names(df: DataFrame, drop_suffix: str = "_uncertainty", suffix: str = "_soil") -> DataFrame:
    """Without columns of ``drop_suffix``; ``x<suffix>`` becomes ``x`` where there is no x."""
    kept = [c for c in df.columns if not c.endswith(drop_suffix)]
    return df.select(
        *[F.col(f"`{c}`").alias(c[: -len(suffix)] if c.endswith(suffix) and c[: -len(suffix)] not in kept else c) for c in kept]
    )


def merge_tables(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ID_COLUMNS,
    suffix: str = "_right",
    least: int = 0,
) -> DataFrame:
    """Inner join on exact keys; columns of the right table that clash get ``suffix``.

    With ``least`` > 0 a result of fewer rows falls back to a left join; this looks at no more than that many rows.
    """
    right = right.select(*[F.col(f"`{c}`").alias(c if c in keys or c not in left.columns else c + suffix) for c in right.columns])
    inner = left.join(right, list(keys))
    return left.join(right, list(keys), "left") if least and inner.limit(least).count() < least else inner


def relabel(c: Column, names: Mapping[str, str | None]) -> Column:
    """Renames values; a value mapped to None becomes NULL, one not in the mapping stays."""
    if not names:
        return c
    known = F.create_map(*[F.lit(v) for k in names for v in (k, names[k])])
    return F.when(F.array_contains(F.map_keys(known), c), known[c]).otherwise(c)


def frequent_classes(df: DataFrame, c: str, least: int) -> DataFrame:
    """Rows whose class occurs at least ``least`` times; rows without a class go. Counts are combined before the shuffle."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return df.join(counts.select(c), c, "left_semi")


def named_parts(df: DataFrame, ids: Sequence[str], pattern: str, parts: Sequence[str], value: str = "value") -> DataFrame:
    """Wide to long, with the groups of ``pattern`` read off the column names; columns that don't match are left out."""
    columns = [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), columns, "name", value).filter(F.col("name").rlike(pattern))
    return long.select(*ids, *[F.regexp_extract("name", pattern, i + 1).alias(p) for i, p in enumerate(parts)], value)


# Genotypes: one row per site, calls 0, 1, 2 or 3 (missing) in an array.


def genotype_arrays(calls: DataFrame, site: Sequence[str], sample: str, call: str) -> DataFrame:
    """One row per site with ``gt``, the calls in sample order. A site's samples are a bounded panel."""
    return calls.groupBy(*site).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(sample, call))), lambda s: s[call]).alias("gt")
    )


def missing_share(gt: Column) -> Column:
    return F.size(F.filter(gt, lambda x: x == MISSING_CALL)) / F.nullif(F.size(gt), F.lit(0))


def _is_call(k: int, x: Column) -> Column:
    return x == k


def mode_call(gt: Column) -> Column:
    """The most frequent call that isn't missing, the smallest on ties; NULL if all are missing."""
    n = [F.size(F.filter(gt, partial(_is_call, k))) for k in (0, 1, 2)]
    return F.when((n[0] >= n[1]) & (n[0] >= n[2]) & (n[0] > 0), 0).when((n[1] >= n[2]) & (n[1] > 0), 1).when(n[2] > 0, 2)


def impute_mode(gt: Column) -> Column:
    mode = mode_call(gt)
    return F.transform(gt, lambda x: F.when(x == MISSING_CALL, mode).otherwise(x))


def allele_frequency(gt: Column, folded: bool = False) -> Column:
    """Sum of calls over twice their number; ``folded`` gives the rarer allele's."""
    p = F.aggregate(gt, F.lit(0), lambda a, x: a + x.cast("int")) / F.nullif(2 * F.size(gt), F.lit(0))
    return F.least(p, 1 - p) if folded else p


def genotype_qc(sites: DataFrame, max_missing: float = 0.05, min_freq: float = 0.05, folded: bool = False) -> DataFrame:
    """Sites with few missing calls and frequent alleles, imputed by mode, with ``missing`` and ``freq``. Sites of missing calls alone go."""
    checked = sites.withColumn("missing", missing_share(F.col("gt"))).filter(F.col("missing") <= max_missing)
    return checked.withColumn("gt", impute_mode(F.col("gt"))).withColumn(
        "freq",
        allele_frequency(F.col("gt"), folded),
    ).filter(F.col("freq") >= min_freq)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the columns of a row, nulls skipped; NULL if all are null."""
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns]) / F.nullif(n, F.lit(0))
