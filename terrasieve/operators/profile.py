"""Data quality profile of columns that arrive in loads.

Base aggregates are exact and come from one pass that counts distinct values before anything is shuffled.
Changes of distribution are raised by a classifier two-sample test: for every load a logistic regression learns to
tell it from the reference load, its cross-fitted discrimination says whether the load differs, and what is lost
without a column, or left with it alone, says which column does. Base aggregates then name the kind of a change.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.values import NO_DATA, present
from terrasieve.plans.quantiles import quantiles_of_counts
from terrasieve.plans.scratch import Scratch

QUARTILES = (0.25, 0.5, 0.75)
#: Cut points of the reference load that discretise a column for the classifier.
DECILES = tuple(i / 10 for i in range(11))
#: Bins of a column: missing, below the reference load's range, its tenths, and above.
BINS = len(DECILES) + 2
#: Scores are counted in steps of this width, out to this many steps on either side.
SCORE_STEP, SCORE_STEPS = 0.05, 250
#: Penalty of a squared coefficient, per unit of weight; it keeps the fit finite where loads share no value.
RIDGE = 1e-3
#: A fit has converged when a step promises less than this of loss per unit of weight.
SETTLED = 1e-5


def value_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(col, load_no, value, n) over all rows; a missing value is NULL. Combined map-side, so a stuck value costs one row a task."""
    long = df.select(F.col(load).alias("__load"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(["__load"], list(columns), "col", "value")
    return long.groupBy("col", F.col("__load").alias("load_no"), present("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def base_profile(counts: DataFrame, valid: dict[tuple[str, str], tuple[float, float]]) -> DataFrame:
    """Exact aggregates per table, column and load: rows, missing, distinct, range, values outside ``valid``, most frequent value."""
    v, n = F.col("value"), F.col("n")
    # ANSI comparison with a NULL bound is NULL, so a column without a valid range has no violations
    bound = lambda i: reduce(
        lambda a, kv: a.when((F.col("tbl") == kv[0][0]) & (F.col("col") == kv[0][1]), F.lit(float(kv[1][i]))),
        valid.items(),
        F.when(F.lit(False), F.lit(0.0)),
    )
    low, high = bound(0), bound(1)
    return counts.groupBy("tbl", "col", "load_no").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("n_missing"),
        F.count(v).alias("n_distinct"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.coalesce(F.sum(F.when((v < low) | (v > high), n)), F.lit(0)).alias("n_violations"),
        F.max(F.when(v.isNotNull(), F.struct(n, -v))).alias("top"),
    ).select(
        "*",
        (F.col("n_missing") / F.col("n_rows")).alias("missing_share"),
        F.coalesce(F.col("top.n") / F.nullif(F.col("n_rows") - F.col("n_missing"), F.lit(0)), F.lit(0.0)).alias("top_share"),
    ).drop("top")


@dataclass(frozen=True)
class Loads:
    """What the classifier needs to know of one table: its columns, where each is cut, and its loads, the reference first."""

    name: str
    columns: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    loads: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.columns) * BINS


def _binned(df: DataFrame, table: int, known: Loads, load: str, fold_key: Sequence[str]) -> DataFrame:
    """(tbl, load, fold, bins, w): rows counted by load, fold and the bin of every column; all rows take part as weights."""
    index = reduce(lambda a, kv: a.when(F.col(load) == kv[1], F.lit(kv[0])), enumerate(known.loads), F.when(F.lit(False), F.lit(0)))
    fold = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in fold_key]), F.lit(2)).cast("int")
    values = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(known.columns)]
    rows = df.filter(F.col(load).isNotNull()).select(index.alias("load"), fold.alias("fold"), *values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, 2 + len(known.columns)), np.int16)
            cells[:, 0], cells[:, 1] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, cuts in enumerate(known.cuts):
                x = batch.column(2 + i).to_numpy(zero_copy_only=False)  # a null is NaN here
                at = np.searchsorted(np.array(cuts), x) + 1
                at[x == cuts[0]] = 2
                cells[:, 2 + i] = np.where(x > NO_DATA, at, 0)
            kinds, n = np.unique(cells, axis=0, return_counts=True)
            bins = pa.ListArray.from_arrays(np.arange(len(kinds) + 1, dtype=np.int32) * len(known.columns), kinds[:, 2:].astype(np.int8).ravel())
            columns = [pa.array(np.full(len(kinds), table, np.int32)), *(pa.array(kinds[:, i].astype(np.int32)) for i in (0, 1)), bins, pa.array(n.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["tbl", "load", "fold", "bins", "w"])

    cells = rows.mapInArrow(cut, "tbl int, load int, fold int, bins array<byte>, w double")
    return cells.groupBy("tbl", "load", "fold", "bins").agg(F.sum("w").alias("w"))


def _models(batch: pa.RecordBatch, known: Sequence[Loads], fitting: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(table, cells, is the load, weights, load, held-out fold) of every model that a batch has rows for: those fitted to, or those held out."""
    table, load, fold, weight = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("tbl", "load", "fold", "w"))
    lists = batch.column(batch.schema.get_field_index("bins"))
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pa.compute.list_value_length(lists).to_numpy())
    for t, k in enumerate(known):
        of_table = np.flatnonzero(table == t)
        if not len(of_table):
            continue
        n = len(k.columns)
        cells = flat[(ends[of_table] - n)[:, None] + np.arange(n)] + np.arange(n) * BINS
        for held in (0, 1):
            side = (fold[of_table] != held) if fitting else (fold[of_table] == held)
            reference = side & (load[of_table] == 0)
            for i in range(1, len(k.loads)):
                rows = np.flatnonzero(reference | (side & (load[of_table] == i)))
                if len(rows):
                    at = of_table[rows]
                    yield t, cells[rows], load[at] == i, weight[at], i, held


def _summed(parts: DataFrame) -> DataFrame:
    """(key, v): the vectors of equal keys added up, first over groups of tasks, so that no task holds more than a few of each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(v.as_py())
                total[key] = total[key] + values if key in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["key", "v"])

    first = parts.repartition(F.col("key"), F.pmod("part", F.lit(32))).select("key", "v").mapInArrow(add, "key long, v binary")
    return first.repartition("key").mapInArrow(add, "key long, v binary")


def _vectors(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([part] * len(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        names=["key", "part", "v"],
    )


def _key(table: int, load: int, held: int) -> int:
    return (table << 40) | (load << 1) | held


def _steps(cells: DataFrame, known: Sequence[Loads], coefs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(gradient, curvature) of every model at its coefficients, from one pass over all rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, at, own, w, load, held in _models(batch, known, True):
                key, width = _key(t, load, held), known[t].width
                p = 1 / (1 + np.exp(-coefs[key][at].sum(axis=1))) if key in coefs else np.full(len(w), 0.5)
                v = total.setdefault(key, np.zeros(width + width * width))
                slope, bend = w * (own - p), w * p * (1 - p)
                square = v[width:].reshape(width, width)
                for a in range(at.shape[1]):
                    v[:width] += np.bincount(at[:, a], slope, width)
                    for b in range(a, at.shape[1]):
                        pair = (at[:, a] - a * BINS) * BINS + at[:, b] - b * BINS
                        square[a * BINS : (a + 1) * BINS, b * BINS : (b + 1) * BINS] += np.bincount(pair, bend, BINS * BINS).reshape(BINS, BINS)
        yield _vectors(total)

    out = {}
    # a model's row is its width squared, whatever the number of rows
    for row in _summed(cells.mapInArrow(measure, "key long, part long, v binary")).collect():
        v, width = np.frombuffer(row["v"]), known[row["key"] >> 40].width
        upper = v[width:].reshape(width, width)
        out[row["key"]] = v[:width], upper + upper.T - np.diag(np.diag(upper))
    return out


def _alone(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """Log odds of every bin by itself, from a first step: with one column the regression is solved by its counts."""
    n = 4 * np.diag(bend)
    own = slope + n / 2
    columns = np.arange(len(n)) // BINS
    share = lambda x: (x + 0.5) / (np.bincount(columns, x)[columns] + 0.5 * BINS)
    return np.log(share(own) / share(n - own))


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric positive definite system, by conjugate gradients scaled with the diagonal.

    Sums are written out, as the threads of a linear algebra library may hang in a process that has started a JVM.
    """
    scale = 1 / np.diag(matrix)
    x, rest = np.zeros(len(right)), right.copy()
    towards = scale * rest
    size = float((rest * towards).sum())
    enough = 1e-16 * size
    for _ in range(4 * len(right)):
        if size <= enough:
            break
        image = np.einsum("ij,j->i", matrix, towards)
        length = size / float((towards * image).sum())
        x, rest = x + length * towards, rest - length * image
        fresh = scale * rest
        size, before = float((rest * fresh).sum()), size
        towards = fresh + size / before * towards
    return x


def _fit(cells: DataFrame, known: Sequence[Loads], rounds: int) -> tuple[dict[int, np.ndarray], dict[int, bool]]:
    """(scores, converged): for every model one row of coefficients with all columns, then one without each column, then one of each alone.

    All models take their Newton steps together, one pass a round. The coefficients without a column are those that
    minimise the loss's quadratic form at the optimum with that column's set to 0.
    """
    coefs: dict[int, np.ndarray] = {}
    alone: dict[int, np.ndarray] = {}
    weight: dict[int, float] = {}
    settled: dict[int, bool] = {}
    curvature: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        for key, (slope, bend) in _steps(cells, known, coefs).items():
            if key not in alone:
                alone[key] = _alone(slope, bend)
                weight[key] = 4 * np.trace(bend) / len(known[key >> 40].columns)
            penalty = RIDGE * weight[key]
            at = coefs.get(key, np.zeros(len(slope)))
            curvature[key] = bend + penalty * np.eye(len(slope))
            downhill = slope - penalty * at
            step = _solve(curvature[key], downhill)
            coefs[key], settled[key] = at + step, bool((step * downhill).sum() < SETTLED * weight[key])
        if all(settled.values()):
            break
    scores = {}
    for key, full in coefs.items():
        rows = [full]
        names = np.arange(len(full)) // BINS
        for c in range(names[-1] + 1):
            own, others = np.flatnonzero(names == c), np.flatnonzero(names != c)
            without = np.zeros(len(full))
            pull = np.einsum("ij,j->i", curvature[key][np.ix_(others, own)], full[own])
            without[others] = full[others] + (_solve(curvature[key][np.ix_(others, others)], pull) if len(others) else 0)
            rows.append(without)
        rows += [np.where(names == c, alone[key], 0.0) for c in range(names[-1] + 1)]
        scores[key] = np.array(rows)
    return scores, settled


def _discrimination(cells: DataFrame, known: Sequence[Loads], scores: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For every model the areas under its curves on the fold it wasn't fitted to, and the error that chance alone makes."""
    slots = 2 * SCORE_STEPS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, at, own, w, load, held in _models(batch, known, False):
                key = _key(t, load, held)
                if key not in scores:
                    continue
                v = total.setdefault(key, np.zeros(len(scores[key]) * 2 * slots)).reshape(-1, 2, slots)
                for m, row in enumerate(scores[key]):
                    slot = np.clip(np.rint(row[at].sum(axis=1) / SCORE_STEP), -SCORE_STEPS, SCORE_STEPS).astype(np.int64) + SCORE_STEPS
                    v[m] += np.bincount(own * slots + slot, w, 2 * slots).reshape(2, slots)
        yield _vectors(total)

    out = {}
    for row in _summed(cells.mapInArrow(count, "key long, part long, v binary")).collect():
        v = np.frombuffer(row["v"]).reshape(-1, 2, slots)
        reference, own = v[:, 0], v[:, 1]
        n, m = own[0].sum(), reference[0].sum()
        if n and m:
            below = np.cumsum(reference, axis=1) - reference / 2
            out[row["key"]] = np.append((own * below).sum(axis=1) / (n * m), np.sqrt((n + m + 1) / (12 * n * m)))
    return out


def classifier_test(tables: Sequence[tuple[DataFrame, str, Loads]], fold_key: Sequence[str], scratch: Scratch, *, rounds: int = 12) -> list[tuple]:
    """(table, col, load_no, auc, auc_without, auc_alone, auc_error, converged) of every load but the reference, cross-fitted in two folds.

    Every row takes part: rows are counted by binned value, which is exact for these features. The result is a
    summary of one row per column and load. A load or reference without rows in a fold is left out.
    """
    known = [k for _, _, k in tables]
    parts = [_binned(df, t, k, load, fold_key) for t, (df, load, k) in enumerate(tables)]
    cells = scratch.write(reduce(DataFrame.unionByName, parts), "cells")
    scores, settled = _fit(cells, known, rounds)
    found = _discrimination(cells, known, scores)
    out = []
    for t, k in enumerate(known):
        for i in range(1, len(k.loads)):
            keys = [_key(t, i, held) for held in (0, 1)]
            if not all(key in found for key in keys):
                continue
            a = np.mean([found[key] for key in keys], axis=0)
            error, n = float(a[-1] / np.sqrt(2)), len(k.columns)
            for c, name in enumerate(k.columns):
                out.append((k.name, name, k.loads[i], float(a[0]), float(a[1 + c]), float(a[1 + n + c]), error, all(settled[key] for key in keys)))
    return out


def profile_tables(
    tables: dict[str, tuple[DataFrame, Sequence[str], dict[str, tuple[float, float]]]],
    load: str,
    *,
    reference: int = 1,
    fold_key: Sequence[str] = ("iid",),
    classify: bool = True,
) -> DataFrame:
    """One row per table, column and load: exact aggregates, quartiles, those of the reference load, and the classifier test.

    ``tables`` gives for each name the rows, the columns and their valid ranges. A missing value is null, NaN or a
    no-data mark. Rows of a null load are profiled as a load of their own but not classified. An empty table gives
    no rows; a column with no values has null quartiles. All tables share every pass. Jobs run here: the counts are
    written once, and the classifiers fit; what comes to the driver is one row per column and load.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    scratch = Scratch(spark, "profile")
    counts = [value_counts(df, load, list(columns)).withColumn("tbl", F.lit(name)) for name, (df, columns, _) in tables.items()]
    counts = scratch.write(reduce(DataFrame.unionByName, counts), "counts")
    valid = {(name, c): r for name, (_, _, ranges) in tables.items() for c, r in ranges.items()}
    keys = ["tbl", "col", "load_no"]
    base = base_profile(counts, valid)
    ranks = quantiles_of_counts(counts, keys, scratch, [*QUARTILES, *(DECILES if classify else ())])
    on = reduce(lambda a, b: a & b, [base[k].eqNullSafe(ranks[k]) for k in keys])
    cuts = F.array(*[F.col(f"q_{i + len(QUARTILES)}") for i in range(len(DECILES) if classify else 0)]).alias("cuts")
    out = base.join(ranks, on, "left").select(
        *[base[c] for c in base.columns], F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"), (F.col("q_2") - F.col("q_0")).alias("iqr"), cuts
    )
    out = scratch.write(out, "base")
    ref = out.filter(F.col("load_no") == reference).select(
        *[F.col(k).alias(f"ref_{k}") for k in keys[:2]],
        F.col("median").alias("ref_median"),
        F.col("iqr").alias("ref_iqr"),
    )
    done = out.join(F.broadcast(ref), (out["tbl"] == ref["ref_tbl"]) & (out["col"] == ref["ref_col"]), "left").drop("ref_tbl", "ref_col", "cuts")
    if not classify:
        return done
    summary = out.select(*keys, "cuts").filter("load_no is not null").collect()
    fitted = []
    for name, (df, columns, _) in tables.items():
        loads = sorted({r["load_no"] for r in summary if r["tbl"] == name} - {reference})
        at = {r["col"]: tuple(sorted(set(r["cuts"]))) for r in summary if r["tbl"] == name and r["load_no"] == reference and r["cuts"] and r["cuts"][0] is not None}
        usable = tuple(c for c in columns if c in at)
        if usable and loads:
            fitted.append((df, load, Loads(name, usable, tuple(at[c] for c in usable), (reference, *loads))))
    rows = classifier_test(fitted, fold_key, scratch) if fitted else []
    schema = "tbl string, col string, load_no long, auc double, auc_without double, auc_alone double, auc_error double, converged boolean"
    test = spark.createDataFrame(rows, schema)
    on = reduce(lambda a, b: a & b, [done[k] == test[k] for k in keys])
    return done.join(F.broadcast(test), on, "left").select(*[done[c] for c in done.columns], "auc", "auc_without", "auc_alone", "auc_error", "converged")


def profile(
    df: DataFrame,
    load: str,
    columns: Sequence[str],
    *,
    valid: dict[str, tuple[float, float]] | None = None,
    reference: int = 1,
    fold_key: Sequence[str] = ("iid",),
    classify: bool = True,
) -> DataFrame:
    """``profile_tables`` of one table."""
    out = profile_tables({"": (df, columns, valid or {})}, load, reference=reference, fold_key=fold_key, classify=classify)
    return out.drop("tbl")


def told_apart(min_discrimination: float = 0.02, errors: float = 4.0) -> Column:
    """Whether the classifier tells a load from the reference by a column: alone, or by what its removal costs, and beyond chance."""
    gain = F.greatest(F.col("auc_alone") - 0.5, F.col("auc") - F.col("auc_without"))
    return gain >= F.greatest(F.lit(min_discrimination), errors * F.col("auc_error"))


def load_issues(
    profiled: DataFrame,
    *,
    max_missing: float = 0.10,
    max_shift: dict[str, float] | float = 4.0,
    spread: tuple[float, float] = (0.45, 1.6),
    max_top_share: float = 0.18,
    min_discrimination: float = 0.02,
    other: bool = False,
) -> DataFrame:
    """(tbl where there is one, col, load_no, issue): what is wrong with a load.

    missing, impossible and stuck are read off the exact aggregates of each load by itself, so that a value stuck in
    every load is found in every load. shifted and rescaled are changes of distribution: the classifier must tell the
    load from the reference by that column (alone, or by what its removal costs), by ``min_discrimination`` of AUC
    and by more than chance would in loads of that size; the exact aggregate then names the kind. With ``other``, a
    change that neither names comes out as changed.
    """
    shift = F.lit(float(max_shift)) if not isinstance(max_shift, dict) else reduce(
        lambda a,
        kv: a.when(F.col("col") == kv[0], F.lit(float(kv[1]))),
        max_shift.items(),
        F.when(F.lit(False), F.lit(0.0)),
    )
    raised = told_apart(min_discrimination)
    ratio = F.col("iqr") / F.nullif(F.col("ref_iqr"), F.lit(0.0))
    tests = {
        "missing": F.col("missing_share") > max_missing,
        "impossible": F.col("n_violations") > 0,
        "shifted": raised & (F.abs(F.col("median") - F.col("ref_median")) > shift),
        "rescaled": raised & ((ratio > spread[1]) | (ratio < spread[0])),
        "stuck": F.col("top_share") > max_top_share,
    }
    if other:
        tests["changed"] = raised & ~F.coalesce(tests["shifted"] | tests["rescaled"], F.lit(False))
    issues = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    named = [c for c in ("tbl", "col", "load_no") if c in profiled.columns]
    return profiled.select(*named, F.explode(issues).alias("issue"))
