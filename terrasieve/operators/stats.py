"""Statistics: scaling, ranks, correlation, agreement of predictions, resampling and rank tests.

Statistics over a whole table are one aggregate with partial sums; their one row is joined back, never looped
over. Missing values (null, NaN, no-data) take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.functions.values import present
from terrasieve.operators.clean import row_mean
from terrasieve.plans.joins import join_same
from terrasieve.plans.positions import global_positions
from terrasieve.plans.quantiles import quantiles_of_counts
from terrasieve.plans.scratch import Scratch

_SCALERS = ("zscore", "zscore0", "minmax", "robust", "none")


def _centre_and_spread(c: str, method: str) -> tuple[Column, Column]:
    v = present(F.col(f"`{c}`").cast("double"))
    return {
        "zscore": (F.avg(v), F.stddev_samp(v)),
        "zscore0": (F.avg(v), F.stddev_pop(v)),
        "minmax": (F.min(v), F.max(v) - F.min(v)),
        "none": (F.min(F.lit(0.0)), F.min(F.lit(1.0))),
    }[method]


def scale(df: DataFrame, columns: Sequence[str], method: str = "zscore", *, fit_on: Column | None = None) -> DataFrame:
    """``columns`` centred and scaled over the whole table.

    zscore: sample deviation; zscore0: population deviation; minmax: range; robust: median and quartile distance.
    ``fit_on`` limits the rows the statistics come from (a training split). A constant column is only
    centred; a missing value gives NULL. One row of statistics is broadcast.
    """
    if method not in _SCALERS:
        raise ValueError(f"method must be one of {_SCALERS}")
    rows = df.filter(fit_on) if fit_on is not None else df
    if method == "robust":
        q = quantiles(
            rows.select(
                F.explode(
                    F.array(
                        *[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]
                    )
                ).alias("x")
            ).select("x.*"),
            ["i"],
            "v",
            (0.25, 0.5, 0.75),
        )
        pick = lambda i, c: F.max(F.when(F.col("i") == i, c))
        stats = q.agg(
            *[
                x for i in range(len(columns)) for x in (
                    pick(i, F.col("q_1")).alias(f"__c{i}"),
                    pick(i, F.col("q_2") - F.col("q_0")).alias(f"__s{i}"),
                )
            ]
        )
    else:
        stats = rows.agg(
            *[
                s.alias(f"__{k}{i}") for i, c in enumerate(columns) for k, s in zip(
                    "cs",
                    _centre_and_spread(c, method),
                    strict=True,
                )
            ]
        )
    wide = df.join(F.broadcast(stats))
    # a spread of 0 divides by 1: a constant column is centred, which gives 0 for the rows it was fitted to
    spread = lambda i: F.coalesce(F.nullif(F.col(f"__s{i}"), F.lit(0.0)), F.lit(1.0))
    return wide.withColumns(
        {c: (present(F.col(f"`{c}`").cast("double")) - F.col(f"__c{i}")) / spread(i) for i, c in enumerate(columns)}
    ).select(*df.columns)


def correlation_distance(r: Column) -> Column:
    """How far apart two columns are by their correlation, of either sign: sqrt(2 (1 - |r|))."""
    return F.sqrt(2 * (1 - F.least(F.abs(r), F.lit(1.0))))


def log_grid(low: float, high: float, n: int) -> list[float]:
    """``n`` powers of ten whose exponents go from ``low`` to ``high`` in equal steps."""
    return [10.0 ** (low + (high - low) * i / max(n - 1, 1)) for i in range(n)]


#: Short names of soil properties by what their column's name holds, and those of other columns are cut to 8 letters.
SOIL_NAMES = {"clay": "Clay", "bdod": "BulkDens", "phh2o": "pH", "soc": "SOC", "nitrogen": "Nitrogen", "wv0033": "WaterCont"}


def cluster_names(members: DataFrame, cluster: str, column: str, prefix: str = "bio") -> DataFrame:
    """(cluster, name, size): a name for each cluster of columns, made from its sorted members; there are as many rows as columns at most.

    Up to three climate columns give their numbers, more the first and last number; up to two soil columns their short
    names, more a mixture; climate and soil together their counts. Names compare without case, and sort as text.
    """
    sets = members.groupBy(cluster).agg(F.array_sort(F.collect_list(column)).alias("all"))
    is_climate = lambda c: F.lower(c).startswith(prefix)
    climate, soil = F.filter("all", is_climate), F.filter("all", lambda c: ~is_climate(c))
    number = lambda c: F.regexp_replace(c, rf"(?i)^{prefix}_?", "")
    numbers = F.transform(climate, lambda c: number(c).try_cast("int"))

    def short(c: Column) -> Column:
        out = F.substring(c, 1, 8)
        for part, name in reversed(SOIL_NAMES.items()):
            out = F.when(F.contains(F.lower(c), F.lit(part)), name).otherwise(out)
        return out

    text = lambda c: c.cast("string")
    head = F.lit(prefix + "_")
    name = (
        F.when((F.size(climate) > 0) & (F.size(soil) > 0), F.concat(F.lit(f"Mixed_{prefix}"), text(F.size(climate)), F.lit("_Soil"), text(F.size(soil))))
        .when(F.size(climate) > 3, F.concat(head, text(F.array_min(numbers)), F.lit("to"), text(F.array_max(numbers)), F.lit("_group")))
        .when(F.size(climate) > 0, F.concat(head, F.array_join(F.transform(climate, number), "_")))
        .when(F.size(soil) > 2, F.lit("Soil_Mixed"))
        .otherwise(F.concat(F.lit("Soil_"), F.array_join(F.transform(soil, short), "_")))
    )
    return sets.select(cluster, name.alias("name"), F.size("all").alias("size"))


def variable_mapping(members: DataFrame, cluster: str, column: str, prefix: str = "bio") -> DataFrame:
    """(column, final, kind, cluster, size): which combined column each column went into; a column alone keeps its name."""
    named = members.join(cluster_names(members, cluster, column, prefix), cluster)
    several = F.col("size") > 1
    return named.select(
        column,
        F.when(several, F.col("name")).otherwise(F.col(column)).alias("final"),
        F.when(several, "combined").otherwise("individual").alias("kind"),
        F.when(several, F.col(cluster)).alias(cluster),
        "size",
    )


def combine_columns(
    df: DataFrame,
    clusters: dict[str, Sequence[str]],
    method: str = "zscore",
    rescale: bool = False,
) -> DataFrame:
    """Each cluster of columns replaced by the mean of its scaled columns, nulls skipped; other columns stay.

    The mean isn't scaled again unless ``rescale``, so its deviation is below 1.
    """
    members = [c for cs in clusters.values() for c in cs]
    scaled = scale(df, members, method)
    out = scaled.withColumns(
        {name: row_mean([F.col(f"`{c}`") for c in cs]) for name, cs in clusters.items()}
    ).drop(*[m for m in members if m not in clusters])
    return scale(out, list(clusters), "zscore") if rescale else out


def cluster_name(columns: Sequence[str]) -> str:
    """Name of a cluster of bioclimatic columns: up to three numbers joined in text order, else first to last."""
    numbers = sorted(c.lower().removeprefix("bio").lstrip("_") for c in columns)
    return "bio_" + "_".join(numbers) if len(numbers) <= 3 else f"bio_{min(numbers, key=int)}_to_{max(numbers, key=int)}"


def quantiles(df: DataFrame, group: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(group, q_0, q_1, ...): exact quantiles by linear interpolation, for groups of any size. Writes a table."""
    counts = df.select(
        *group,
        present(F.col(f"`{value}`").cast("double")).alias("value"),
    ).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    return quantiles_of_counts(counts, group, Scratch(df.sparkSession, "quantiles"), at)


def average_rank(df: DataFrame, value: str, group: Sequence[str] = (), name: str = "rank", descending: bool = False) -> DataFrame:
    """Adds the mean-of-ties rank of ``value`` in its group; null and NaN get NULL.

    Equal values are counted first, and global positions rank the counts, so no group is held in a task. Writes a table.
    """
    v = present(F.col(f"`{value}`").cast("double"))
    counts = df.select(*group, v.alias("__v")).filter("__v is not null").groupBy(*group, "__v").agg(
        F.count(F.lit(1)).alias("__n")
    )
    order = F.col("__v").desc() if descending else F.col("__v").asc()
    placed = global_positions(counts, list(group), [order], Scratch(df.sparkSession, "rank"), "placed", weight="__n")
    ranks = placed.select(*group, "__v", (F.col("position") + (F.col("__n") + 1) / 2.0).alias("__rank"))
    return join_same(df.withColumn("__v", v), ranks, [*group, "__v"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("__rank").alias(name),
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, in one pass; rows in which either is missing are skipped for that pair."""
    v = {c: present(F.col(f"`{c}`").cast("double")) for c in columns}
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    both = lambda a, b: v[a].isNotNull() & v[b].isNotNull()
    row = df.agg(
        *[
            F.try_divide(
                F.covar_pop(v[a], v[b]),
                F.stddev_pop(F.when(both(a, b), v[a])) * F.stddev_pop(F.when(both(a, b), v[b])),
            ).alias(f"r{i}") for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
            )
        ).alias("p")
    ).select("p.*")


def prediction_metrics(df: DataFrame, group: Sequence[str], observed: str, predicted: str) -> DataFrame:
    """Per group: n, mse, mae, r2 (1 - SSE/SST), r2_cor (squared correlation) and spearman over complete pairs.

    A constant truth has no r2 (NULL).
    """
    rows = df.select(
        *group,
        present(F.col(observed).cast("double")).alias("y"),
        present(F.col(predicted).cast("double")).alias("p"),
    ).dropna(subset=["y", "p"])
    ranked = average_rank(average_rank(rows, "y", group, "ry"), "p", group, "rp")
    e = F.col("y") - F.col("p")
    return ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count(F.lit(1)))).alias("r2"),
        F.pow(F.try_divide(F.covar_pop("y", "p"), F.stddev_pop("y") * F.stddev_pop("p")), 2).alias("r2_cor"),
        F.try_divide(F.covar_pop("ry", "rp"), F.stddev_pop("ry") * F.stddev_pop("rp")).alias("spearman"),
    )


def score_summary(df: DataFrame, group: Sequence[str], value: str, top: int = 5) -> DataFrame:
    """Per group: n, mean, standard error, median, and the mean of the ``top`` highest values."""
    rows = df.select(*group, present(F.col(value).cast("double")).alias("v")).dropna(subset=["v"])
    best = Window.partitionBy(*group).orderBy(F.col("v").desc())
    tops = rows.withColumn(
        "r",
        F.row_number().over(best),
    ).filter(F.col("r") <= top).groupBy(*group).agg(F.avg("v").alias("mean_top"))
    all_ = rows.groupBy(*group).agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"),
    )
    middle = quantiles(rows, group, "v", (0.5,)).withColumnRenamed("q_0", "median")
    return join_same(join_same(all_, middle, group), tops, group)


def density_histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, density, cdf) over equal bins of [low, high]; the last bin is closed. Empty bins are absent; there are at most ``bins`` rows."""
    v = present(F.col(value).cast("double"))
    width = (high - low) / bins
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    so_far = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(F.broadcast(total)).select(
        "bin",
        (F.col("n") / F.col("total") / width).alias("density"),
        (F.sum("n").over(so_far) / F.col("total")).alias("cdf"),
    )


def relative_change(df: DataFrame, order: str, value: str) -> DataFrame:
    """(order, change): each value's change relative to the one before; the first keeps its value. For short series such as one area per number of clusters."""
    before = F.lag(value).over(Window.orderBy(order))
    return df.select(
        order,
        F.when(before.isNull(), F.col(value)).otherwise((F.col(value) - before) / F.nullif(before, F.lit(0.0))).alias("change"),
    )


def smallest_reaching(df: DataFrame, order: str, share: str, target: float) -> DataFrame:
    """One row ``k``: how many leading rows of a short series reach ``target`` of its sum; NULL if none does."""
    total = F.sum(share).over(Window.partitionBy())
    reached = F.sum(share).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(total, F.lit(0.0))
    ranked = df.select(F.row_number().over(Window.orderBy(order)).alias("r"), reached.alias("reached"))
    return ranked.agg(F.min(F.when(F.col("reached") >= target, F.col("r"))).alias("k"))


def closest_to_median(df: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """The n rows whose value is nearest the median, with ``distance``; ties by key."""
    middle = quantiles(df, [], value, (0.5,)).withColumnRenamed("q_0", "__m")
    return df.join(F.broadcast(middle)).select(
        key,
        value,
        F.abs(F.col(value) - F.col("__m")).alias("distance"),
    ).orderBy("distance", key).limit(n)


def _poisson_copies(key: str, seed: int) -> Callable[[Column], Column]:
    """How often a row is drawn in a repetition: Poisson(1) by a hash of its key."""
    u = lambda r: (F.pmod(F.xxhash64(F.col(key), r, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cuts = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    return lambda r: reduce(lambda a, b: a + b, [(u(r) > c).cast("int") for c in cuts])


def bootstrap_mean(
    df: DataFrame,
    key: str,
    value: str,
    *,
    group: Sequence[str] = (),
    reps: int = 200,
    seed: int = 42,
    alpha: float = 0.05,
) -> DataFrame:
    """Per group: mean and percentile interval of the mean under resampling.

    Each row draws its number of copies in every repetition from a Poisson(1) law by a hash of its key, so no row
    is moved: the table is aggregated once, with ``reps`` partial sums a task. Agrees with drawing with
    replacement in law, not draw for draw.
    """
    copies = _poisson_copies(key, seed)
    rows = df.select(*group, key, present(F.col(value).cast("double")).alias("v")).dropna(subset=["v"])
    drawn = rows.withColumn(
        "rep",
        F.explode(F.sequence(F.lit(1), F.lit(reps))),
    ).withColumn("w", copies(F.col("rep"))).filter("w > 0")
    means = drawn.groupBy(*group, "rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    bounds = means.groupBy(*group).agg(
        F.percentile("m", F.lit(alpha / 2)).alias("low"),
        F.percentile("m", F.lit(1 - alpha / 2)).alias("high"),
    )
    plain = rows.groupBy(*group).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return join_same(plain, bounds, group)


def bootstrap_r2(
    df: DataFrame,
    key: str,
    truth: str,
    prediction: str,
    *,
    group: Sequence[str] = (),
    reps: int = 1000,
    seed: int = 42,
    alpha: float = 0.05,
) -> DataFrame:
    """Per group: R2 of a prediction and its percentile interval under resampling of pairs, drawn as in ``bootstrap_mean``."""
    copies = _poisson_copies(key, seed)
    rows = df.select(
        *group,
        key,
        present(F.col(truth).cast("double")).alias("y"),
        present(F.col(prediction).cast("double")).alias("p"),
    ).dropna(subset=["y", "p"])
    # deviations from one centre keep the sums of squares exact enough
    rows = rows.join(F.broadcast(rows.agg(F.avg("y").alias("c")))).withColumns({"e": F.col("y") - F.col("p"), "y": F.col("y") - F.col("c")})

    def r2(w: Column) -> Column:
        spread = F.sum(w * F.col("y") * F.col("y")) - F.sum(w * F.col("y")) * F.sum(w * F.col("y")) / F.sum(w)
        return 1 - F.sum(w * F.col("e") * F.col("e")) / F.nullif(spread, F.lit(0.0))

    drawn = rows.withColumn(
        "rep",
        F.explode(F.sequence(F.lit(1), F.lit(reps))),
    ).withColumn("w", copies(F.col("rep"))).filter("w > 0")
    bounds = drawn.groupBy(*group, "rep").agg(r2(F.col("w")).alias("m")).groupBy(*group).agg(
        F.percentile("m", F.lit(alpha / 2)).alias("low"),
        F.percentile("m", F.lit(1 - alpha / 2)).alias("high"),
    )
    plain = rows.groupBy(*group).agg(F.count("y").alias("n"), r2(F.lit(1.0)).alias("r2"))
    return join_same(plain, bounds, group)


def win_tie_loss(df: DataFrame, block: str, model: str, score: str) -> DataFrame:
    """(a, b, wins, ties, losses, mean_diff) for every pair of models over the blocks both have; a small table of models."""
    rows = df.select(block, F.col(model).alias("model"), present(F.col(score).cast("double")).alias("s")).dropna(subset=["s"])
    a, b = rows.select(block, F.col("model").alias("a"), F.col("s").alias("sa")), rows.select(
        block,
        F.col("model").alias("b"),
        F.col("s").alias("sb"),
    )
    d = F.col("sa") - F.col("sb")
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return a.join(b, block).filter("a < b").groupBy("a", "b").agg(
        n(d > 0).alias("wins"),
        n(d == 0).alias("ties"),
        n(d < 0).alias("losses"),
        F.avg(d).alias("mean_diff"),
    )


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale_ = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale_)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale_ * h


def chi2_tail(x: float, df: int) -> float:
    return _gamma_tail(df / 2, x / 2)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_tail(t: float, df: float) -> float:
    """Upper tail of Student's t for t >= 0, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if t <= 0:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(p: float, q: float, y: float) -> float:
        c, d = 1.0, 1 / max(1 - (p + q) * y / (p + 1), 1e-300)
        h = d
        for m in range(1, 1000):
            for num in (
                m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    whole = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return whole / 2


def friedman(df: DataFrame, block: str, model: str, score: str, higher_is_better: bool = True) -> DataFrame:
    """(model, n_blocks, mean_rank, chi2, p) over blocks that have every model; ties take mean ranks and correct chi2.

    The models' mean ranks, one row each, come to the driver for the tail probability.
    """
    rows = df.select(block, model, present(F.col(score).cast("double")).alias("s")).dropna(subset=["s"])
    k = rows.select(model).distinct().count()
    whole = rows.groupBy(block).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    ranked = average_rank(rows.join(whole.select(block), block, "left_semi"), "s", [block], "rank", descending=higher_is_better)
    sums = ranked.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.avg("rank").alias("mean_rank"),
        F.sum(F.col("rank") * F.col("rank")).alias("squares"),
    )
    got = sums.collect()
    n = got[0]["n_blocks"] if got else 0
    chi2 = p = None
    if n and k > 1:
        spread = sum(r["squares"] for r in got) - n * k * (k + 1) ** 2 / 4
        between = n * sum((r["mean_rank"] - (k + 1) / 2) ** 2 for r in got)
        chi2 = n * (k - 1) * between / spread if spread else 0.0
        p = chi2_tail(chi2, k - 1)
    return sums.select(
        model,
        "n_blocks",
        "mean_rank",
        F.lit(chi2).cast("double").alias("chi2"),
        F.lit(p).cast("double").alias("p"),
    )


def conover_pairs(df: DataFrame, block: str, model: str, score: str, higher_is_better: bool = True) -> DataFrame:
    """(a, b, rank_difference, t, p, p_holm) for every pair of models after a rank test over whole blocks.

    The ranking is distributed; the models' rank sums, one row each, come to the driver for the tail probabilities.
    """
    rows = df.select(block, F.col(model).alias("model"), present(F.col(score).cast("double")).alias("s")).dropna(subset=["s"])
    k = rows.select("model").distinct().count()
    whole = rows.groupBy(block).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    ranked = average_rank(rows.join(whole.select(block), block, "left_semi"), "s", [block], "rank", descending=higher_is_better)
    sums = ranked.groupBy("model").agg(
        F.sum("rank").alias("r"),
        F.sum(F.col("rank") * F.col("rank")).alias("q"),
        F.count(F.lit(1)).alias("n"),
    ).orderBy("model").collect()
    schema = "a string, b string, rank_difference double, t double, p double, p_holm double"
    if len(sums) < 2 or sums[0]["n"] < 2:
        return df.sparkSession.createDataFrame([], schema)
    n, df_ = sums[0]["n"], (sums[0]["n"] - 1) * (len(sums) - 1)
    error = math.sqrt(max(2 * (n * sum(s["q"] for s in sums) - sum(s["r"] ** 2 for s in sums)) / df_, 0.0))
    out = []
    for x, y in combinations(sums, 2):
        gap = x["r"] - y["r"]
        t = abs(gap) / error if error else (math.inf if gap else 0.0)
        out.append([str(x["model"]), str(y["model"]), gap / n, t, 0.0 if math.isinf(t) else 2 * t_tail(t, df_)])
    for row, p in zip(out, holm([r[4] for r in out]), strict=True):
        row.append(p)
    return df.sparkSession.createDataFrame([tuple(r) for r in out], schema)


def smooth_curve(df: DataFrame, x: str, y: str, fraction: float = 0.1, points: int = 50) -> DataFrame:
    """(x, y, n): a local linear fit with tricube weights at evenly spaced ranks of x, each over ``fraction`` of the rows, half on either side.

    The curve's ``points`` and their reaches are exact quantiles, one broadcast row each; a row meets only the points
    it is in reach of, and the weighted sums of a point are combined before the shuffle. Where x doesn't vary within
    reach the weighted mean is given.
    """
    rows = df.select(present(F.col(x).cast("double")).alias("x"), present(F.col(y).cast("double")).alias("y")).dropna()
    at = [(i + 0.5) / points for i in range(points)]
    bounds = [q for p in at for q in (max(p - fraction / 2, 0.0), p, min(p + fraction / 2, 1.0))]
    q = quantiles(rows, [], "x", bounds)
    reach = lambda i: F.greatest(F.col(f"q_{3 * i + 2}") - F.col(f"q_{3 * i + 1}"), F.col(f"q_{3 * i + 1}") - F.col(f"q_{3 * i}"))
    targets = q.select(
        F.array(
            *[F.struct(F.lit(i).alias("i"), F.col(f"q_{3 * i + 1}").alias("x0"), reach(i).alias("reach")) for i in range(points)]
        ).alias("ts")
    )
    near = rows.join(F.broadcast(targets)).select(
        "x",
        "y",
        F.inline(F.filter("ts", lambda t: F.abs(F.col("x") - t["x0"]) <= t["reach"])),
    )
    u = F.coalesce(F.abs(F.col("x") - F.col("x0")) / F.nullif(F.col("reach"), F.lit(0.0)), F.lit(0.0))
    w, d = F.greatest(F.pow(1 - F.pow(u, 3), 3), F.lit(1e-9)), F.col("x") - F.col("x0")
    sums = near.groupBy("i", "x0").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        F.sum(w * d).alias("wx"),
        F.sum(w * d * d).alias("wxx"),
        F.sum(w * F.col("y")).alias("wy"),
        F.sum(w * d * F.col("y")).alias("wxy"),
    )
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    fit = F.when(
        det > 1e-12 * F.col("w") * F.col("w"),
        (F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy")) / det,
    ).otherwise(F.col("wy") / F.col("w"))
    return sums.select(F.col("x0").alias("x"), fit.alias("y"), "n")


def wilcoxon(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Per group: n (non-zero differences), w_plus, w_minus and z of the signed-rank test with tie correction."""
    d = df.select(
        *group,
        (present(F.col(a).cast("double")) - present(F.col(b).cast("double"))).alias("d"),
    ).filter("d <> 0").withColumn("m", F.abs("d"))
    ranked = average_rank(d, "m", group, "rank")
    ties = d.groupBy(*group, "m").agg(F.count(F.lit(1)).alias("t")).groupBy(*group).agg(
        F.sum(F.pow("t", 3) - F.col("t")).alias("ties")
    )
    sums = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
    )
    both = join_same(sums, ties, group)
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return both.select(
        *group,
        "n",
        "w_plus",
        "w_minus",
        ((F.col("w_plus") - n * (n + 1) / 4) / F.nullif(sd, F.lit(0.0))).alias("z"),
    )


def holm(p_values: Sequence[float]) -> list[float]:
    """Holm's step-down correction of a family of p-values, in their order."""
    order = sorted(range(len(p_values)), key=p_values.__getitem__)
    out, running = [0.0] * len(p_values), 0.0
    for i, at in enumerate(order):
        running = max(running, min(1.0, (len(p_values) - i) * p_values[at]))
        out[at] = running
    return out
