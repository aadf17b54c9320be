"""Penalised linear models for many target variables at once.

Each model's sufficient statistics, the products of its standardised columns, are aggregated by Spark in one pass
for all folds and targets; coordinate descent then runs per (target, fold, penalty) on matrices whose size depends
on the number of features alone, so the work that grows with the records stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.values import present
from terrasieve.operators.effects import dot
from terrasieve.operators.stats import scale

#: 16 penalties from 0.01 to 10 on a log scale.
ALPHAS = tuple(float(a) for a in np.logspace(-2, 1, 16))
L1_RATIO = 0.1


def _moments(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str) -> DataFrame:
    """(target, fold, n, s, m): count, sums and products of [features, target] over complete rows, added up per partition first."""
    p = len(features) + 1
    long = df.select(
        F.col(fold).cast("int").alias("fold"),
        *[present(F.col(f"`{f}`").cast("double")).alias(f"x{i}") for i, f in enumerate(features)],
        *[present(F.col(f"`{t}`").cast("double")).alias(f"y{i}") for i, t in enumerate(targets)],
    )

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list] = {}
        for pdf in batches:
            x = pdf[[f"x{i}" for i in range(len(features))]].to_numpy(np.float64)
            folds = pdf["fold"].to_numpy()
            for t in range(len(targets)):
                xy = np.column_stack([x, pdf[f"y{t}"].to_numpy(np.float64)])
                ok = ~np.isnan(xy).any(axis=1)
                for f in np.unique(folds[ok]):
                    part = xy[ok & (folds == f)]
                    held = total.setdefault((t, int(f)), [0, np.zeros(p), np.zeros((p, p))])
                    held[0] += len(part)
                    held[1] += part.sum(axis=0)
                    held[2] += part.T @ part
        yield pd.DataFrame(
            [
                {
                    "target": targets[t],
                    "fold": f,
                    "n": n,
                    "s": s.tolist(),
                    "m": m.ravel().tolist(),
                } for (t, f), (n, s, m) in total.items()
            ],
            columns=["target", "fold", "n", "s", "m"],
        )

    parts = long.mapInPandas(add, "target string, fold int, n long, s array<double>, m array<double>")
    flat = parts.select(
        "target",
        "fold",
        "n",
        F.posexplode(F.concat("s", "m")).alias("i", "v"),
    ).groupBy("target", "fold", "i").agg(F.sum("v").alias("v"))
    whole = flat.groupBy("target", "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("v")
    )
    return whole.join(parts.groupBy("target", "fold").agg(F.sum("n").alias("n")), ["target", "fold"]).select(
        "target",
        "fold",
        "n",
        F.slice("v", 1, p).alias("s"),
        F.slice("v", p + 1, p * p).alias("m"),
    )


def descend(
    gram: np.ndarray,
    xy: np.ndarray,
    alpha: float,
    l1: float,
    start: np.ndarray,
    tol: float = 1e-10,
    rounds: int = 5_000,
) -> np.ndarray:
    """Coefficients that minimise |y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) |w|^2 / 2, from X'X / n and X'y / n."""
    w = start.copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] == 0:
                continue
            rho = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (gram[j, j] + alpha * (1 - l1))
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most < tol:
            break
    return w


def elastic_net(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    *,
    fold: str,
    alphas: Sequence[float] = ALPHAS,
    l1_ratio: float = L1_RATIO,
) -> DataFrame:
    """(target, alpha, cv_mse, coefs, intercept, n): per target the penalty of least mean squared error over the folds, refitted on all rows.

    Features are standardised by the training rows' mean and population deviation; coefficients are for
    standardised features, the intercept is the target's mean. ``fold`` is an int column that says in which fold a
    row is held out. Rows with a missing feature or target are left out for that target. Constant features get 0.
    """
    p = len(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n_all, s_all, m_all = pdf["n"].sum(), np.sum(pdf["s"].tolist(), axis=0), np.sum(pdf["m"].tolist(), axis=0).reshape(p + 1, p + 1)

        def path(n: float, s: np.ndarray, m: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
            mean = s / n
            cov = m / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
            sd[sd < 1e-12] = 0
            safe = np.where(sd > 0, sd, 1)
            gram, xy = cov[:p, :p] / np.outer(safe, safe), cov[:p, p] / safe
            gram[sd == 0], gram[:, sd == 0], xy[sd == 0] = 0, 0, 0
            w, out = np.zeros(p), {}
            for a in sorted(alphas, reverse=True):
                w = out[a] = descend(gram, xy, a, l1_ratio, w)
            return [out[a] for a in alphas], mean, safe

        errors = np.zeros(len(alphas))
        held_rows = 0
        if len(pdf) > 1:
            for n, s, m in zip(pdf["n"], pdf["s"], pdf["m"], strict=True):
                s, m = np.array(s), np.array(m).reshape(p + 1, p + 1)
                ws, mean, safe = path(n_all - n, s_all - s, m_all - m)
                for i, w in enumerate(ws):
                    # the held-out squared error follows from its moments: e = y - b - v'x
                    v = np.append(-w / safe, 1.0)
                    c = -(mean[p] - (w / safe) @ mean[:p])
                    errors[i] += (v @ m @ v + 2 * c * (v @ s) + n * c * c) / n / len(pdf)
                held_rows += n
        best = int(np.argmin(errors))
        ws, mean, _ = path(n_all, s_all, m_all)
        return pd.DataFrame(
            {
                "target": [pdf["target"].iloc[0]],
                "alpha": [float(alphas[best])],
                "cv_mse": [float(errors[best]) if held_rows else None],
                "coefs": [ws[best].tolist()],
                "intercept": [float(mean[p])],
                "n": [int(n_all)],
            }
        )

    # one group holds the folds of one target: a matrix each, whatever the number of records
    return _moments(df, features, targets, fold).groupBy("target").applyInPandas(
        fit,
        "target string, alpha double, cv_mse double, coefs array<double>, intercept double, n long",
    )


def linear_svr(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    *,
    penalties: Sequence[float] = (0.01, 0.1, 1.0),
    epsilon: float = 0.1,
    rounds: int = 20,
) -> DataFrame:
    """(target, penalty, coefs, intercept, loss, n): linear support vector regression with squared epsilon-insensitive loss.

    Minimises |w|^2 / 2 + C / n * sum(max(0, |y - b - xw| - epsilon)^2) by Newton steps: a step solves for the rows outside
    the tube, whose moments are one distributed aggregate for all targets and penalties at once. Models of a few
    dozen features each come to the driver between steps. Features should be standardised; rows with a missing
    feature or target are left out for that target.
    """
    p = len(features) + 1
    models = [(t, float(c)) for t in targets for c in penalties]
    beta = {m: np.zeros(p) for m in models}
    rows = df.select(
        *[present(F.col(f"`{f}`").cast("double")).alias(f"x{i}") for i, f in enumerate(features)],
        *[present(F.col(f"`{t}`").cast("double")).alias(f"y{i}") for i, t in enumerate(targets)],
    )
    loss: dict = {}
    count: dict = {}

    def sums(batches: Iterator[pd.DataFrame], beta: dict) -> Iterator[pd.DataFrame]:
        total = {m: [0, 0.0, np.zeros(p), np.zeros((p, p))] for m in models}
        for pdf in batches:
            x = np.column_stack([pdf[[f"x{i}" for i in range(p - 1)]].to_numpy(np.float64), np.ones(len(pdf))])
            for i, t in enumerate(targets):
                y = pdf[f"y{i}"].to_numpy(np.float64)
                ok = ~(np.isnan(y) | np.isnan(x).any(axis=1))
                for m in models:
                    if m[0] != t:
                        continue
                    e = y[ok] - x[ok] @ beta[m]
                    out = np.abs(e) > epsilon
                    xa = x[ok][out]
                    goal = y[ok][out] - np.sign(e[out]) * epsilon
                    held = total[m]
                    held[0] += int(ok.sum())
                    held[1] += float(np.sum((np.abs(e[out]) - epsilon) ** 2))
                    held[2] += xa.T @ goal
                    held[3] += xa.T @ xa
        yield pd.DataFrame(
            [
                {
                    "k": models.index(m),
                    "v": [float(n), e, *xy.tolist(), *xx.ravel().tolist()],
                } for m, (n, e, xy, xx) in total.items()
            ]
        )

    for _ in range(rounds):
        parts = rows.mapInPandas(lambda batches, now=dict(beta): sums(batches, now), "k int, v array<double>")
        flat = parts.select("k", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).collect()
        moved = 0.0
        for k, m in enumerate(models):
            v = np.zeros(2 + p + p * p)
            for r in flat:
                if r["k"] == k:
                    v[r["i"]] = r["x"]
            n, loss[m], xy, xx = v[0], v[1], v[2 : 2 + p], v[2 + p :].reshape(p, p)
            count[m] = int(n)
            if not n:
                continue
            ridge = np.eye(p) * (n / (2 * m[1]))
            ridge[-1, -1] = 1e-9
            new = np.linalg.solve(xx + ridge, xy)
            moved = max(moved, float(np.abs(new - beta[m]).max()))
            beta[m] = new
        if moved < 1e-8:
            break
    out = [(t, c, beta[t, c][:-1].tolist(), float(beta[t, c][-1]), float(loss[t, c]), count[t, c]) for t, c in models]
    return df.sparkSession.createDataFrame(
        out,
        "target string, penalty double, coefs array<double>, intercept double, loss double, n long",
    )


def model_predictions(df: DataFrame, models: DataFrame, features: Sequence[str], key: Sequence[str], fit_on=None) -> DataFrame:  # noqa: ANN001
    """(key, target, prediction): every complete row scored by every model; features are standardised by the rows of ``fit_on``."""
    z = scale(
        df,
        features,
        "zscore0",
        fit_on=fit_on,
    ).select(*key, F.array(*features).alias("z")).filter(~F.exists("z", lambda x: x.isNull()))
    # one row a target on the broadcast side
    return z.join(F.broadcast(models.select("target", "coefs", "intercept"))).select(
        *key,
        "target",
        (dot(F.col("z"), F.col("coefs")) + F.col("intercept")).alias("prediction"),
    )
