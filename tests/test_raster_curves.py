from __future__ import annotations

import math
import random

import numpy as np
import pytest

from terrasieve.operators import models, raster, stats


def test_nearest_valid_matches_brute_force(spark):
    r = random.Random(1)
    cells = [
        (
            i,
            j,
            (None if r.random() < 0.7 else math.nan if r.random() < 0.05 else float(i * 100 + j)),
        ) for i in range(-6, 9) for j in range(-4, 11)
    ] + [(500, 500, None)]
    got = {
        (x["r"], x["c"]): (x["v"], x["distance"]) for x in raster.nearest_valid(
            spark.createDataFrame(cells, "r long, c long, v double"),
            "r",
            "c",
            "v",
            3,
        ).collect()
    }
    valid = [(i, j, v) for i, j, v in cells if v is not None and not math.isnan(v)]
    for i, j, v in cells:
        if v is not None and not math.isnan(v):
            assert got[i, j] == (v, 0.0)
            continue
        near = sorted(((i - a) ** 2 + (j - b) ** 2, a, b, w) for a, b, w in valid if abs(i - a) <= 3 and abs(j - b) <= 3)
        assert got[i, j] == ((near[0][3], pytest.approx(math.sqrt(near[0][0]))) if near else (None, None))
    assert len(got) == len(cells)


def test_conover_needs_two_blocks_and_corrects(spark):
    df = spark.createDataFrame(
        [(b, m, float(b * 10 + k)) for b in range(6) for k, m in enumerate("abc")],
        "block int, model string, score double",
    )
    got = {(x["a"], x["b"]): x for x in stats.conover_pairs(df, "block", "model", "score").collect()}
    assert got["a", "c"]["rank_difference"] == 2.0 and got["a", "c"]["p_holm"] == 0.0
    assert stats.conover_pairs(df.filter("block = 0"), "block", "model", "score").count() == 0


def test_smooth_curve_reproduces_a_line(spark):
    rows = [(i / 10, 3 - 0.5 * i / 10) for i in range(500)] + [(None, 1.0), (math.nan, 2.0)]
    got = stats.smooth_curve(spark.createDataFrame(rows, "x double, y double"), "x", "y", fraction=0.2, points=10).collect()
    assert len(got) == 10
    for x in got:
        assert x["y"] == pytest.approx(3 - 0.5 * x["x"], abs=1e-6)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert {x["y"] for x in stats.smooth_curve(flat, "x", "y", points=2).collect()} == {3.0}


def test_support_vectors_match_gradient_descent(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + 0.5 + r.normal(size=200) * 0.2
    df = spark.createDataFrame(
        [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)],
        "a double, b double, y double",
    )
    got = models.linear_svr(df, ["a", "b"], ["y"], penalties=(1.0,), epsilon=0.1).collect()[0]
    w, b = np.zeros(2), 0.0
    for _ in range(20_000):
        e = y - x @ w - b
        g = np.sign(e) * np.maximum(np.abs(e) - 0.1, 0)
        w -= 0.05 * (w - 2 * x.T @ g / 200)
        b += 0.05 * 2 * g.mean()
    assert got["n"] == 200
    assert np.allclose(got["coefs"], w, atol=1e-4) and got["intercept"] == pytest.approx(b, abs=1e-4)
