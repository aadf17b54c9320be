from __future__ import annotations

import math
import random

import pytest

from terrasieve.operators.profile import load_issues, profile

SCHEMA = "load_no int, iid long, x double, y double"


def loads(change):
    r = random.Random(5)
    rows = []
    for load in (1, 2, 3):
        for i in range(600):
            x, y = r.gauss(0, 2), r.gauss(5, 1)
            rows.append((load, i, *change(load, i, x, y)))
    return rows


def issues(spark, change, **kw):
    df = spark.createDataFrame(loads(change), SCHEMA)
    p = profile(df, "load_no", ["x", "y"], valid={"x": (-50, 50), "y": (-50, 50)})
    return {tuple(r) for r in load_issues(p, max_shift=1.5, **kw).collect()}


def test_sound_loads_have_no_issue(spark):
    assert issues(spark, lambda load, i, x, y: (x, y)) == set()


def test_each_issue_is_named(spark):
    def change(load, i, x, y):
        if load == 2:
            return (None if i % 5 == 0 else math.nan if i % 5 == 1 else x), (y if i else 900.0)
        if load == 3:
            return x + 3, (5.0 if i % 3 == 0 else y * 1.0)
        return x, y

    assert issues(spark, change) == {("x", 2, "missing"), ("y", 2, "impossible"), ("x", 3, "shifted"), ("y", 3, "stuck")}


def test_rescaled_needs_both_aggregate_and_classifier(spark):
    change = lambda load, i, x, y: (x * (3 if load == 2 else 1), y)
    assert issues(spark, change) == {("x", 2, "rescaled")}
    assert issues(spark, change, min_discrimination=0.5) == set()


def test_classifier_points_at_the_column(spark):
    df = spark.createDataFrame(loads(lambda load, i, x, y: (x + (4 if load == 3 else 0), y)), SCHEMA)
    got = {(r["col"], r["load_no"]): r for r in profile(df, "load_no", ["x", "y"]).collect()}
    assert got["x", 3]["auc_alone"] > 0.8
    assert got["x", 3]["auc"] - got["x", 3]["auc_without"] > 0.3
    assert abs(got["y", 3]["auc_alone"] - 0.5) < 0.07
    assert abs(got["x", 2]["auc"] - 0.5) < 0.07


def test_exact_aggregates(spark):
    rows = [(1, 1, 1.0, None), (1, 2, 2.0, None), (1, 2, 2.0, None), (1, 3, -1e31, None), (None, 4, 7.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as col", "9 as value", "8 as n")
    got = {(r["col"], r["load_no"]): r for r in profile(df, "load_no", ["x", "y"], valid={"x": (0, 1.5)}).collect()}
    r = got["x", 1]
    assert (
        r["n_rows"],
        r["n_missing"],
        r["n_distinct"],
        r["min_value"],
        r["max_value"],
        r["n_violations"],
    ) == (4, 1, 2, 1.0, 2.0, 2)
    assert r["top_share"] == pytest.approx(2 / 3)
    assert r["median"] == 2.0
    assert r["auc"] is None
    assert got["y", 1]["median"] is None
    assert got["x", None]["n_rows"] == 1


def test_empty_table_and_lone_load(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert profile(df, "load_no", ["x"]).collect() == []
    one = spark.createDataFrame([(1, i, 3.0, 1.0) for i in range(10)], SCHEMA)
    assert {tuple(r) for r in load_issues(profile(one, "load_no", ["x"])).collect()} == {("x", 1, "stuck")}


def test_value_stuck_in_every_load_is_found_in_every_load(spark):
    found = issues(spark, lambda load, i, x, y: (1.5 if i % 3 == 0 else x, y))
    assert found == {("x", load, "stuck") for load in (1, 2, 3)}


def shapes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    p = profile(df, "load_no", ["x", "y"])
    named = {tuple(r) for r in load_issues(p, max_shift=1.5).collect()}
    every = {tuple(r) for r in load_issues(p, max_shift=1.5, other=True).collect()}
    return named, every, {(r["col"], r["load_no"]): r for r in p.collect()}


def test_changed_shape_with_the_same_quartiles_is_raised(spark):
    r = random.Random(8)
    even = [i / 1000 for i in range(1000)]
    quarters = [0.25 * (i % 4) + 0.25 * (0.5 + 0.5 * (2 * r.random() - 1) ** 7) for i in range(1000)]  # heaped inside each quarter
    rows = [(1, i, x, r.gauss(0, 1)) for i, x in enumerate(even)] + [(2, i, x, r.gauss(0, 1)) for i, x in enumerate(quarters)]
    named, every, got = shapes(spark, rows)
    assert named == set() and every == {("x", 2, "changed")}
    assert abs(got["x", 2]["median"] - got["x", 1]["median"]) < 0.05 and abs(got["x", 2]["iqr"] - got["x", 1]["iqr"]) < 0.05


def test_threshold_crossed_by_chance_in_a_tiny_load_is_not_raised(spark):
    r = random.Random(9)
    rows = [(1, i, r.gauss(0, 3), r.gauss(0, 1)) for i in range(800)] + [(2, i, x, 0.1 * i - 0.2) for i, x in enumerate([1.9, 2.4, 3.0, -2.0, 1.7])]
    named, _, got = shapes(spark, rows)
    assert abs(got["x", 2]["median"] - got["x", 1]["median"]) > 1.5
    assert ("x", 2, "shifted") not in named and ("y", 2, "shifted") not in named


def test_one_step_ablation_agrees_with_a_refit(spark):
    df = spark.createDataFrame(loads(lambda load, i, x, y: (x + (1 if load == 3 else 0), y + 0.4 * x + (1 if load == 3 else 0))), SCHEMA)
    got = {(r["col"], r["load_no"]): r for r in profile(df, "load_no", ["x", "y"]).collect()}
    for c, other in (("x", "y"), ("y", "x")):
        assert abs(got[c, 3]["auc_without"] - got[other, 3]["auc_alone"]) < 0.03
    assert all(got[c, k]["converged"] for c in "xy" for k in (2, 3))
