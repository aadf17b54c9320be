from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terrasieve.operators.stats import quantiles
from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch, shared_folder

SCHEMA = "g string, h int, v double, w long"


def rows_of(seed: int, n: int):
    r = random.Random(seed)
    # one group holds a third of all rows; nulls are groups of their own
    return [
        (
            r.choice(["hot"] * 4 + ["a", "b", "c", None, "d", "e", "f", "g"]),
            r.choice([1, 1, 1, 2, None]),
            r.random(),
            r.randint(1, 9),
        ) for _ in range(n)
    ]


@pytest.mark.parametrize(("seed", "n", "parts", "batch"), [(1, 500, 7, 10), (2, 3, 5, 10), (3, 400, 1, 7), (4, 200, 40, 1000)])
def test_positions_are_exact(spark, seed, n, parts, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = rows_of(seed, n)
        df = spark.createDataFrame(data, SCHEMA)
        got = global_positions(df, ["g", "h"], [F.col("v").desc()], Scratch(spark, "t"), "p").collect()
        weighted = global_positions(df, ["g", "h"], [F.col("v").desc()], Scratch(spark, "t"), "w", weight="w").collect()
        kept = global_positions(df, ["g", "h"], [F.col("v").desc()], Scratch(spark, "t"), "k", keep=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(list)
    for row in data:
        groups[row[:2]].append(row)
    want, want_w = {}, {}
    for rows in groups.values():
        rows.sort(key=lambda x: -x[2])
        for i, row in enumerate(rows):
            want[row] = i
            want_w[row] = sum(x[3] for x in rows[:i])
    assert {tuple(r)[:4]: r["position"] for r in got} == want
    assert {tuple(r)[:4]: r["position"] for r in weighted} == want_w
    assert {tuple(r)[:4]: r["position"] for r in kept} == {k: v for k, v in want.items() if v < 3}


def test_no_group_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, 0.5, 2), ("a", 1, 0.1, 3)], SCHEMA)
    got = global_positions(df, [], [F.col("v")], Scratch(spark, "t"), "p", weight="w", as_="at").collect()
    assert [(r["v"], r["at"]) for r in sorted(got, key=lambda r: r["v"])] == [(0.1, 0), (0.5, 3)]
    assert global_positions(df.limit(0), ["g"], [F.col("v")], Scratch(spark, "t"), "e").collect() == []


def test_quantiles_match_linear_interpolation(spark):
    import numpy as np

    data = [("a", float(i % 17)) for i in range(100)] + [("b", 4.0), ("c", None), ("c", float("nan"))]
    got = {
        r["g"]: (r["q_0"], r["q_1"]) for r in quantiles(
            spark.createDataFrame(data, "g string, x double"),
            ["g"],
            "x",
            (0.25, 0.9),
        ).collect()
    }
    a = [v for g, v in data if g == "a"]
    assert got["a"] == pytest.approx((np.quantile(a, 0.25), np.quantile(a, 0.9)))
    assert got["b"] == (4.0, 4.0)
    assert "c" not in got


def test_scratch_is_the_sessions_folder(spark):
    folder = shared_folder(spark)
    s = Scratch(spark, "x")
    t = s.write(spark.range(3).toDF("a"), "one")
    assert s.root.startswith(folder)
    assert t.count() == 3
    s.drop("one")
