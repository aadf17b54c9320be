from __future__ import annotations

from terrasieve.operators import effects, peaks, rank, stats
from terrasieve.plans.joins import join_same


def test_null_keys_are_keys(spark):
    a = spark.createDataFrame([(None, 1, "x"), ("a", None, "y"), ("b", 2, "z")], "g string, h int, v string")
    b = spark.createDataFrame([(None, 1, 10), ("a", None, 20), ("c", 3, 30)], "g string, h int, w int")
    assert sorted((r["v"], r["w"]) for r in join_same(a, b, ["g", "h"]).collect()) == [("x", 10), ("y", 20)]
    assert join_same(a, b, ["g", "h"], "left").columns == ["g", "h", "v", "w"]
    assert [r["v"] for r in join_same(a, b, ["g", "h"], "left_anti").collect()] == ["z"]
    assert join_same(a, b.limit(1).select("w"), []).count() == 3


def test_groups_of_null_are_kept(spark):
    rows = [(None, f"a{i}", float(i)) for i in range(5)] + [("k", "b", 1.0), ("k", "c", 3.0)]
    df = spark.createDataFrame(rows, "g string, a string, d double")
    assert {r["g"]: r["median_delta"] for r in effects.variant_overlap(df, ["g"], "a", "d", 7).collect()} == {None: 2.0, "k": 2.0}
    assert {r["g"]: r["largest_key"] for r in effects.effect_magnitude(df, ["g"], "d", "a").collect()} == {None: "a4", "k": "c"}
    assert {r["g"]: r["n"] for r in stats.score_summary(df, ["g"], "d").collect()} == {None: 5, "k": 2}
    assert {r["g"] for r in rank.weight_mass(df, ["g"], "d").collect()} == {None, "k"}
    assert {r["g"] for r in peaks.series_zscore(df, ["g"], "d").collect()} == {None, "k"}
    assert {
        r["g"]: round(r["spearman"], 9) for r in stats.prediction_metrics(
            df.withColumn("p", df["d"] * 2),
            ["g"],
            "d",
            "p",
        ).collect()
    } == {None: 1.0, "k": 1.0}
