from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.functions.values import as_number
from terrasieve.operators import clean, stats


def test_value_columns_and_required(spark):
    df = spark.createDataFrame([(1, 2, 0.5, 0.1, "x")], "iid long, FID long, a double, a_uncertainty double, s string")
    assert clean.value_columns(df) == ["a"]
    with pytest.raises(ValueError, match="missing columns: q"):
        clean.require_columns(df, ["a", "q"])
    assert clean.plain_names(spark.createDataFrame([(1, 2, 3)], "x_soil int, y int, y_soil int")).columns == ["x", "y", "y_soil"]


def test_missing_values_and_places(spark):
    rows = [(1, 1.0, 2.0), (2, math.nan, 2.0), (3, None, 2.0), (4, -3.4e38, 2.0), (5, -9.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, long double, lat double")
    assert [r["id"] for r in clean.complete_rows(df, ["long"]).collect()] == [1, 5]
    assert [r["id"] for r in clean.with_place(df).collect()] == [1]
    assert [r["id"] for r in clean.in_box(df, "long", "lat", (1.0, 1.0, 2.0, 2.0)).collect()] == [1]


def test_ids_match_as_text_and_nulls_stay_out(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "iid long")
    ids = spark.createDataFrame([("1",), (None,)], "iid string")
    assert [r[0] for r in clean.keep_ids(df, ids, "iid").collect()] == [1]
    assert {r[0] for r in clean.drop_ids(df, ids, "iid").collect()} == {2, None}


def test_merge_suffixes_and_falls_back(spark):
    a = spark.createDataFrame([(1, 1, 0.5, 0.5, 7)], "fid int, iid int, long double, lat double, v int")
    b = spark.createDataFrame([(1, 1, 0.5, 0.5, 8)], "fid int, iid int, long double, lat double, v int")
    assert clean.merge_tables(a, b).collect()[0]["v_right"] == 8
    assert clean.merge_tables(a, b.withColumn("lat", F.lit(9.0)), least=1).collect()[0]["v_right"] is None


def test_relabel_merges_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string")
    out = df.select(clean.relabel(F.col("x"), {"a": "A", "b": None}).alias("y"))
    assert [r["y"] for r in out.collect()] == ["A", None, "c", None]


def test_identifiers_written_in_several_ways(spark):
    df = spark.createDataFrame([(x,) for x in (" 12", "0012", "12.0", "12\t", "+12", "x", "", None, "12.5", "1e3")], "s string")
    assert [r[0] for r in df.select(as_number("s")).collect()] == [12, 12, 12, 12, 12, None, None, None, None, None]


def test_genotypes(spark):
    df = spark.createDataFrame([(1, [0, 0, 2, 3]), (2, [3, 3]), (3, [1, 1, 2, 2]), (4, [])], "site int, gt array<int>")
    rows = {
        r["site"]: r for r in df.select(
            "site",
            clean.missing_share(F.col("gt")).alias("m"),
            clean.mode_call(F.col("gt")).alias("mode"),
            clean.impute_mode(F.col("gt")).alias("i"),
            clean.allele_frequency(F.col("gt")).alias("p"),
        ).collect()
    }
    assert rows[1]["m"] == 0.25 and rows[1]["i"] == [0, 0, 2, 0]
    assert rows[2]["mode"] is None and rows[2]["i"] == [None, None]
    assert rows[3]["mode"] == 1 and rows[3]["p"] == 0.75
    assert rows[4]["m"] is None
    assert [r["site"] for r in clean.genotype_qc(df, 0.3, 0.2).collect()] == [1, 3]


def test_scaling_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    for method in ("zscore", "zscore0", "minmax", "robust"):
        got = stats.scale(df, ["a", "b"], method).collect()
        assert got[2]["a"] is None
        assert {r["b"] for r in got} == {0.0}
    assert [r["a"] for r in stats.scale(df, ["a"], "none").collect()] == [1.0, 3.0, None]
    with pytest.raises(ValueError, match="method"):
        stats.scale(df, ["a"], "other")


def test_cluster_names():
    assert stats.cluster_name(["BIO11", "BIO6"]) == "bio_11_6"
    assert stats.cluster_name([f"bio{i}" for i in (12, 13, 16, 17)]) == "bio_12_to_17"


def test_average_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), (None, 2.0)], "g string, v double")
    got = sorted(((r["g"] or "", r["v"] or 0, r["rank"]) for r in stats.average_rank(df, "v", ["g"]).collect()), key=str)
    assert got == sorted([("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 3.0, 3.0), ("a", 0, None), ("", 2.0, 1.0)], key=str)


def test_metrics_of_constant_truth(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", None, 9.0)],
        "g string, y double, p double",
    )
    got = {r["g"]: r for r in stats.prediction_metrics(df, ["g"], "y", "p").collect()}
    assert got["a"]["r2"] is None and got["a"]["spearman"] is None and got["a"]["mse"] == 2.5
    assert got["b"]["r2"] == 1.0 and got["b"]["n"] == 2


def test_tails_against_tables():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_tail(2.2281388519649385, 10) == pytest.approx(0.025, abs=1e-9)
    assert stats.t_tail(1.959963984540054, 1e7) == pytest.approx(0.025, abs=1e-6)
    assert stats.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert stats.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_bootstrap_covers_the_mean(spark):
    r = np.random.default_rng(0)
    values = r.normal(10, 2, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, v double")
    got = stats.bootstrap_mean(df, "k", "v", reps=300).collect()[0]
    se = values.std() / 20
    assert got["low"] < values.mean() < got["high"]
    assert got["high"] - got["low"] == pytest.approx(2 * 1.96 * se, rel=0.25)


def test_friedman_textbook(spark):
    # three judges of four wines; ranks 1..4 with one tie
    scores = {"a": (9, 8, 9), "b": (7, 7, 8), "c": (5, 6, 6), "d": (5, 4, 3)}
    rows = [(i, m, float(v)) for m, vs in scores.items() for i, v in enumerate(vs)] + [(9, "a", 1.0)]
    got = {
        r["model"]: r for r in stats.friedman(
            spark.createDataFrame(rows, "block int, model string, score double"),
            "block",
            "model",
            "score",
        ).collect()
    }
    assert got["a"]["mean_rank"] == 1.0 and got["a"]["n_blocks"] == 3
    assert got["a"]["chi2"] == pytest.approx(8.7931, abs=1e-3)
    assert 0.02 < got["a"]["p"] < 0.05


def test_small_series(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.75), (3, 0.9)], "k int, a double")
    assert [round(r["change"], 4) for r in stats.relative_change(df, "k", "a").collect()] == [0.5, 0.5, 0.2]
    assert stats.smallest_reaching(df, "k", "a", 0.5).collect()[0]["k"] == 2
    assert stats.smallest_reaching(df.limit(0), "k", "a", 0.5).collect()[0]["k"] is None
    assert stats.correlation_pairs(df, ["a"]).count() == 0


def test_bootstrap_of_r2_holds_the_plain_value(spark):
    rows = [(i, float(i % 17), i % 17 + ((i * 7) % 11 - 5) / 2.0) for i in range(400)] + [(400, None, 1.0)]
    r = stats.bootstrap_r2(spark.createDataFrame(rows, "id int, y double, p double"), "id", "y", "p").collect()[0]
    y, e = [a for _, a, _ in rows[:400]], [a - b for _, a, b in rows[:400]]
    mean = sum(y) / 400
    assert r["n"] == 400
    assert abs(r["r2"] - (1 - sum(x * x for x in e) / sum((a - mean) ** 2 for a in y))) < 1e-9
    assert r["r2"] - 0.05 < r["low"] < r["r2"] < r["high"] < r["r2"] + 0.05
