from __future__ import annotations

import itertools
import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasieve.operators import cluster, effects, graph, intervals, peaks, rank


def test_best_effect_ties_direction_and_missing(spark):
    df = spark.createDataFrame(
        [("a", 2, 1.0), ("a", 1, 1.0), ("a", 3, math.nan), ("a", 4, None), ("b", 1, -2.0)],
        "g string, i int, d double",
    )
    assert {(r["g"], r["i"]) for r in rank.best_effect(df, ["g"], "d", ["i"]).collect()} == {("a", 1), ("b", 1)}
    wanted, other = rank.split_by_direction(rank.best_effect(df, ["g"], "d", ["i"]), "d")
    assert [r["g"] for r in wanted.collect()] == ["a"] and [r["g"] for r in other.collect()] == ["b"]
    assert rank.best_effect(df, ["g"], "d", ["i"], "negative", compat=True).filter("g = 'a'").collect()[0]["i"] == 1


def test_weight_mass(spark):
    df = spark.createDataFrame(
        [
            ("a", 4.0),
            ("a", -3.0),
            ("a", 2.0),
            ("a", 1.0),
            ("z", 0.0),
            ("z", None),
            ("t", 1.0),
            ("t", 1.0),
            ("t", -1.0),
            ("t", 1.0),
        ],
        "v string, w double",
    )
    got = {r["v"]: (r["n_50"], r["n_80"]) for r in rank.weight_mass(df, ["v"], "w").collect()}
    assert got == {"a": (2, 3), "z": (0, 0), "t": (2, 4)}


def test_cumulative_is_first_per_site_and_sums(spark):
    rows = [("a", 1, 10, 0.5), ("a", 1, 11, 0.7), ("a", 2, 12, 0.6), ("a", 3, 13, -1.0), ("b", 1, 10, -0.1)]
    df = spark.createDataFrame(rows, "acc string, site int, pos int, d double")
    steps = effects.cumulative_effects(df, "acc", "site", "d", ["pos"])
    assert [
        (r["site"], r["pos"], r["step"], round(r["cumulative_delta"], 6)) for r in steps.orderBy("step").collect()
    ] == [(1, 11, 1, 0.7), (2, 12, 2, 1.3)]
    every = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "acc string, base double")
    got = {
        (r["top_n"], r["acc"]): (r["n_steps"], round(r["final_pred"], 6)) for r in effects.scenarios(
            steps,
            every,
            "acc",
            "d",
            [1, 0],
            "base",
        ).collect()
    }
    assert got == {(1, "a"): (1, 1.7), (0, "a"): (2, 2.3), (1, "b"): (0, 2.0), (0, "b"): (0, 2.0)}


def test_overlap_lists_fifty(spark):
    df = spark.createDataFrame([(1, f"{i:03d}", float(i)) for i in range(60)] + [(2, "x", 1.0)], "v int, a string, d double")
    got = {r["v"]: r for r in effects.variant_overlap(df, ["v"], "a", "d", 60).collect()}
    assert got[1]["accession_ids"].endswith(";049;...") and got[1]["n_accessions"] == 60 and got[1]["accession_fraction"] == 1.0
    assert got[2]["accession_ids"] == "x"


def test_deltas_equal_predicting_twice(spark):
    coefs = spark.createDataFrame(
        [("v", i, c, s) for i, (c, s) in enumerate([(1.0, 2.0), (3.0, 0.0), (-1.0, 1.0), (0.5, 0.5)])],
        "variable string, feature_index int, coef double, scale double",
    )
    w = effects.coefficient_rows(coefs, 2)
    base = spark.createDataFrame([("a", 1, [1.0, 1.0])], "accession string, snp_index int, old_row array<double>")
    new = spark.createDataFrame(
        [("a", 1, "x", [2.0, 3.0]), ("a", 1, "nan", [math.nan, 0.0])],
        "accession string, snp_index int, tag string, new_row array<double>",
    )
    got = effects.mutation_deltas(new, base, w).collect()
    assert [(r["tag"], r["delta"]) for r in got] == [("x", -1.0 * 1 + 1.0 * 2)]


def test_extremes_of_a_small_table_overlap(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    assert rank.extremes(df, "k", "v", 2).count() == 4


def test_greedy_peaks_separation_and_constant_series(spark):
    rows = [
        ("s", i, 10.0 if i == 20 else 9.5 if i == 22 else 9.0 if i == 40 else 0.1 * (i % 3)) for i in range(60)
    ] + [("c", i, 1.0) for i in range(5)]
    got = peaks.greedy_peaks(spark.createDataFrame(rows, "g string, p int, v double"), ["g"], "p", "v", window=10).collect()
    assert sorted((r["g"], r["peak_index"], r["p"]) for r in got) == [("s", 0, 20), ("s", 1, 40)]


def test_windows_at_the_edges(spark):
    df = spark.createDataFrame([(0, 100), (50, 100), (99, 100), (3, 5)], "c int, n int")
    first, last = peaks.shifted_window(F.col("c"), F.col("n"), 11)
    assert [(r[0], r[1]) for r in df.select(first, last).collect()] == [(0, 11), (45, 56), (89, 100), (0, 5)]
    s = spark.createDataFrame([("ACGTACGT", 0), ("ACGTACGT", 7), ("", 0)], "s string, c int")
    assert [r[0] for r in s.select(peaks.clipped_slice(F.col("s"), F.col("c"), 2)).collect()] == ["ACG", "CGT", ""]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=40), st.integers(1, 60))
def test_spacing_property(spark, positions, w):
    df = spark.createDataFrame([("c", p) for p in positions], "g string, p long")
    kept = sorted(r["p"] for r in intervals.spaced_positions(df, ["g"], "p", w).collect())
    assert kept[0] == min(positions)
    assert all(b - a >= w for a, b in zip(kept, kept[1:], strict=False))
    assert all(any(0 <= p - k < w for k in kept) for p in positions)


def test_merging_stops_at_the_cap(spark):
    df = spark.createDataFrame([("c", p) for p in (0, 100, 200, 300, 5000)], "g string, p long")
    got = sorted((r["start"], r["end"], r["n"]) for r in intervals.merged_windows(df, ["g"], "p", 100, longest=300).collect())
    assert got == [(-50, 250, 3), (250, 350, 1), (4950, 5050, 1)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=60), st.sampled_from([4, 20]), st.sampled_from([10, 60, 200]))
def test_merging_matches_a_loop(spark, positions, width, longest):
    half, want = width // 2, []
    for p in sorted(set(positions)):
        if want and p - half <= want[-1][1] + half and p + half - want[-1][0] <= longest:
            want[-1] = (want[-1][0], p + half, want[-1][2] + 1)
        else:
            want.append((p - half, p + half, 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([("c", p) for p in positions], "g string, p long")
        got = sorted(
            (r["start"], r["end"], r["n"]) for r in intervals.merged_windows(df, ["g"], "p", width, longest=longest).collect()
        )
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert got == sorted(want)


def test_tiles_cover_every_point_once(spark):
    pts = [(x * 1.3, y * 0.9) for x in range(12) for y in range(9)]
    got = intervals.greedy_tiles(spark.createDataFrame(pts, "x double, y double"), "x", "y", 3.8).collect()
    assert sum(r["n"] for r in got) == len(pts)


def test_tiles_start_at_the_first_value_not_covered(spark):
    r = random.Random(3)
    pts = [(i, round(r.uniform(-20, 20), 2), round(r.uniform(-9, 9), 2)) for i in range(150)]

    def starts(values):
        out = []
        for v in sorted(values):
            if not out or v > out[-1] + 3.8:
                out.append(v)
        return out

    want = set()
    for tx in starts({x for _, x, _ in pts}):
        column = [p for p in pts if tx <= p[1] <= tx + 3.8]
        for ty in starts({y for _, _, y in column}):
            want |= {(tx, ty, i) for i, _, y in column if ty <= y <= ty + 3.8}
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = intervals.tile_members(df, ["id"], "x", "y", 3.8).select("tile_x", "tile_y", "id").collect()
    assert len(got) == len(want)
    assert {tuple(g) for g in got} == want
    tiles = {(t["tile_x"], t["tile_y"]): t["n"] for t in intervals.greedy_tiles(df, "x", "y", 3.8).collect()}
    assert tiles == {t: sum(w[:2] == t for w in want) for t in {w[:2] for w in want}}


def test_agreement_counts_every_pair_of_records(spark):
    df = spark.createDataFrame([(i,) for i in range(300)], "id int")
    label = lambda k, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int")
    got = cluster.consensus_agreement(df, "id", [], (2, 3), runs=3, labels=lambda d, c, k, seed: d.withColumn("cluster", label(k, seed)))
    want = Counter()
    for k in (2, 3):
        runs = [F.when(cluster.in_sample("id", r, 0.5), label(k, r)) for r in range(3)]
        rows = [tuple(row) for row in df.select(*runs).collect()]
        for a, b in itertools.combinations(rows, 2):
            both = [x == y for x, y in zip(a, b, strict=True) if x is not None and y is not None]
            want[k, min(19, int(sum(both) / max(len(both), 1) * 20))] += 1
    assert {(r["k"], r["bin"]): r["pairs"] for r in got.collect()} == want


def test_components_and_representatives(spark):
    edges = spark.createDataFrame(
        [("a", "b", 0.1), ("b", "c", 0.2), ("x", "y", 0.5), ("q", "q", 0.1)],
        "a string, b string, q double",
    )
    links = graph.similar_edges(edges, "a", "b", "q", 0.6)
    nodes = spark.createDataFrame([(n,) for n in "abcxyqz"], "node string")
    comp = graph.connected_components(nodes, links)
    assert {r["node"]: r["component"] for r in comp.collect()} == dict(a="a", b="a", c="a", x="x", y="x", q="q", z="z")
    rep = {r["component"]: (r["node"], round(r["distance"], 6)) for r in graph.representatives(comp, links).collect()}
    assert rep["a"] == ("b", 0.3) and rep["x"] == ("x", 0.5) and rep["z"] == ("z", 0.0)


def test_long_chain_converges(spark):
    n = 150
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    comp = graph.connected_components(spark.range(n + 1).toDF("node"), edges)
    assert comp.filter("component <> 0").count() == 0


def test_support_modes(spark):
    df = spark.createDataFrame([("m", 1), ("m", 2), ("m", 2), ("k", 1), ("k", 2), ("k", 3), ("j", 4)], "item string, run int")
    names = lambda **k: {r["item"] for r in graph.supported(df, "item", "run", 4, **k).collect()}
    assert names(how="any") == {"m", "k", "j"} and names() == {"k"} and names(how="all") == set() and names(least=2) == {"m", "k"}
