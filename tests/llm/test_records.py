"""Problems 1, 2, 4 and 5 against brute force on small tables, with nulls, ties, copies, hot groups and empty tables."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.llm import accessions, overlap, splits
from terrasieve.llm.clusters import describe_clusters, grid_clusters
from terrasieve.llm.fmindex import SEPARATOR, FMIndex, id_symbols, place_symbols
from terrasieve.llm.gridlinks import FLOAT_SLACK, cell_links, with_cells
from terrasieve.llm.topn import top_n_per_group
from terrasieve.plans.scratch import Scratch

TOL = 0.002


def near(a, b, tol=TOL):
    return abs(a[0] - b[0]) <= tol + FLOAT_SLACK and abs(a[1] - b[1]) <= tol + FLOAT_SLACK


def cloud(seed, n, spread=0.02):
    r = random.Random(seed)
    return [(round(r.uniform(0, spread), 5), round(r.uniform(0, spread), 5)) for _ in range(n)]


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Index


def test_index_finds_exactly_the_equal_records_and_maximal_matches():
    r = np.random.default_rng(1)
    ids = r.integers(0, 50, 200)
    cx, cy = r.integers(0, 9, 120), r.integers(0, 9, 120)
    index = FMIndex.load(FMIndex.build([id_symbols(ids), place_symbols(cx, cy)]).dump())
    wanted = np.arange(60)
    p = np.concatenate([np.full((60, 1), SEPARATOR, np.uint8), id_symbols(wanted)], axis=1)
    low, high, length = index.search(p, step=7)
    full = length == p.shape[1]
    at, record = index.records_of(low[full], high[full])
    got = defaultdict(set)
    for a, b in zip(wanted[full][at], record, strict=True):
        got[int(a)].add(int(b))
    assert got == {int(v): set(np.flatnonzero(ids == v)) for v in set(ids)}
    q = place_symbols(np.array([cx[0], 2**20 - 1]), np.array([cy[0], 2**20 - 1]))
    _, _, n = index.search(q)
    assert n[0] == q.shape[1] and 1 <= n[1] < q.shape[1]


def test_empty_index():
    index = FMIndex.build([id_symbols(np.zeros(0, np.int64))])
    assert index.search(id_symbols(np.array([5])))[2][0] == 0


# Overlaps


@pytest.mark.parametrize("bounds", [(50_000, 100_000), (7, 5)])
def test_overlaps_match_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(overlap, "SHARD_ROWS", bounds[0])
    monkeypatch.setattr(overlap, "CHUNK_ROWS", bounds[1])
    pts = cloud(3, 90) + [(0.004, 0.004)] * 30 + [(-0.0019, -0.0001), (0.0, 0.0), (179.9999, 89.9999), (-180.0, -90.0)]
    r = random.Random(4)
    people = [(i, *p) for i, p in enumerate(pts)] + [(500, None, None), (501, None, None), (-3, 0.001, 0.001)]
    listed = [
        (i, r.choice(["train", "train", "val", "test"])) for i, *_ in people for _ in range(r.choice([1, 1, 2]))
    ] + [(999, "train"), (None, "val"), (501, None)]
    df = spark.createDataFrame(people, "iid long, x double, y double")
    ls = spark.createDataFrame(listed, "iid long, split string")
    got = {tuple(x) for x in overlap.cross_split_overlaps(df, ls, "iid", "x", "y", TOL).collect()}
    where = {i: (x, y) for i, x, y in people}
    want = set()
    for a, sa in listed:
        for b, sb in listed:
            if sa == "train" and sb in ("val", "test") and a in where and b in where:
                p, q = where[a], where[b]
                if a == b or (p[0] is not None and q[0] is not None and near(p, q)):
                    want.add((min(a, b), max(a, b), sb))
    assert got == want and len(want) > 100


def test_links_count_what_overlaps_lists(spark):
    r = random.Random(31)
    pts = cloud(31, 60) + [(1.0, 1.0)] * 25 + [(None, None)] * 5
    rows = [(i, *p) for i, p in enumerate(pts)]
    listed = [(i, s) for i in range(len(pts)) for s in r.sample(["train", "val", "test"], r.randint(1, 2))]
    df = spark.createDataFrame(rows, "iid long, x double, y double").selectExpr("*", "1 as n", "'a' as split", "2 as place_key")
    ls = spark.createDataFrame(listed, "iid long, split string")
    members = defaultdict(set)
    for i, s in listed:
        members[s].add(i)
    want = {}
    for i in members["train"]:
        for s in ("val", "test"):
            n = sum(j == i or (None not in pts[i] and None not in pts[j] and near(pts[i], pts[j])) for j in members[s])
            if n:
                same = [j for j in members["train"] if pts[j] == pts[i]] if None not in pts[i] else [i]
                want[i, s] = (min(same), n)
    got = {(x["iid"], x["split"]): (x["place_key"], x["n_links"]) for x in overlap.cross_split_links(df, ls, "iid", "x", "y", TOL).collect()}
    assert got == want and max(n for _, n in want.values()) > 8
    assert overlap.cross_split_links(df.limit(0), ls, "iid", "x", "y", TOL).collect() == []


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "iid long, x double, y double")
    ls = spark.createDataFrame([(1, "train")], "iid long, split string")
    assert overlap.cross_split_overlaps(df, ls, "iid", "x", "y", TOL).collect() == []
    one = spark.createDataFrame([(1, 0.0, 0.0)], "iid long, x double, y double")
    assert overlap.cross_split_overlaps(one, ls, "iid", "x", "y", TOL).collect() == []


def test_accessions_are_cleaned(spark):
    rows = [
        (1, 5, 1.0, 2.0),
        (1, 5, None, None),
        (2, 0, -9.0, 3.0),
        (3, -9, math.nan, 1.0),
        (4, None, 200.0, 1.0),
        (5, 7, 180.0, 90.0),
        (None, 1, 1.0, 1.0),
    ]
    df = spark.createDataFrame(
        rows,
        "iid long, fid long, long double, lat double",
    ).withColumn("x", F.lit("clash")).withColumn("y", F.lit(1))
    got = {r["iid"]: (r["x"], r["y"], r["fid"]) for r in accessions.accessions(df).collect()}
    assert got == {1: (1.0, 2.0, 5), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None), 5: (180.0, 90.0, 7)}
    s = spark.createDataFrame(
        [(" 07", "TRAIN "), ("7.0", "training"), ("8", "Validation"), ("9", "?"), (None, "test")],
        "iid string, split string",
    )
    assert sorted(map(tuple, accessions.listed_splits(s).collect())) == [(7, "train"), (8, "val")]


# Top N


def test_top_n_matches_sorting_with_a_hot_group(spark):
    r = random.Random(8)
    rows = [
        (
            r.choice(["hot", "hot", "a", "b", None]),
            r.choice([1, 1, 2]),
            round(r.random(), 2) if r.random() > 0.1 else r.choice([None, math.nan]),
            r.randint(1, 400),
            r.choice([1, 2, None]),
        ) for _ in range(900)
    ]
    rows += rows[:200]  # copies
    df = spark.createDataFrame(rows, "g string, h int, s double, t int, u int").selectExpr(
        "*",
        "'z' as score",
        "'z' as rank",
        "1 as position",
    )
    got = {tuple(x) for x in top_n_per_group(df, ["g", "h"], F.col("s"), ["t", "u"], 4).collect()}
    groups = defaultdict(set)
    for g, h, s, t, u in rows:
        if s is not None and not math.isnan(s):
            groups[g, h].add((-s, t, u is not None, u or 0))
    want = {
        (
            g,
            h,
            t,
            (u if known else None),
            -s,
            i + 1,
        ) for (g, h), items in groups.items() for i, (s, t, known, u) in enumerate(sorted(items)[:4])
    }
    assert got == want
    assert top_n_per_group(df.limit(0), ["g"], F.col("s"), ["t"], 4).collect() == []


# Grid links, components, splits


@pytest.mark.parametrize("seed", range(4))
def test_cell_links_match_brute_force(spark, seed):
    pts = cloud(seed, 120, 0.025) + [(0.0, 0.0), (0.002, 0.002), (0.004, 0.0), (0.004, 0.004)]
    df = with_cells(spark.createDataFrame(pts, "x double, y double"), "x", "y", TOL)
    got = {frozenset([(r["ax"], r["ay"]), (r["bx"], r["by"])]) for r in cell_links(df, TOL).collect()}
    w = TOL + FLOAT_SLACK
    cell = lambda p: (math.floor(p[0] / w), math.floor(p[1] / w))
    want = {frozenset([cell(a), cell(b)]) for a in pts for b in pts if cell(a) != cell(b) and near(a, b)}
    assert got == want


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_random_mates_find_components(spark, shape):
    r = random.Random(2)
    edges = {
        "random": [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)],
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(7, i) for i in range(150)],
        "none": [(3, 3), (None, 4)],
    }[shape]
    got = splits.random_mate_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    real = [(a, b) for a, b in edges if a is not None and a != b]
    by = defaultdict(set)
    for x in got:
        by[x["root"]].add(x["node"])
    want = defaultdict(set)
    for n, root in roots({n for e in real for n in e}, real).items():
        want[root].add(n)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    assert len(got) == len({x["node"] for x in got})


def test_related_groups_by_place_and_value(spark):
    pts = cloud(5, 60, 0.04)
    people = [
        (i, x, y, i % 11 if i % 3 == 0 else None) for i, (x, y) in enumerate(pts)
    ] + [(900, None, None, None), (901, None, None, 3)]
    df = spark.createDataFrame(people, "iid long, x double, y double, fid long")
    scratch = Scratch(spark, "t")
    edges = splits.place_edges(df, "iid", "x", "y", TOL).unionByName(splits.shared_value_edges(df, "iid", "fid"))
    got = {r["iid"]: r["group"] for r in splits.related_groups(df, "iid", edges, scratch).collect()}
    pairs = [
        (a[0], b[0]) for a in people for b in people if (
            a[1] is not None and b[1] is not None and near(a[1:3], b[1:3])
        ) or (a[3] is not None and a[3] == b[3])
    ]
    assert got == roots({p[0] for p in people}, pairs)


def test_split_shares_and_large_groups(spark):
    rows = [(i, 1 + i % 3) for i in range(3000)] + [(9000, 2500), (9001, None)]
    got = splits.assign_splits(spark.createDataFrame(rows, "g long, n long"), "g", "n", Scratch(spark, "t")).collect()
    total = defaultdict(int)
    for r in got:
        total[r["split"]] += r["n"] or 0
    share = {k: v / sum(total.values()) for k, v in total.items()}
    assert len(got) == len(rows) and next(r["split"] for r in got if r["g"] == 9000) == "train"
    assert share["train"] == pytest.approx(0.8, abs=0.01) and share["val"] == pytest.approx(0.1, abs=0.01)
    assert splits.assign_splits(spark.createDataFrame([], "g long, n long"), "g", "n", Scratch(spark, "t")).collect() == []


def test_large_groups_go_to_every_split_and_shares_hold(spark):
    rows = [(10_000 + i, 40) for i in range(60)] + [(i, 1) for i in range(3_000)] + [(None, 1_700)]
    got = splits.assign_splits(spark.createDataFrame(rows, "g long, n long"), "g", "n", Scratch(spark, "t")).collect()
    large, total = defaultdict(int), defaultdict(int)
    for r in got:
        total[r["split"]] += r["n"]
        large[r["split"]] += (r["g"] or 0) >= 10_000
    assert len(got) == len(rows) and min(large[s] for s in ("train", "val", "test")) >= 4
    assert next(r["split"] for r in got if r["g"] is None) == "train"  # a quarter of all rows fits nowhere else
    assert {s: round(n / sum(total.values()), 2) for s, n in total.items()} == {"train": 0.8, "val": 0.1, "test": 0.1}


# Clusters


def test_clusters_match_brute_force(spark):
    pts = cloud(11, 150, 0.06) + [(1.0, 1.0)] * 40
    rows = [(i, *p) for i, p in enumerate(pts)] + [(3, *pts[3]), (700, None, 1.0), (701, math.nan, 1.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "iid long, x double, y double").selectExpr(
        "*",
        "1 as key",
        "2 as cell",
        "3 as cx",
        "4 as label",
        "5 as size",
    )
    got = {r["iid"]: (r["cluster"], r["size"]) for r in grid_clusters(df, "iid", "x", "y", TOL).collect()}
    want = roots(range(len(pts)), [(i, j) for i in range(len(pts)) for j in range(i) if near(pts[i], pts[j])])
    sizes = defaultdict(int)
    for root in want.values():
        sizes[root] += 1
    assert got == {i: (root, sizes[root]) for i, root in want.items()}
    assert grid_clusters(df.limit(0), "iid", "x", "y", TOL).collect() == []


def test_dense_cells_only_and_description(spark):
    rows = [(i, 0.0005, 0.0005) for i in range(5, 12)] + [(1, 0.0021, 0.0005), (2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "iid long, x double, y double")
    members = grid_clusters(df, "iid", "x", "y", TOL, min_cell_rows=3)
    assert {r["iid"] for r in members.collect()} == set(range(5, 12))
    every = describe_clusters(grid_clusters(df, "iid", "x", "y", TOL), "iid").collect()
    assert [(r["cluster"], r["size"], r["densest_cell"], list(r["typical"])) for r in every] == [(1, 8, 7, [5, 6, 7])]
