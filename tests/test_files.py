"""Records in order, names of column clusters, exact regions, group splits and lists without weights, against plain rules."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrasieve.operators import cluster, intervals, rank, stats
from terrasieve.sources import text


def test_records_keep_their_order_and_marks_in_headers(spark, tmp_path):
    records = [(f"r{i} > of|{i}", "ACGT" * (i % 40)) for i in range(300)]
    for part in range(3):
        rows = records[part * 100 : (part + 1) * 100]
        (tmp_path / f"part-{part}").write_text("".join(f">{h}\n{s[:50]}\n{s[50:]}\n" for h, s in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = sorted(text.read_numbered_fasta(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["record_no"], r["header"], r["seq"]) for r in got] == [(i, h, s) for i, (h, s) in enumerate(records)]
    assert {tuple(r) for r in text.read_fasta(spark, str(tmp_path)).collect()} == set(records)


def test_names_of_column_clusters(spark):
    groups = {
        1: ["bio11", "bio6"],
        2: ["bio1", "bio10", "bio5", "bio8"],
        3: ["soc_mean", "clay_mean"],
        4: ["soc_mean2", "clay_mean2", "bdod_mean"],
        5: ["bio3", "phh2o_mean"],
        6: ["altitude_mean"],
    }
    df = spark.createDataFrame([(k, c) for k, cs in groups.items() for c in cs], "k int, c string")
    names = {r["k"]: r["name"] for r in stats.cluster_names(df, "k", "c").collect()}
    want = {1: "bio_11_6", 2: "bio_1to10_group", 3: "Soil_Clay_SOC", 4: "Soil_Mixed", 5: "Mixed_bio1_Soil1", 6: "Soil_altitude"}
    assert names == want
    kept = {r["c"]: (r["final"], r["kind"], r["k"], r["size"]) for r in stats.variable_mapping(df, "k", "c").collect()}
    assert kept["altitude_mean"] == ("altitude_mean", "individual", None, 1) and kept["bio6"] == ("bio_11_6", "combined", 1, 2)
    assert stats.cluster_names(df.limit(0), "k", "c").collect() == []


def merged_plainly(positions, size, width):
    out = []
    for p in sorted(positions):
        start = max(0, min(p - width // 2, size - width))
        end = min(start + width, size)
        if not out or start > out[-1][1]:
            out.append([start, end])
        elif max(out[-1][1], end) - out[-1][0] <= width:
            out[-1][1] = max(out[-1][1], end)
        elif out[-1][0] + width < p + width // 2:
            out.append([start, end])
        else:
            out[-1][1] = out[-1][0] + width
    return {tuple(x) for x in out}


@pytest.mark.parametrize("width", [6, 7, 30, 31])
def test_exact_regions_follow_the_merging_rule(spark, width):
    r = random.Random(width)
    places = [(c, r.randrange(200)) for c in (1, 2) for _ in range(90)] + [(None, 5), (1, None)]
    df = spark.createDataFrame(places, "c int, p long")
    got = defaultdict(set)
    for x in intervals.exact_regions(df, ["c"], "p", F.lit(200), width).collect():
        got[x["c"]].add((x["start"], x["end"]))
    for c in (1, 2, None):
        assert got[c] == merged_plainly({p for k, p in places if k == c and p is not None}, 200, width)


def split_plainly(rows, test, val, seed):
    out = {}
    strata = defaultdict(list)
    n = Counter((x, y) for _, _, x, y in rows)
    for key, stratum, x, y in rows:
        strata[stratum].append((hashlib.md5(f"{key}:{seed}".encode()).hexdigest(), key, n[x, y]))
    for keys in strata.values():
        keys.sort()
        repeated = [k for _, k, c in keys for _ in range(c)]
        n_test, n_val = max(int(test * len(repeated)), 1), max(int(val * len(repeated)), 1)
        chosen = set(repeated[:n_test])
        rest = [k for k in repeated if k not in chosen]
        later = set(rest[:n_val]) if len(keys) >= 2 else set()
        for _, k, _ in keys:
            if k in chosen:
                out[k] = "test"
            elif k in later:
                out[k] = "val"
            elif len(keys) >= 3:
                out[k] = "train"
    return out


def test_group_split_follows_the_rule(spark):
    r = random.Random(3)
    rows = [(i, r.choice("aaab") if i < 120 else "cdd"[i % 3], r.randrange(9) * 1.0, 0.5) for i in range(123)] + [(500, None, 1.0, None)]
    df = spark.createDataFrame(rows, "k long, s string, x double, y double").selectExpr("*", "1 as total", "2 as taken")
    got = {x["k"]: x["split"] for x in cluster.group_split(df, "k", "s", ["x", "y"], test=0.2, val=0.08).collect()}
    assert got == split_plainly(rows, 0.2, 0.08, 0)
    assert cluster.group_split(df.limit(0), "k", "s", ["x", "y"]).collect() == []


def test_first_pairs_may_give_more_pairs(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d"), (3, 1, "e"), (1, 1, "f")], "i int, d int, v string")
    assert {r["v"] for r in rank.first_pairs(df, "i", "d", 3).collect()} == {"a", "b", "c", "d", "f"}
    assert {r["v"] for r in rank.first_pairs(df, "i", "d", 1).collect()} == {"a", "f"}
    assert rank.first_pairs(df.limit(0), "i", "d", 1).collect() == []
