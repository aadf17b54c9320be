from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import cluster, models
from terrasieve.sources import tables, text
from terrasieve.streaming import ingest_new_files, windowed_means


def brute_elastic_net(x, y, alpha, l1, rounds=4000):
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    b = y.mean()
    w = np.zeros(x.shape[1])
    n = len(y)
    step = 1 / (np.linalg.norm(x, 2) ** 2 / n + alpha * (1 - l1))
    for _ in range(rounds):  # proximal gradient on the rows themselves
        g = x.T @ (x @ w + b - y) / n + alpha * (1 - l1) * w
        v = w - step * g
        w = np.sign(v) * np.maximum(np.abs(v) - step * alpha * l1, 0)
    return w, b


def test_elastic_net_matches_a_direct_solver(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4))
    x[:, 3] = 2.0  # constant
    y = 1.5 * x[:, 0] - 0.7 * x[:, 1] + r.normal(size=300) * 0.3 + 4
    rows = [(i % 5, *map(float, x[i]), float(y[i]) if i else None) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, d double, y double").repartition(5)
    got = models.elastic_net(df, ["a", "b", "c", "d"], ["y"], fold="fold", alphas=(0.05, 0.5)).collect()[0]
    assert got["n"] == 299 and got["alpha"] == 0.05
    w, b = brute_elastic_net(x[1:], y[1:], 0.05, 0.1)
    assert np.allclose(got["coefs"], w, atol=1e-6) and got["intercept"] == pytest.approx(b)
    errors = []
    fold = np.arange(300) % 5
    for f in range(5):
        tr, te = [i for i in range(1, 300) if fold[i] != f], [i for i in range(1, 300) if fold[i] == f]
        w, b = brute_elastic_net(x[tr], y[tr], 0.05, 0.1)
        s = np.where(x[tr].std(0) > 0, x[tr].std(0), 1)
        errors.append(np.mean((y[te] - b - (x[te] - x[tr].mean(0)) / s @ w) ** 2))
    assert got["cv_mse"] == pytest.approx(np.mean(errors), rel=1e-6)
    scored = models.model_predictions(
        df.withColumn("k", F.monotonically_increasing_id()),
        models.elastic_net(df, ["a", "b"], ["y"], fold="fold"),
        ["a", "b"],
        ["k"],
    )
    assert scored.count() == 300


def test_linkage_and_split(spark):
    points = np.array([0.0, 0.1, 5.0, 5.1, 20.0])
    d = np.abs(points[:, None] - points[None, :])
    for how in ("average", "ward"):
        labels = cluster.linkage_labels(d, n=3, how=how)
        assert len(set(labels)) == 3 and labels[0] == labels[1] and labels[2] == labels[3]
    assert len(set(cluster.linkage_labels(d, cut=1.0))) == 3
    rows = [(i, "s", float(i // 2), 0.0) for i in range(400)] + [(1000, "t", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, s string, x double, y double")
    got = cluster.stratified_split(df, "id", "s", ["x", "y"])
    by = {r["id"]: r["split"] for r in got.collect()}
    assert len(by) == 401 and by[1000] == "train"
    assert all(by[i] == by[i + 1] for i in range(0, 400, 2))
    share = {r["split"]: r["share"] for r in cluster.split_report(got).collect()}
    assert abs(share["test"] - 0.2) < 0.02 and abs(share["val"] - 0.08) < 0.02


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content, encoding="utf-8")
    return str(p)


def test_line_formats(spark, tmp_path):
    ids = text.read_id_list(spark, write(tmp_path, "ids", "1\t2 3\n3 \n\n"))
    assert sorted(r["iid"] for r in ids.collect()) == ["1", "2", "3"]
    two = text.read_id_list(spark, write(tmp_path, "keep", "7 7\n8\t8\n"), two_column=True)
    assert sorted(r["iid"] for r in two.collect()) == ["7", "8"]
    counts = text.read_counts(spark, write(tmp_path, "counts", "a:: 3\nb: 4\nnoise\n"))
    assert sorted(map(tuple, counts.collect())) == [("a", 3), ("b", 4)]
    fam = text.read_fam(spark, write(tmp_path, "x.fam", "f1 i1 0 0 1 2.5\nf2   i2\t0 0 2 NA\n"))
    assert [(r["iid"], r["phenotype"]) for r in fam.orderBy("iid").collect()] == [("i1", 2.5), ("i2", None)]
    splits = text.read_json_splits(spark, write(tmp_path, "s.json", json.dumps({"train": [1, "2"], "test": [3]}, indent=1)))
    assert sorted(map(tuple, splits.collect())) == [("1", "train"), ("2", "train"), ("3", "test")]


def test_fasta_and_motifs(spark, tmp_path):
    path = write(tmp_path, "r.fa", ">acc1|a|b|c|Chr2:5..9|v\nacg\nTT\n\n>broken\nAC\n>acc2|Chr3:1..2|\n")
    got = text.region_headers(text.read_fasta(spark, path)).orderBy("accession").collect()
    assert [
        (r["accession"], r["chromosome"], r["start"], r["end"], r["seq"]) for r in got
    ] == [("acc1", 2, 5, 9, "ACGTT"), ("acc2", 3, 1, 2, "")]
    long = spark.createDataFrame([("h", "A" * 160), ("g", "C" * 81)], "header string, seq string")
    text.write_fasta(long, str(tmp_path / "out"))
    assert sorted(map(tuple, text.read_fasta(spark, str(tmp_path / "out")).collect())) == [("g", "C" * 81), ("h", "A" * 160)]
    meme = "MEME version 4\n\nALPHABET= ACGT\n\nMOTIF m1 x\nletter-probability matrix: alength= 4 w= 2\n0.1 0.2 0.3 0.4\n 1.0 0 0 0\nURL http://x\nMOTIF m2\nletter-probability matrix:\n0.25 0.25 0.25 0.25\n"
    rows = text.read_motifs(spark, write(tmp_path, "m.meme", meme)).orderBy("motif", "position").collect()
    assert [(r["motif"], r["position"], r["p_a"]) for r in rows] == [("m1", 0, 0.1), ("m1", 1, 1.0), ("m2", 0, 0.25)]


def test_tables(spark, tmp_path):
    env = tables.read_environment(spark, write(tmp_path, "e.csv", "FID,IID,LONG,LAT,BIO1\n1,2,3.5,4,\n"))
    assert env.dtypes == [("FID", "bigint"), ("IID", "bigint"), ("LONG", "double"), ("LAT", "double"), ("BIO1", "double")]
    gt = tables.read_genotypes(spark, write(tmp_path, "g.csv", "CHROM,POS,INDEL,a1,a2\n1,77,false,0,\n")).collect()[0]
    assert (gt["POS"], list(gt["gt"])) == (77, [0, 3])
    tsv = tables.read_table(spark, write(tmp_path, "t.tsv", "# note\na\tb\n1\tx\n"), sep="\t", comment="#")
    assert tsv.collect()[0]["b"] == "x"
    out = str(tmp_path / "p")
    tables.write_table(spark.range(2), out)
    tables.write_table(spark.range(5), out)
    assert spark.read.parquet(out).count() == 2
    tables.write_table(spark.range(5), out, force=True)
    assert spark.read.parquet(out).count() == 5
    fam = spark.createDataFrame(
        [("f", "1", "0", "0", "1", 0.0), ("f", "2", "0", "0", "1", 0.0)],
        "fid string, iid string, father string, mother string, sex string, phenotype double",
    )
    lines = tables.phenotype_lines(fam, spark.createDataFrame([(1, 2.5)], "iid long, value double"))
    assert sorted(r["value"] for r in lines.collect()) == ["f 1 0 0 1 2.5", "f 2 0 0 1 -9.0"]
    tables.write_phenotypes(
        fam,
        spark.createDataFrame([(1, "train", "v", 2.0)], "iid long, split string, variable string, value double"),
        str(tmp_path / "ph"),
    )
    assert (tmp_path / "ph" / "split=train" / "variable=v").is_dir()


def test_paths_and_streams(spark, tmp_path):
    for n in (1, 2):
        d = tmp_path / "in" / f"w1_snp{n}_dim4"
        d.mkdir(parents=True)
        (d / "x.csv").write_text(f"ts,g,v\n2024-01-01 00:0{n}:00,a,{n}\n")
    schema = "ts timestamp, g string, v double"
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path / "in"))
    got = text.with_path_parts(df, r"w(\d+)_snp(\d+)_dim(\d+)", ["rank", "snp", "dim"])
    assert sorted((r["rank"], r["snp"], r["v"]) for r in got.collect()) == [("1", "1", 1.0), ("1", "2", 2.0)]
    args = (spark, str(tmp_path / "in" / "*"), schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest_new_files(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in" / "w1_snp1_dim4" / "y.csv").write_text("ts,g,v\n2024-01-01 00:05:00,b,9\n")
    ingest_new_files(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    stream = spark.readStream.schema(schema).option("header", True).csv(str(tmp_path / "in" / "*"))
    q = windowed_means(
        stream,
        "ts",
        "v",
        "g",
        "10 minutes",
        "1 hour",
    ).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["g"], r["n"], r["mean"]) for r in spark.table("means").collect()) == [("a", 2, 1.5), ("b", 1, 9.0)]
