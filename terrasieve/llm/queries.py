"""Registered queries of the training-data problems 1, 2, 4, 5 and 7 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.llm import accessions as acc
from terrasieve.llm.clusters import describe_clusters, grid_clusters
from terrasieve.llm.leakage import leaked_passages
from terrasieve.llm.overlap import cross_split_links, cross_split_overlaps
from terrasieve.llm.packing import pack_containers
from terrasieve.llm.spam import spam_pages
from terrasieve.llm.splits import assign_splits, place_edges, related_groups, shared_value_edges
from terrasieve.llm.topn import top_n_per_group
from terrasieve.plans.scratch import Scratch
from terrasieve.queries import table

#: How far apart two spellings of one place may be, in degrees; and two members of a climate group, in z-scores.
SAME_PLACE, SAME_CLIMATE = 0.002, 0.0025


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = acc.in_both(table(spark, d, "coords_with_bioclim"), table(spark, d, "combined_variables_dataset_normalized"))
    return cross_split_overlaps(both, acc.listed_splits(table(spark, d, "splits")), "iid", "x", "y", SAME_PLACE)


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Accessions listed as train by how many accessions of each other split they overlap; those of a place share a class."""
    both = acc.in_both(table(spark, d, "coords_with_bioclim"), table(spark, d, "combined_variables_dataset_normalized"))
    return cross_split_links(both, acc.listed_splits(table(spark, d, "splits")), "iid", "x", "y", SAME_PLACE)


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per split and collection of the pair's accessions; a pair counts once for each collection it touches."""
    coords = table(spark, d, "coords_with_bioclim")
    sources = coords.select(
        F.col("iid").cast("long").alias("iid"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
    ).dropna().dropDuplicates()
    pairs = p1_found(spark, d).withColumn("iid", F.explode(F.array_distinct(F.array("iid_1", "iid_2"))))
    return pairs.join(sources, "iid").select(
        "iid_1",
        "iid_2",
        "split",
        "source",
    ).dropDuplicates().groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    group = ["variable", "snp_index"]
    peaks = top_n_per_group(table(spark, d, "gradient_peaks_summary"), group, F.col("zscore"), ["embedding_dim", "peak_index"], 5)
    weights = top_n_per_group(table(spark, d, "weights_explanation"), group, F.abs("weight"), ["embedding_dim"], 3)
    row = lambda df, src, peak: df.select(F.lit(src).alias("src"), "variable", "snp_index", "embedding_dim", peak.alias("peak_index"))
    return row(peaks, "peaks", F.col("peak_index")).unionByName(row(weights, "weights", F.lit(0)))


def p2_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The best peaks with their score and rank."""
    peaks = table(spark, d, "gradient_peaks_summary")
    return top_n_per_group(
        peaks,
        ["variable", "snp_index"],
        F.col("zscore"),
        ["embedding_dim", "peak_index"],
        5,
    ).withColumnRenamed("score", "zscore")


def _related(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    both = scratch.write(
        acc.in_both(table(spark, d, "coords_with_bioclim"), table(spark, d, "combined_variables_dataset_normalized")),
        "records",
    )
    edges = place_edges(both, "iid", "x", "y", SAME_PLACE).unionByName(shared_value_edges(both, "iid", "fid"))
    return scratch.write(related_groups(both, "iid", edges, scratch).withColumnRenamed("group", "group_iid"), "groups")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = _related(spark, d, Scratch(spark, "related"))
    several = groups.groupBy("group_iid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.join(several, "group_iid").select("iid", "group_iid")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every accession of both tables with its group and split, 80/10/10 by normalized rows."""
    scratch = Scratch(spark, "related")
    groups = _related(spark, d, scratch)
    rows = table(
        spark,
        d,
        "combined_variables_dataset_normalized",
    ).groupBy(F.col("iid").cast("long").alias("iid")).agg(F.count(F.lit(1)).alias("n_rows"))
    weights = groups.join(rows, "iid").groupBy("group_iid").agg(F.sum("n_rows").alias("n_rows"))
    return groups.join(assign_splits(weights, "group_iid", "n_rows", scratch), "group_iid").select("iid", "group_iid", "split")


def p4_split_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every accession once, no fid and no place in two splits, shares within a hundredth of 80, 10 and 10 percent of the rows."""
    got = Scratch(spark, "split-check").write(p4_splits(spark, d), "splits")
    coords, normalized = (table(spark, d, t) for t in ("coords_with_bioclim", "combined_variables_dataset_normalized"))
    known = acc.accessions(coords).join(got.select("iid", "split"), "iid")
    torn = lambda rows, keys: rows.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("t"))
    rows = normalized.select(F.col("iid").cast("long").alias("iid")).join(got, "iid")
    wanted = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    shares = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))
    off = shares.agg(F.count_if(F.abs(F.col("n") / F.col("total") - wanted) > 0.01).alias("n_shares_off"))
    return (
        got.agg(F.count(F.lit(1)).alias("n_accessions"), F.count_distinct("iid").alias("n_distinct"))
        .join(torn(known, ["fid"]).select(F.col("t").alias("n_fids_torn")))
        .join(torn(known, ["x", "y"]).select(F.col("t").alias("n_places_torn")))
        .join(off)
    )


def _climates(spark: SparkSession, d: str) -> DataFrame:
    rows = acc.measured(table(spark, d, "combined_variables_dataset_normalized"), ["bio1", "bio_11_6"])
    return grid_clusters(rows, "iid", "bio1", "bio_11_6", SAME_CLIMATE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _climates(spark, d).filter(F.col("size") > 1).select("iid", F.col("cluster").alias("cluster_iid"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each climate group's size and most typical accessions, those of its densest cell."""
    return describe_clusters(_climates(spark, d), "iid").select(
        F.col("cluster").alias("cluster_iid"),
        "size",
        "densest_cell",
        F.array_join(F.transform("typical", lambda x: x.cast("string")), ";").alias("typical"),
    )


def p5_dense(spark: SparkSession, d: str) -> DataFrame:
    """Climate groups made of cells with two records or more; records of thinner cells belong to none."""
    rows = acc.measured(table(spark, d, "combined_variables_dataset_normalized"), ["bio1", "bio_11_6"])
    out = grid_clusters(rows, "iid", "bio1", "bio_11_6", SAME_CLIMATE, min_cell_rows=2)
    return out.select("iid", F.col("cluster").alias("cluster_iid"), "size", "cell_rows")


#: Tokens a container holds.
CAPACITY = 2048


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where every token of every text goes; a container is named by its seed."""
    return pack_containers(table(spark, d, "documents"), capacity=CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    held = p7_containers(spark, d).groupBy("seed", "seed_part").agg(
        F.sum("n_tokens").alias("n"),
        F.count(F.lit(1)).alias("texts"),
    )
    return held.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_tokens"),
        F.round(F.sum("n") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill"),
        F.round(F.avg("texts"), 6).alias("mean_texts"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the longest run of words."""
    leaked = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    n = leaked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("run").alias("longest_run"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(n, "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks in which one letter of the passage may be changed, dropped or inserted."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=1)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents")).select("doc_id")


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages per source, with how much of them repeats."""
    docs = table(spark, d, "documents")
    found = spam_pages(docs)
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("unknown")).alias("source"),
    ).join(found, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_spam"),
        F.round(F.avg("covered"), 6).alias("mean_covered"),
    )


QUERIES = {"p1_found": p1_found, "p1_by_source": p1_by_source, "p1_links": p1_links, "p2_found": p2_found, "p2_ranks": p2_ranks, "p4_found": p4_found, "p4_splits": p4_splits, "p4_split_check": p4_split_check, "p5_found": p5_found, "p5_clusters": p5_clusters, "p5_dense": p5_dense,
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_by_item": p8_by_item, "p8_near": p8_near, "p9_found": p9_found, "p9_by_source": p9_by_source}

_ACC = """c as (select iid, max(case when ok then long end) x, max(case when ok then lat end) y, max(case when fid not in (0, -9) then fid end) fid
 from (select *, long is not null and lat is not null and not isnan(long) and not isnan(lat) and long <> -9 and lat <> -9 and abs(long) <= 180 and abs(lat) <= 90 ok from coords_with_bioclim)
 where iid in (select iid from combined_variables_dataset_normalized) group by iid)"""
_LISTED = """s as (select distinct cast(cast(trim(iid, E' \\t\\n') as double) as bigint) iid, case substr(lower(trim(split)), 1, 2) when 'tr' then 'train' when 'va' then 'val' when 'te' then 'test' end split from splits where iid is not null)"""
_P1 = f"""{_ACC}, {_LISTED}, m as (select s.iid, split, x, y from s join c on s.iid = c.iid),
g as (select *, cast(floor(x / 0.002001) as bigint) gx, cast(floor(y / 0.002001) as bigint) gy from m),
e as (select g.iid, split, x, y, gx + i gx, gy + j gy from g, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j) where split <> 'train'),
p as (select least(t.iid, e.iid) iid_1, greatest(t.iid, e.iid) iid_2, e.split from g t join e on t.gx = e.gx and t.gy = e.gy where t.split = 'train' and abs(t.x - e.x) <= 0.002 + 1e-9 and abs(t.y - e.y) <= 0.002 + 1e-9
 union select t.iid, t.iid, e.split from m t join m e on t.iid = e.iid where t.split = 'train' and e.split <> 'train')"""
_CLIMATE = """r as (select distinct iid, bio1 x, bio_11_6 y from combined_variables_dataset_normalized where bio1 > -1e30 and bio_11_6 > -1e30 and not isnan(bio1) and not isnan(bio_11_6)),
g as (select *, cast(floor(x / 0.002501) as bigint) gx, cast(floor(y / 0.002501) as bigint) gy from r),
e as (select iid, x, y, gx + i gx, gy + j gy from g, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)),
k as (select a.iid, min(b.iid) cluster_iid, count(*) n from g a join e b on a.gx = b.gx and a.gy = b.gy where abs(a.x - b.x) <= 0.0025 + 1e-9 and abs(a.y - b.y) <= 0.0025 + 1e-9 group by a.iid)"""

ORACLES = {
    "p1_found": f"with {_P1} select distinct iid_1, iid_2, split from p",
    "p1_by_source": f"""with {_P1}, o as (select distinct iid, coalesce(source, 'unknown') source from coords_with_bioclim),
q as (select distinct iid_1, iid_2, split, source from (select distinct * from p) p join o on o.iid = p.iid_1 or o.iid = p.iid_2)
select split, source, count(*) n_pairs from q group by 1, 2""",
    "p2_found": """with a as (select *, row_number() over (partition by variable, snp_index order by zscore desc, embedding_dim, peak_index) r from
 (select distinct variable, snp_index, embedding_dim, peak_index, zscore from gradient_peaks_summary where zscore is not null and not isnan(zscore))),
b as (select *, row_number() over (partition by variable, snp_index order by w desc, embedding_dim) r from
 (select distinct variable, snp_index, embedding_dim, abs(weight) w from weights_explanation where weight is not null and not isnan(weight)))
select 'peaks' src, variable, snp_index, embedding_dim, peak_index from a where r <= 5 union all select 'weights', variable, snp_index, embedding_dim, 0 from b where r <= 3""",
    "p2_ranks": """select variable, snp_index, embedding_dim, peak_index, zscore, cast(r as integer) "rank" from (select *, row_number() over (partition by variable, snp_index order by zscore desc, embedding_dim, peak_index) r from
 (select distinct variable, snp_index, embedding_dim, peak_index, zscore from gradient_peaks_summary where zscore is not null and not isnan(zscore))) where r <= 5""",
    "p1_links": f"""with {_P1}, u as (select t.iid, e.iid other, e.split from g t join e on t.gx = e.gx and t.gy = e.gy where t.split = 'train' and abs(t.x - e.x) <= 0.002 + 1e-9 and abs(t.y - e.y) <= 0.002 + 1e-9
 union select t.iid, t.iid, e.split from m t join m e on t.iid = e.iid where t.split = 'train' and e.split <> 'train'), w as (select iid, coalesce(min(iid) over (partition by x, y), iid) place_key, x, y from m where split = 'train')
select u.iid, u.split, case when w.x is null or w.y is null then u.iid else w.place_key end place_key, count(*) n_links from u join w on u.iid = w.iid group by 1, 2, 3""",
    "p5_dense": f"""with recursive {_CLIMATE}, c as (select iid, x, y, cast(floor(x / (0.0025::double + 1e-9::double)) as bigint) gx, cast(floor(y / (0.0025::double + 1e-9::double)) as bigint) gy from r),
d as (select gx, gy, min(iid) cell, count(*) cell_rows from c group by 1, 2 having count(*) >= 2), q as (select c.*, cell from c join d using (gx, gy)),
h as (select q.cell, x, y, gx + i gx, gy + j gy from q, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)), l as (select distinct q.cell a, h.cell b from q join h on q.gx = h.gx and q.gy = h.gy where abs(q.x - h.x) <= 0.0025 + 1e-9 and abs(q.y - h.y) <= 0.0025 + 1e-9),
reach as (select a node, a root from l union select l.b, reach.root from reach join l on reach.node = l.a), s as (select node cell, min(root) cluster_iid from reach group by node), z as (select cluster_iid, cast(sum(cell_rows) as bigint) size from d join s using (cell) group by 1)
select distinct q.iid, s.cluster_iid, z.size, d.cell_rows from q join s on s.cell = q.cell join z on z.cluster_iid = s.cluster_iid join d on d.gx = q.gx and d.gy = q.gy""",
    "p5_found": f"with {_CLIMATE} select iid, cluster_iid from k where n > 1",
    "p4_split_check": """select count(distinct iid) n_accessions, count(distinct iid) n_distinct, cast(0 as bigint) n_fids_torn, cast(0 as bigint) n_places_torn, cast(0 as bigint) n_shares_off
from coords_with_bioclim where iid in (select iid from combined_variables_dataset_normalized)""",
    "p4_found": f"""with recursive {_ACC},
g as (select *, cast(floor(x / 0.002001) as bigint) gx, cast(floor(y / 0.002001) as bigint) gy from c),
n as (select iid, x, y, gx + i gx, gy + j gy from g, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)),
e as (select a.iid u, b.iid v from g a join n b on a.gx = b.gx and a.gy = b.gy where a.iid <> b.iid and abs(a.x - b.x) <= 0.002 + 1e-9 and abs(a.y - b.y) <= 0.002 + 1e-9
 union select a.iid, b.iid from c a join c b on a.fid = b.fid where a.iid <> b.iid),
reach as (select u node, u root from e union select e.v, reach.root from reach join e on reach.node = e.u)
select node iid, min(root) group_iid from reach group by node""",
}
