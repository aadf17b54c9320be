"""Files written and read back, records in order, labels, and lists without weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions.values import present
from terrasieve.operators import clean, cluster, graph, intervals, peaks, rank, sequence, stats, vectors
from terrasieve.plans.scratch import Scratch
from terrasieve.queries import table
from terrasieve.queries.environment import COORDS, CORRELATED, FIXED, _variable_components, ok, val
from terrasieve.queries.genetics import _L, _PFM, _SEQ, PEAKS, sequences
from terrasieve.sources import tables, text


def _path(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, name).root}/{name}"


def tab_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates written with tabs and read with their types."""
    path = _path(spark, "tabs")
    rows = clean.null_no_data(table(spark, d, COORDS).select("fid", "iid", "long", "lat"), ["long", "lat"])
    tables.write_table(rows, path, "csv", force=True, sep="\t")
    return tables.read_table(spark, path, "fid long, iid long, long double, lat double", sep="\t")


def genotype_matrix_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of calls, a column for each line number of the orders, written with a header and read by it."""
    path = _path(spark, "matrix")
    calls = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.pmod(F.col("l_quantity").cast("int"), F.lit(3)).alias("call"), (F.col("l_returnflag") == "R").alias("r")
    )
    chrom = (F.pmod(F.col("l_orderkey"), F.lit(5)) + 1).cast("int")
    wide = calls.groupBy(chrom.alias("CHROM"), F.col("l_orderkey").alias("POS")).agg(
        F.max("r").alias("INDEL"),
        *[F.max(F.when(F.col("l_linenumber") == i, F.col("call"))).alias(f"a{i}") for i in range(1, 8)],
    )
    tables.write_table(wide, path, "csv", force=True)
    back = tables.read_genotypes(spark, path)
    return back.select(
        F.col("CHROM").cast("int").alias("chrom"),
        F.col("POS").alias("pos"),
        F.col("INDEL").alias("indel"),
        F.array_join(F.transform("gt", lambda c: c.cast("string")), "").alias("calls"),
    )


def site_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Site names written as a list with a header and blanks between fields, and read by name."""
    path = _path(spark, "sites")
    rows = table(spark, d, PEAKS).select("chromosome", "abs_max_pos").dropna().dropDuplicates()
    named = tables.rename_sites(rows, "chromosome", "abs_max_pos", "RS").select("RS", F.col("abs_max_pos").alias("BP"))
    tables.write_table(named, path, "csv", force=True, sep=" ")
    return tables.read_table(spark, path, "RS string, BP long", sep=" ").select(F.col("RS").alias("rs"), F.col("BP").alias("bp"))


def count_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each collection has, as lines of ``id: n``."""
    path = _path(spark, "counts")
    n = table(spark, d, COORDS).filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n.select(F.concat_ws(": ", "source", F.col("n").cast("string"))).write.text(path)
    return text.read_counts(spark, path)


def json_splits_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Split lists as JSON objects, a file of bounded length each, read back as rows."""
    path = _path(spark, "splits")
    names = {"training": "train", "validation": "val", "valid": "val", "testing": "test"}
    rows = table(spark, d, "splits").select("iid", clean.relabel(F.lower(F.trim("split")), names).alias("split")).dropna().dropDuplicates()
    files = max(1, rows.count() // 5_000)
    lists = rows.groupBy(F.pmod(F.xxhash64("iid"), F.lit(files)).alias("part")).pivot("split", ["train", "val", "test"]).agg(F.collect_list("iid"))
    lists.repartition("part").write.partitionBy("part").json(path)
    return text.read_json_splits(spark, path)


def commented_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a table with tabs, with lines of remarks beside it that the reader passes over."""
    path = _path(spark, "remarks")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    tables.write_table(rows, path, "csv", force=True, sep="\t")
    rows.select(F.concat_ws(" ", F.lit("# supplier"), F.col("s_suppkey").cast("string"))).write.mode("append").text(path)
    return tables.read_table(spark, path, rows.schema, sep="\t", comment="#")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Peaks counted in folders named by load, whose names are read from the paths."""
    path = _path(spark, "folders")
    rows = table(spark, d, FIXED).select("iid", F.concat(F.lit("w1_load"), F.col("load_no").cast("string")).alias("folder"))
    rows.write.partitionBy("folder").parquet(path)
    files = spark.read.option("recursiveFileLookup", "true").schema("iid long").parquet(path)
    got = text.with_path_parts(files, r"folder=w(\d+)_load(\d+)", ["rank", "load_no"])
    return got.groupBy(F.col("rank").cast("int").alias("rank"), F.col("load_no").cast("int").alias("load_no")).agg(F.count("iid").alias("n"))


def kept_output(spark: SparkSession, d: str) -> DataFrame:
    """An output that exists is kept, and replaced only by force."""
    path = _path(spark, "kept")
    rows = table(spark, d, FIXED).groupBy("load_no").agg(F.count(F.lit(1)).alias("n"))
    tables.write_table(rows, path)
    tables.write_table(rows.withColumn("n", F.lit(0)), path)
    kept = spark.read.schema(rows.schema).parquet(path).withColumn("kind", F.lit("kept"))
    other = _path(spark, "forced")
    tables.write_table(rows.withColumn("n", F.lit(0).cast("long")), other)
    tables.write_table(rows, other, force=True)
    return kept.unionByName(spark.read.schema(rows.schema).parquet(other).withColumn("kind", F.lit("forced")))


def json_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary of each variable's peaks, written as JSON and read back."""
    path = _path(spark, "summary")
    rows = table(spark, d, PEAKS).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.max(present("zscore")).alias("highest"))
    tables.write_table(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)


def plain_names(spark: SparkSession, d: str) -> DataFrame:
    """Columns of uncertainty left out, and names without their suffix where that is free."""
    rows = table(spark, d, COORDS).select(
        "iid", F.col("bio1").alias("bio1_soil"), "bio2", F.col("bio2").alias("bio2_soil"), F.col("bio3").alias("bio3_uncertainty")
    )
    out = clean.plain_names(rows)
    return clean.null_no_data(out, [c for c in out.columns if c != "iid"])


def segments_complemented(spark: SparkSession, d: str) -> DataFrame:
    """Two segments of a sequence on the other strand, the second of them first."""
    joined = F.concat(F.substring("seq", 1, 20), F.lit("[SEP]"), F.expr("substring(seq, 21)"), F.lit("[SEP]"))
    return sequences(spark, d).select("doc_id", "record_no", sequence.reverse_complement_segments(joined).alias("other"))


def chromosome_codes(spark: SparkSession, d: str) -> DataFrame:
    """Chromosomes by number, with the last one written X."""
    name = F.when(F.col("chromosome") == 5, "X").otherwise(F.col("chromosome").cast("string"))
    rows = table(spark, d, PEAKS).select(sequence.recode_chromosome(name).alias("code"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def positions_only(spark: SparkSession, d: str) -> DataFrame:
    """Base composition with a row of metadata for each chromosome among its positions, and without it again."""
    rows = sequence.position_counts(sequences(spark, d), ["chromosome"], "seq")
    marks = rows.select("chromosome").dropDuplicates().select("chromosome", F.lit(-1).alias("position"), *[F.lit(0).cast("long").alias(f"n_{b}") for b in "acgtn"])
    return clean.without_metadata(rows.unionByName(marks))


def nested_regions(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as four chromosomes of four regions, taken apart again."""
    part = lambda i: F.slice("embedding", F.lit(1) + 4 * i, F.lit(4))
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: part(4 * c + r)))
    rows = vectors.nested_regions(table(spark, d, "embeddings").select("vec_id", nested.alias("nested")), ["vec_id"], "nested")
    return rows.select("vec_id", "chromosome", "region", F.element_at("embedding", 1).cast("double").alias("first"))


def site_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of single and combined variants."""
    rows = table(spark, d, "variant_overlap_summary").select("variant_id", "snp_index", "variant_type", "positions", "alt_bases").dropDuplicates()
    single = intervals.site_label(F.col("snp_index"), F.col("positions"), F.lit("N"), F.col("alt_bases"))
    label = F.when(F.col("variant_type") == "single", single).otherwise(intervals.combination_label(F.col("snp_index"), F.col("positions")))
    return rows.select("variant_id", label.alias("label")).dropna().dropDuplicates()


def genomic_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each peak's place on its chromosome."""
    place = intervals.genomic_position(F.col("region_start"), F.col("max_grad_pos"))
    rows = table(spark, d, PEAKS).filter("embedding_dim >= 0")
    return rows.select("variable", "snp_index", "embedding_dim", "peak_index", place.alias("place")).dropDuplicates()


def numbered_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of files in their order, each joined to the peaks of the site of its number."""
    path = _path(spark, "numbered")
    rows = sequences(spark, d).select("doc_id", "record_no", F.concat_ws("|", "accession", F.lit(">x"), F.col("start").cast("string")).alias("header"), "seq")
    text.write_fasta(rows.repartitionByRange("doc_id", "record_no").sortWithinPartitions("doc_id", "record_no"), path)
    records = text.read_numbered_fasta(spark, path)
    n = table(spark, d, PEAKS).groupBy(F.col("snp_index").cast("long").alias("record_no")).agg(F.count(F.lit(1)).alias("n_peaks"))
    return records.join(n, "record_no", "left").select("record_no", "header", "seq", F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"))


def scores_on_columns(spark: SparkSession, d: str) -> DataFrame:
    """A score per base put onto the columns of the gapped sequence, summed by column."""
    rows = sequences(spark, d).select("doc_id", "record_no", F.replace("seq", F.lit("N"), F.lit("-")).alias("aln"))
    keys = ["doc_id", "record_no"]
    bases = sequence.letters(rows.withColumn("plain", sequence.ungap(F.col("aln"))), keys, "plain")
    scores = bases.select(*keys, "position", (F.col("position") + F.ascii("base")).alias("score"))
    placed = peaks.scores_on_alignment(peaks.alignment_map(rows, keys, "aln"), scores, keys, "position", "score")
    return placed.groupBy("column").agg(F.count("score").alias("n"), F.sum("score").alias("score"))


def motif_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts linked by lines of very low value, in their components; nodes without a link are left out."""
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"),
        F.round(F.col("l_discount") * F.col("l_quantity"), 4).alias("q"),
    )
    edges = graph.similar_edges(rows.filter("q > 0"), "a", "b", "q", 0.015)
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).dropDuplicates()
    return graph.clusters_of_size(graph.connected_components(nodes, edges), "node")


def unweighted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the weights table kept by its first fifty pairs of site and dimension, as if it had no weights."""
    rows = table(spark, d, "weights_explanation").select("variable", "snp_index", "embedding_dim").dropDuplicates()
    return rank.first_pairs(rows, "snp_index", "embedding_dim", 50)


def exact_regions(spark: SparkSession, d: str) -> DataFrame:
    """Windows of one width within the chromosome, each once."""
    return intervals.exact_regions(table(spark, d, PEAKS), ["chromosome"], "abs_max_pos", F.lit(30_000_000), 512)


def variable_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Which combined column each climate column goes into, by its correlations."""
    found, _ = _variable_components(spark, d)
    return stats.variable_mapping(found, "component", "node")


def fold_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Three stand-ins for bio11 averaged as folds are, and how well the mean agrees, per collection."""
    folds = ["bio6", "bio10", "bio1"]
    rows = clean.null_no_data(table(spark, d, COORDS).filter("source is not null").select("source", "bio11", *folds), ["bio11", *folds])
    rows = rows.withColumn("mean", clean.row_mean([F.col(c) for c in folds]))
    m = stats.prediction_metrics(rows, ["source"], "bio11", "mean")
    error = rows.groupBy("source").agg(F.round(F.avg(F.col("mean") - F.col("bio11")), 6).alias("mean_error"))
    return m.join(error, "source").select("source", "n", *[F.round(c, 6).alias(c) for c in ("r2_cor", "spearman")], "mean_error")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Accessions split within their collection, those of a place standing for each other."""
    rows = clean.with_place(table(spark, d, COORDS)).filter("iid is not null and source is not null")
    one = rows.groupBy("iid").agg(F.min(F.struct("source", "long", "lat")).alias("r")).select("iid", "r.source", "r.long", "r.lat")
    return cluster.group_split(one, "iid", "source", ["long", "lat"])


QUERIES = {
    f.__name__: f
    for f in (
        tab_round_trip, genotype_matrix_round_trip, site_list_round_trip, count_lines_round_trip, json_splits_round_trip, commented_table_round_trip, path_parts, kept_output, json_summary, plain_names,
        segments_complemented, chromosome_codes, site_labels, positions_only, nested_regions, genomic_positions, numbered_records, scores_on_columns, motif_clusters, unweighted_pairs, exact_regions, variable_mapping, fold_consensus, group_split,
    )
}

_MEMBERS = ", ".join(f"('{c}')" for c in CORRELATED)
_MEAN = "(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0)"
_PAIRS = "(select distinct snp_index, embedding_dim from weights_explanation order by snp_index nulls first, embedding_dim nulls first limit 50)"


def _oracles() -> dict[str, str]:
    from terrasieve.queries.environment import _COMPONENTS, _PLACED, _RANK

    rank_of = lambda x: _RANK.format(p="source", o=x, v=x)
    return {
        "tab_round_trip": f"select fid, iid, {val('long')} long, {val('lat')} lat from {COORDS}",
        "genotype_matrix_round_trip": """select cast(l_orderkey % 5 + 1 as integer) chrom, l_orderkey pos, bool_or(l_returnflag = 'R') indel, """
        + " || ".join(f"coalesce(cast(max(case when l_linenumber = {i} then cast(l_quantity as integer) % 3 end) as varchar), '3')" for i in range(1, 8))
        + " calls from lineitem group by l_orderkey",
        "site_list_round_trip": f"select distinct chromosome || '_' || abs_max_pos rs, abs_max_pos bp from {PEAKS} where chromosome is not null and abs_max_pos is not null",
        "count_lines_round_trip": f"select source id, count(*) n from {COORDS} where source is not null group by 1",
        "json_splits_round_trip": """select * from (select distinct iid, case lower(trim(split)) when 'training' then 'train' when 'validation' then 'val' when 'valid' then 'val' when 'testing' then 'test' else lower(trim(split)) end split from splits where iid is not null) where split in ('train', 'val', 'test')""",
        "commented_table_round_trip": "select s_suppkey, s_nationkey, s_acctbal from supplier",
        "path_parts": f"select cast(1 as integer) \"rank\", load_no, count(iid) n from {FIXED} where load_no is not null group by load_no",
        "kept_output": " union all ".join(f"select load_no, count(*) n, '{k}' kind from {FIXED} group by load_no" for k in ("kept", "forced")),
        "json_summary": f"select variable, count(*) n, max(case when {ok('zscore')} then zscore end) highest from {PEAKS} group by variable",
        "plain_names": f"select iid, {val('bio1')} bio1, {val('bio2')} bio2, {val('bio2')} bio2_soil from {COORDS}",
        "segments_complemented": f"with {_SEQ} select doc_id, record_no, translate(reverse(substr(seq, 21)), 'ACGT', 'TGCA') || '[SEP]' || translate(reverse(substr(seq, 1, 20)), 'ACGT', 'TGCA') other from x",
        "chromosome_codes": f"select case chromosome when 5 then -1 else chromosome end code, count(*) n from {PEAKS} group by 1",
        "positions_only": f"with {_SEQ}, {_L}, {_PFM} select * from p",
        "nested_regions": "select vec_id, cast(r // 4 + 1 as integer) chromosome, cast(r as integer) region, cast(embedding[4 * r + 1] as double) first from embeddings, range(16) t(r)",
        "site_labels": """select distinct variant_id, label from (select variant_id, case when variant_type = 'single' then 'SNP' || snp_index || '_' || positions || '_N>' || alt_bases else 'COMBO' || snp_index || '_' || positions end label from variant_overlap_summary) where variant_id is not null and label is not null""",
        "genomic_positions": f"select distinct variable, snp_index, embedding_dim, peak_index, region_start + max_grad_pos place from {PEAKS} where embedding_dim >= 0",
        "numbered_records": f"with {_SEQ}, r as (select row_number() over (order by doc_id, record_no) - 1 record_no, accession || '|>x|' || \"start\" header, seq from x), n as (select snp_index, count(*) n from {PEAKS} group by 1) select r.record_no, header, seq, coalesce(n, 0) n_peaks from r left join n on n.snp_index = r.record_no",
        "scores_on_columns": f"with {_SEQ}, {_L}, u as (select \"position\" c, case when base <> 'N' then sum((base <> 'N')::int) over (partition by doc_id, record_no order by \"position\") - 1 + ascii(base) end score from l) select c \"column\", count(score) n, cast(sum(score) as bigint) score from u group by 1",
        "motif_clusters": """with recursive e as (select distinct 's' || l_suppkey a, 'p' || l_partkey b from lineitem where round(l_discount * l_quantity, 4) > 0 and round(l_discount * l_quantity, 4) < 0.015), u as (select a, b from e union select b, a from e),
reach as (select a node, a root from u union select u.b, reach.root from reach join u on reach.node = u.a), c as (select node, min(root) component from reach group by node)
select node, component, count(*) over (partition by component) size from c""",
        "unweighted_pairs": f"with p as {_PAIRS} select distinct variable, snp_index, embedding_dim from weights_explanation w where exists (select 1 from p where p.snp_index is not distinct from w.snp_index) and exists (select 1 from p where p.embedding_dim is not distinct from w.embedding_dim)",
        "exact_regions": f"""select distinct chromosome, s "start", least(s + 512, 30000000) "end" from (select chromosome, greatest(0, least(abs_max_pos - 256, 30000000 - 512)) s from {PEAKS} where abs_max_pos is not null)""",
        "variable_mapping": f"""{_COMPONENTS}, k as (select component, cast(count(*) as integer) size, case when count(*) <= 3 then 'bio_' || string_agg(substr(node, 4), '_' order by node) else 'bio_' || min(cast(substr(node, 4) as integer)) || 'to' || max(cast(substr(node, 4) as integer)) || '_group' end nm from c group by 1)
select node, case when size > 1 then nm else node end final, case when size > 1 then 'combined' else 'individual' end kind, case when size > 1 then component end component, size from c join k using (component)""",
        "fold_consensus": f"""with v as (select source, {val('bio11')} y, {val('bio6')} a, {val('bio10')} b, {val('bio1')} c from {COORDS} where source is not null), w as (select source, y, {_MEAN} p from v),
k as (select *, {rank_of('y')} ry, {rank_of('p')} rp from w where y is not null and p is not null)
select source, count(*) n, round(corr(y, p) * corr(y, p), 6) r2_cor, round(corr(ry, rp), 6) spearman, round(avg(p - y), 6) mean_error from k group by 1""",
        "group_split": f"""with r as (select iid, min(row(source, long, lat)) r from {COORDS} where {_PLACED} and iid is not null and source is not null group by iid), o as (select iid, r[1] source, r[2] x, r[3] y from r),
n as (select *, count(*) over (partition by x, y) k from o), s as (select *, sum(k) over (partition by source order by md5(iid || ':0'), iid) - k lies, sum(k) over (partition by source) total, count(*) over (partition by source) keys from n),
t as (select *, lies < greatest(floor(0.2 * total), 1) in_test from s), q as (select *, sum(case when in_test then k else 0 end) over (partition by source) taken from t)
select * from (select iid, case when in_test then 'test' when lies - taken < greatest(floor(0.08 * total), 1) and keys >= 2 then 'val' when keys >= 3 then 'train' end split from q) where split is not null""",
    }


ORACLES = _oracles()
