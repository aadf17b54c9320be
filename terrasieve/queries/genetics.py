"""Genotypes, sequences, regions and peaks.

Sequences are the FASTA records that stand in documents.text; sites and peaks are those of the peaks table;
genotype calls are made from the order lines, as no table holds any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions.values import present
from terrasieve.operators import clean, intervals, peaks, rank, sequence
from terrasieve.plans.scratch import Scratch
from terrasieve.queries import table
from terrasieve.sources import text

PEAKS = "gradient_peaks_summary"
RECORD = r">([^|\n]+)\|chr(\d+)\|(\d+)\n([ACGTN]+)"


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, record_no, accession, chromosome, start, seq): every sequence record of every document."""
    part = lambda i: F.regexp_extract_all("text", F.lit(RECORD), F.lit(i))
    rows = table(spark, d, "documents").filter(F.col("text").contains(">")).select(
        "doc_id",
        F.posexplode(F.arrays_zip(*[part(i + 1).alias(n) for i, n in enumerate(("a", "c", "s", "q"))])).alias("record_no", "r"),
    )
    return rows.select(
        "doc_id",
        "record_no",
        F.col("r.a").alias("accession"),
        F.col("r.c").cast("int").alias("chromosome"),
        F.col("r.s").cast("long").alias("start"),
        F.col("r.q").alias("seq"),
    )


def _sites(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("site"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_extendedprice",
        F.pmod(F.col("l_quantity").cast("int"), F.lit(4)).alias("call"),
    )
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("sample")
    return clean.genotype_arrays(calls.select("site", order, "call"), ["site"], "sample", "call")


def genotype_missing(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d).select("site", F.round(clean.missing_share(F.col("gt")), 6).alias("missing"))


def genotype_mode(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d).select("site", F.coalesce(clean.mode_call(F.col("gt")), F.lit(-1)).alias("mode_call"))


def genotype_quality(spark: SparkSession, d: str) -> DataFrame:
    return clean.genotype_qc(_sites(spark, d), max_missing=0.25, min_freq=0.45).select(
        "site",
        F.round("missing", 6).alias("missing"),
        F.round("freq", 6).alias("freq"),
    )


def allele_folded(spark: SparkSession, d: str) -> DataFrame:
    gt = clean.impute_mode(F.col("gt"))
    return _sites(spark, d).select("site", F.round(clean.allele_frequency(gt, folded=True), 6).alias("maf"))


def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d)


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written wrapped at 80 columns and read back."""
    rows = sequences(spark, d).select(
        F.format_string(
            "%s|%d|%d|x|Chr%d:%d..%d|v",
            "accession",
            "doc_id",
            "record_no",
            "chromosome",
            "start",
            F.col("start") + F.length("seq"),
        ).alias("header"),
        "seq",
    )
    path = f"{Scratch(spark, 'fasta').root}/records"
    text.write_fasta(rows, path)
    back = text.region_headers(text.read_fasta(spark, path))
    return back.select("accession", "chromosome", "start", "end", "seq")


def id_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark, 'ids').root}/ids"
    text.write_id_list(table(spark, d, "coords_with_bioclim").filter("iid is not null"), path, two_column=True)
    return text.read_id_list(spark, path, two_column=True)


def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select(
        "doc_id",
        "record_no",
        sequence.reverse_complement(F.col("seq")).alias("rc"),
        sequence.ungap(F.replace("seq", F.lit("N"), F.lit("-"))).alias("ungapped"),
    )


def substitutions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    two = F.array(
        F.struct(F.lit(0).alias("position"), F.lit("G").alias("base")),
        F.struct(F.lit(5).alias("position"), F.lit("T").alias("base")),
    )
    return sequences(spark, d).select(
        "doc_id",
        "record_no",
        sequence.substitute(s, F.lit(3), F.lit("A")).alias("one"),
        sequence.substitute_all(s, two).alias("two"),
        sequence.context(s, F.lit(10), 4).alias("around"),
    )


def alternative_bases(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("seq", 1, 1)
    return sequences(spark, d).select("doc_id", "record_no", F.array_join(sequence.alternatives(first), "").alias("alts"))


def point_mutants(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).withColumn("ps", F.array(F.lit(0), F.lit(7), F.floor(F.length("seq") / 2).cast("int")))
    return sequence.point_mutants(rows, ["doc_id", "record_no"], "seq", "ps")


def double_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Of the sequences of every chromosome."""
    rows = sequences(spark, d).withColumn("ps", F.array(F.lit(1), F.lit(4), F.lit(9)))
    out = sequence.multi_mutants(rows, ["doc_id", "record_no"], "seq", "ps", 2)
    return out.select(
        "doc_id",
        "record_no",
        F.array_join(F.transform("positions", lambda p: p.cast("string")), ";").alias("positions"),
        F.array_join("alts", "").alias("alts"),
        "mutant",
    )


def _longest(rows: DataFrame) -> int:
    """Letters of the longest sequence, so that an encoding of this length cuts none."""
    return rows.agg(F.max(F.length("seq"))).first()[0] or 1


def _checksum(ids: Column) -> Column:
    return F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","))


def token_checksum(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence to its last letter, padded to the longest."""
    rows = sequences(spark, d)
    return rows.select("doc_id", "record_no", _checksum(sequence.token_ids(F.col("seq"), _longest(rows))).alias("tokens"))


def _changed(n: Column) -> Column:
    """A sequence with its middle and its last base replaced."""
    return sequence.substitute(sequence.substitute(F.col("seq"), F.floor(n / 2), F.lit("A")), n - 1, F.lit("C"))


def variant_places(spark: SparkSession, d: str) -> DataFrame:
    """Where a sequence and itself with its middle and its last base replaced differ, whatever its length."""
    rows = sequences(spark, d)
    longest = _longest(rows)
    a, b = (sequence.token_ids(s, longest) for s in (F.col("seq"), _changed(F.length("seq"))))
    return rows.select("doc_id", "record_no", sequence.variant_index(a, b).alias("at"))


def variant_token_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Checksums of the four arrays that encode a sequence and its changed copy on both strands."""
    rows = sequences(spark, d)
    arrays = sequence.variant_tokens(F.col("seq"), _changed(F.length("seq")), _longest(rows))
    return rows.select("doc_id", "record_no", *[_checksum(ids).alias(name) for name, ids in arrays.items()])


def base_composition(spark: SparkSession, d: str) -> DataFrame:
    out = sequence.base_composition(sequences(spark, d), ["chromosome"], "seq")
    return out.select("chromosome", "position", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("pct")])


def gapped_composition(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).withColumn("aln", F.replace("seq", F.lit("N"), F.lit("-")))
    out = sequence.base_composition(rows, ["chromosome"], "aln", gaps=True)
    return out.select("chromosome", "position", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("pct")])


def position_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return sequence.position_counts(sequences(spark, d), ["chromosome"], "seq")


def consensus_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sequence.consensus(sequence.position_counts(sequences(spark, d), ["chromosome"], "seq"), ["chromosome"])


def frequency_difference(spark: SparkSession, d: str) -> DataFrame:
    """Every chromosome's counts less those of the next one."""
    pfm = sequence.position_counts(sequences(spark, d), ["chromosome"], "seq")
    following = pfm.withColumn("chromosome", F.col("chromosome") - 1)
    return sequence.pfm_difference(pfm, following, ["chromosome"])


def majority_bases(spark: SparkSession, d: str) -> DataFrame:
    return sequence.majority_base(sequences(spark, d), ["chromosome"], "seq").select("chromosome", "position", "base", "n")


def motif_statistics(spark: SparkSession, d: str) -> DataFrame:
    pwm = sequence.normalised_pwm(sequence.position_counts(sequences(spark, d), ["chromosome"], "seq"), ["chromosome"])
    out = sequence.motif_statistics(pwm, "chromosome")
    return out.select("chromosome", "length", *[F.round(c, 6).alias(c) for c in ("gc", "mean_a", "mean_c", "mean_g", "mean_t")])


def motif_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Matrices written to a motif file and read back, to its four decimals."""
    pwm = sequence.normalised_pwm(
        sequence.position_counts(sequences(spark, d), ["chromosome"], "seq"),
        ["chromosome"],
    ).withColumn("motif", F.concat(F.lit("chr"), F.col("chromosome").cast("string")))
    path = f"{Scratch(spark, 'motifs').root}/motifs"
    text.write_motifs(pwm, path)
    back = text.read_motifs(spark, path)
    return back.groupBy("motif").agg(
        F.count(F.lit(1)).alias("length"),
        F.round(F.avg(F.col("p_a") + F.col("p_c") + F.col("p_g") + F.col("p_t")), 3).alias("mean_sum"),
    )


def alignment_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("doc_id", "record_no", F.replace("seq", F.lit("N"), F.lit("-")).alias("aln"))
    return peaks.alignment_map(rows, ["doc_id", "record_no"], "aln").fillna(-1, ["ungapped"])


def alignment_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("chromosome", F.replace("seq", F.lit("N"), F.lit("-")).alias("aln"))
    out = sequence.alignment_quality(rows, ["chromosome"], "aln")
    return out.select("chromosome", F.round("gap_pct", 6).alias("gap_pct"), F.round("conservation", 6).alias("conservation"))


def packed_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).withColumn("place", F.struct("start", "doc_id", "record_no"))
    return sequence.pack_segments(rows, ["accession", "chromosome"], "place", "seq", 600)


def regions_parsed(spark: SparkSession, d: str) -> DataFrame:
    label = intervals.format_region(F.col("chromosome"), F.col("region_start"), F.col("region_end"))
    rows = table(spark, d, PEAKS).select("variable", "snp_index", label.alias("label")).dropDuplicates()
    parts = intervals.parse_region(F.col("label"))
    return rows.select("variable", "snp_index", "label", *[c.alias(n) for n, c in parts.items()])


def sites_parsed(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.pmod("peak_index", F.lit(3)) == 0, F.lit("bad")).otherwise(
        F.concat_ws("_", F.col("chromosome").cast("string"), F.col("abs_max_pos").cast("string"))
    )
    rows = table(spark, d, PEAKS).filter(
        "abs_max_pos is not null and chromosome is not null and peak_index is not null"
    ).select(name.alias("name")).dropDuplicates()
    return rows.select(
        "name",
        *[F.coalesce(c, F.lit(-1)).alias(f"site_{n}") for n, c in intervals.parse_site(F.col("name"), 1000).items()],
    )


def spaced_sites(spark: SparkSession, d: str) -> DataFrame:
    return intervals.spaced_positions(table(spark, d, PEAKS), ["chromosome"], "abs_max_pos", 250_000)


def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged_windows(table(spark, d, PEAKS), ["chromosome"], "abs_max_pos", 1000, longest=1 << 40)


def capped_regions(spark: SparkSession, d: str) -> DataFrame:
    """Merged windows none of which outgrows the default cap."""
    return intervals.merged_windows(table(spark, d, PEAKS), ["chromosome"], "abs_max_pos", 20_000)


def exact_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, PEAKS).select("chromosome", "abs_max_pos").dropna().dropDuplicates()
    return intervals.exact_windows(rows, "abs_max_pos", F.lit(30_000_000), 512)


def shifted_windows(spark: SparkSession, d: str) -> DataFrame:
    first, last = peaks.shifted_window(F.col("max_grad_pos"), F.col("sequence_length"), 11)
    return table(spark, d, PEAKS).select("max_grad_pos", "sequence_length").dropna().dropDuplicates().select(
        "*",
        first.alias("first"),
        last.alias("last"),
    )


def window_slices(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d)
    return s.select(
        "doc_id",
        "record_no",
        peaks.clipped_slice(F.col("seq"), F.lit(2), 5).alias("head"),
        peaks.clipped_slice(F.col("seq"), F.length("seq") - 2, 5).alias("tail"),
    )


def map_tiles(spark: SparkSession, d: str) -> DataFrame:
    return intervals.greedy_tiles(clean.with_place(table(spark, d, "coords_with_bioclim")), "long", "lat", 3.8)


def map_tile_ids(spark: SparkSession, d: str) -> DataFrame:
    """The identifiers of every tile, a row for each."""
    rows = clean.with_place(table(spark, d, "coords_with_bioclim")).select("fid", "iid", "long", "lat")
    return intervals.tile_members(rows, ["fid", "iid"], "long", "lat", 3.8).select("tile_x", "tile_y", "fid", "iid")


def series_zscores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    return peaks.series_zscore(rows, ["user_id"], "value").select("user_id", "event_id", F.round("z", 6).alias("z"))


def greedy_peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        "user_id",
        F.floor(F.unix_timestamp("ts") / 60).alias("minute"),
        "value",
    ).groupBy("user_id", "minute").agg(F.max("value").alias("value"))
    return peaks.greedy_peaks(rows, ["user_id"], "minute", "value", window=2000).select(
        "user_id",
        "peak_index",
        "minute",
        F.round("zscore", 6).alias("zscore"),
    )


def top_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "weights_explanation").dropDuplicates()
    return rank.top_weights(
        rows,
        ["variable"],
        "weight",
        ["snp_index", "embedding_dim"],
        20,
    ).select("variable", "snp_index", "embedding_dim", "weight", "rank")


def negative_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "weights_explanation").dropDuplicates()
    return rank.top_weights(
        rows,
        ["variable"],
        "weight",
        ["snp_index", "embedding_dim"],
        5,
        "neg",
    ).select("variable", "snp_index", "embedding_dim", "weight", "rank")


def weight_mass(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "weights_explanation").dropDuplicates()
    return rank.weight_mass(rows.withColumn("weight", F.round("weight", 6)), ["variable"], "weight")


def peaks_of_weights(spark: SparkSession, d: str) -> DataFrame:
    """The best peak of each variable's heaviest weights."""
    keys = ["variable", "snp_index", "embedding_dim"]
    best = top_weights(spark, d)
    found = table(spark, d, PEAKS).withColumn("zscore", present("zscore")).select(
        *keys,
        "peak_index",
        "zscore",
        "abs_max_pos",
    ).dropDuplicates()
    return rank.pick_peaks(best, found, keys).select(*keys, "rank", "peak_index", "zscore", "abs_max_pos")


QUERIES = {
    f.__name__: f
    for f in (
        genotype_missing, genotype_mode, genotype_quality, allele_folded, fasta_records, fasta_round_trip, id_list_round_trip, reverse_complements, substitutions, alternative_bases, point_mutants,
        double_mutants, token_checksum, variant_places, variant_token_arrays, base_composition, gapped_composition, position_frequencies, consensus_sequences, frequency_difference, majority_bases, motif_statistics,
        motif_file_round_trip, alignment_columns, alignment_quality, packed_segments, regions_parsed, sites_parsed, spaced_sites, merged_regions, capped_regions, exact_windows, shifted_windows,
        window_slices, map_tiles, map_tile_ids, series_zscores, greedy_peaks, top_weights, negative_weights, weight_mass, peaks_of_weights,
    )
} | {"double_mutants_all": double_mutants, "token_checksum_whole": token_checksum, "variant_places_whole": variant_places}

_SEQ = """q as (select doc_id, generate_subscripts(a, 1) - 1 record_no, unnest(a) accession, cast(unnest(c) as integer) chromosome, cast(unnest(s) as bigint) "start", unnest(q) seq from (
 select doc_id, regexp_extract_all("text", '>([^|\\n]+)\\|chr(\\d+)\\|(\\d+)\\n([ACGTN]+)', 1) a, regexp_extract_all("text", '>([^|\\n]+)\\|chr(\\d+)\\|(\\d+)\\n([ACGTN]+)', 2) c,
 regexp_extract_all("text", '>([^|\\n]+)\\|chr(\\d+)\\|(\\d+)\\n([ACGTN]+)', 3) s, regexp_extract_all("text", '>([^|\\n]+)\\|chr(\\d+)\\|(\\d+)\\n([ACGTN]+)', 4) q from documents)),
x as (select doc_id, cast(record_no as integer) record_no, accession, chromosome, "start", seq from q)"""
_L = """l as (select chromosome, doc_id, record_no, cast(generate_subscripts(string_split(seq, ''), 1) - 1 as integer) "position", unnest(string_split(seq, '')) base from x)"""
_CALLS = """g as (select l_partkey site, cast(l_quantity as integer) % 4 c from lineitem), n as (select site, count(*) n, count(case when c = 3 then 1 end) m, count(case when c = 0 then 1 end) a, count(case when c = 1 then 1 end) b, count(case when c = 2 then 1 end) d from g group by 1),
k as (select *, case when a >= b and a >= d and a > 0 then 0 when b >= d and b > 0 then 1 when d > 0 then 2 end mode from n), f as (select *, (b + 2 * d + m * mode) / (2.0 * n) p from k)"""
_COUNTS = ", ".join(
    f"count(case when base = '{b.upper()}' then 1 end) n_{b}" for b in "acgt"
) + ", count(case when base not in ('A', 'C', 'G', 'T') then 1 end) n_n"
_PFM = f"""p as (select chromosome, "position", {_COUNTS} from l where base <> '-' group by 1, 2)"""
_SHARES = "w as (select *, nullif(n_a + n_c + n_g + n_t, 0) t from p), m as (select chromosome, \"position\", coalesce(n_a / t, 0.25) a, coalesce(n_c / t, 0.25) c, coalesce(n_g / t, 0.25) g, coalesce(n_t / t, 0.25) tt from w)"
_W = "w as (select distinct * from weights_explanation), v as (select * from w where weight is not null and not isnan(weight))"
_TOP = "t as (select variable, snp_index, embedding_dim, weight, row_number() over (partition by variable order by abs(weight) desc, snp_index, embedding_dim) r from v)"
_Z = "z as (select variable, snp_index, embedding_dim, peak_index, case when zscore is not null and not isnan(zscore) then zscore end zscore, abs_max_pos from gradient_peaks_summary)"

ORACLES = {
    "genotype_missing": f"with {_CALLS} select site, round(m / n, 6) missing from n",
    "genotype_mode": f"with {_CALLS} select site, coalesce(mode, -1) mode_call from k",
    "genotype_quality": f"with {_CALLS} select site, round(m / n, 6) missing, round(p, 6) freq from f where m / n <= 0.25 and p >= 0.45",
    "allele_folded": f"with {_CALLS} select site, round(least(p, 1 - p), 6) maf from f",
    "fasta_records": f"with {_SEQ} select doc_id, record_no, accession, chromosome, \"start\", seq from x",
    "fasta_round_trip": f"with {_SEQ} select accession, chromosome, \"start\", \"start\" + length(seq) \"end\", seq from x",
    "id_list_round_trip": "select distinct cast(iid as varchar) iid from coords_with_bioclim where iid is not null",
    "reverse_complements": f"with {_SEQ} select doc_id, record_no, translate(reverse(seq), 'ACGT', 'TGCA') rc, replace(seq, 'N', '') ungapped from x",
    "substitutions": f"""with {_SEQ}, s as (select *, case when length(seq) > 0 then 'G' || substr(seq, 2) else seq end g from x)
select doc_id, record_no, case when length(seq) > 3 then substr(seq, 1, 3) || 'A' || substr(seq, 5) else seq end one, case when length(seq) > 5 then substr(g, 1, 5) || 'T' || substr(g, 7) else g end two, substr(seq, 7, greatest(least(15, length(seq)) - 6, 0)) around from s""",
    "alternative_bases": f"with {_SEQ} select doc_id, record_no, replace('ACGT', substr(seq, 1, 1), '') alts from x",
    "point_mutants": f"""with {_SEQ}, p as (select *, unnest([0, 7, cast(floor(length(seq) / 2) as integer)]) "position" from x), r as (select *, substr(seq, "position" + 1, 1) ref from p where "position" < length(seq))
select doc_id, record_no, "position", ref, alt, substr(seq, 1, "position") || alt || substr(seq, "position" + 2) mutant from r, (values ('A'), ('C'), ('G'), ('T')) t(alt) where alt <> ref""",
    "double_mutants": f"""with {_SEQ}, p as (select x.*, i, j from x, (values (1, 4), (1, 9), (4, 9)) t(i, j) where length(seq) > j)
select doc_id, record_no, i || ';' || j positions, a.b || c.b alts, substr(seq, 1, i) || a.b || substr(seq, i + 2, j - i - 1) || c.b || substr(seq, j + 2) mutant
from p, (values ('A'), ('C'), ('G'), ('T')) a(b), (values ('A'), ('C'), ('G'), ('T')) c(b) where a.b <> substr(seq, i + 1, 1) and c.b <> substr(seq, j + 1, 1)""",
    "token_checksum": f"""with {_SEQ}, n as (select max(length(seq)) n from x), t as (select doc_id, record_no, string_split(rpad(seq, cast(n as integer), 'P'), '') cs from x, n)
select doc_id, record_no, md5(array_to_string(list_transform(cs, lambda c: case c when 'A' then '0' when 'C' then '1' when 'G' then '2' when 'T' then '3' when 'P' then '-1' else '4' end), ',')) tokens from t""",
    "variant_places": f"""with {_SEQ}, n as (select max(length(seq)) // 2 m from x), t as (select doc_id, record_no, m, length(seq) // 2 i, length(seq) - 1 j, length(seq) > 1 and substr(seq, length(seq) // 2 + 1, 1) <> 'A' and length(seq) // 2 < length(seq) - 1 a, substr(seq, length(seq), 1) <> 'C' b from x, n)
select doc_id, record_no, cast(case when (a and i = m) or (b and j = m) then m when b then j when a then i else -1 end as integer) "at" from t""",
    "base_composition": f"""with {_SEQ}, {_L}, k as (select chromosome, count(*) k from x group by 1), c as (select chromosome, "position", {', '.join(f"count(case when base = '{b}' then 1 end) b_{b.lower()}" for b in 'ATGC')} from l group by 1, 2)
select chromosome, "position", {', '.join(f'round(100.0 * b_{b} / k, 6) pct_{b}' for b in 'atgc')}, round(100.0 * (k - b_a - b_t - b_g - b_c) / k, 6) pct_n from c join k using (chromosome)""",
    "gapped_composition": f"""with {_SEQ}, {_L}, c as (select chromosome, "position", count(*) n, count(case when base = 'N' then 1 end) gap, {', '.join(f"count(case when base = '{b}' then 1 end) b_{b.lower()}" for b in 'ATGC')} from l group by 1, 2)
select chromosome, "position", {', '.join(f'round(coalesce(100.0 * b_{b} / nullif(n - gap, 0), 0), 6) pct_{b}' for b in 'atgc')}, cast(0 as double) pct_n, round(100.0 * gap / n, 6) pct_gap from c""",
    "position_frequencies": f"with {_SEQ}, {_L}, {_PFM} select * from p",
    "consensus_sequences": f"""with {_SEQ}, {_L}, {_PFM}, g as (select *, greatest(n_a, n_c, n_g, n_t) top from p),
b as (select chromosome, "position", case when (n_a = top)::int + (n_c = top)::int + (n_g = top)::int + (n_t = top)::int <> 1 then 'N' when n_a = top then 'A' when n_c = top then 'C' when n_g = top then 'G' else 'T' end b from g)
select chromosome, string_agg(b, '' order by "position") consensus from b group by 1""",
    "frequency_difference": f"""with {_SEQ}, {_L}, {_PFM}, b as (select * replace (chromosome - 1 as chromosome) from p) select coalesce(p.chromosome, b.chromosome) chromosome, coalesce(p."position", b."position") "position", {', '.join(f'coalesce(p.n_{c}, 0) - coalesce(b.n_{c}, 0) n_{c}' for c in 'acgtn')}
from p full join b on p."position" = b."position" and p.chromosome = b.chromosome""",
    "majority_bases": f"""with {_SEQ}, {_L}, c as (select chromosome, "position", base, count(*) n from l group by 1, 2, 3)
select chromosome, "position", base, n from (select *, row_number() over (partition by chromosome, "position" order by n desc, instr('ATGCN', base)) r from c) where r = 1""",
    "motif_statistics": f"with {_SEQ}, {_L}, {_PFM}, {_SHARES} select chromosome, count(*) length, round(sum(c + g) / sum(a + c + g + tt), 6) gc, round(avg(a), 6) mean_a, round(avg(c), 6) mean_c, round(avg(g), 6) mean_g, round(avg(tt), 6) mean_t from m group by 1",
    "motif_file_round_trip": f"with {_SEQ}, {_L}, {_PFM} select 'chr' || chromosome motif, count(*) length, cast(1.0 as double) mean_sum from p group by 1",
    "alignment_columns": f"""with {_SEQ}, {_L} select doc_id, record_no, "position" "column", case when base = 'N' then '-' else base end base,
case when base <> 'N' then cast(sum((base <> 'N')::int) over (partition by doc_id, record_no order by "position") - 1 as integer) else -1 end ungapped from l""",
    "alignment_quality": f"""with {_SEQ}, {_L}, c as (select chromosome, "position", base, count(*) n from l group by 1, 2, 3),
p as (select chromosome, "position", sum(n) n, sum(case when base = 'N' then n else 0 end) gap, coalesce(max(case when base <> 'N' then n end), 0) top from c group by 1, 2)
select chromosome, round(100.0 * sum(gap) / sum(n), 6) gap_pct, round(avg(coalesce(top / nullif(n - gap, 0), 0)), 6) conservation from p group by 1""",
    "regions_parsed": """select distinct variable, snp_index, 'Chr' || chromosome || ':' || region_start || '..' || region_end label, 'Chr' || chromosome chromosome, region_start "start", region_end "end" from gradient_peaks_summary""",
    "sites_parsed": """with n as (select distinct case when peak_index % 3 = 0 then 'bad' else chromosome || '_' || abs_max_pos end "name" from gradient_peaks_summary where abs_max_pos is not null and chromosome is not null and peak_index is not null)
select "name", case when "name" <> 'bad' then cast(split_part("name", '_', 1) as integer) else -1 end site_chromosome, case when "name" <> 'bad' then cast(split_part("name", '_', 2) as bigint) else -1 end site_position,
case when "name" <> 'bad' then cast(split_part("name", '_', 2) as bigint) // 1000 else -1 end site_window from n""",
    "spaced_sites": """with recursive p as (select distinct chromosome, abs_max_pos p from gradient_peaks_summary where abs_max_pos is not null),
k as (select chromosome, min(p) p from p group by 1 union all select k.chromosome, (select min(p.p) from p where p.chromosome is not distinct from k.chromosome and p.p >= k.p + 250000) from k where k.p is not null)
select chromosome, p abs_max_pos from k where p is not null""",
    "merged_regions": """with p as (select distinct chromosome, abs_max_pos p from gradient_peaks_summary where abs_max_pos is not null), s as (select *, case when p - 500 <= lag(p) over (partition by chromosome order by p) + 500 + 500 then 0 else 1 end new from p),
g as (select *, sum(new) over (partition by chromosome order by p) g from s) select chromosome, min(p) - 500 "start", max(p) + 500 "end", cast(count(*) as integer) n from g group by chromosome, g""",
    "exact_windows": """with p as (select distinct chromosome, abs_max_pos from gradient_peaks_summary where abs_max_pos is not null and chromosome is not null), s as (select *, greatest(0, least(abs_max_pos - 256, 30000000 - 512)) "start" from p)
select chromosome, abs_max_pos, "start", least("start" + 512, 30000000) "end" from s""",
    "shifted_windows": """with p as (select distinct max_grad_pos, sequence_length from gradient_peaks_summary where max_grad_pos is not null and sequence_length is not null), s as (select *, greatest(0, least(max_grad_pos - 5, sequence_length - 11)) "first" from p)
select *, least("first" + 11, sequence_length) "last" from s""",
    "window_slices": f"with {_SEQ} select doc_id, record_no, substr(seq, 1, 8) head, substr(seq, greatest(length(seq) - 7, 0) + 1) tail from x",
    "series_zscores": "select user_id, event_id, round(z, 6) + 0.0 z from (select user_id, event_id, (value - avg(value) over (partition by user_id)) / nullif(stddev_pop(value) over (partition by user_id), 0) z from events) where z is not null",
    "greedy_peaks": """with v as (select user_id, cast(floor(epoch(ts) / 60) as bigint) "minute", max(value) v from events group by 1, 2), s as (select user_id, avg(abs(v)) m, stddev_pop(abs(v)) s from v group by 1),
c0 as (select v.user_id, "minute", (abs(v) - m) / s z from v join s using (user_id) where s > 0 and (abs(v) - m) / s >= 1.96),
t0 as (select * from (select *, row_number() over (partition by user_id order by z desc, "minute") r from c0) where r = 1),
c1 as (select c0.* from c0 join t0 using (user_id) where abs(c0."minute" - t0."minute") > 1000), t1 as (select * from (select *, row_number() over (partition by user_id order by z desc, "minute") r from c1) where r = 1),
c2 as (select c1.* from c1 join t1 using (user_id) where abs(c1."minute" - t1."minute") > 1000), t2 as (select * from (select *, row_number() over (partition by user_id order by z desc, "minute") r from c2) where r = 1)
select user_id, 0 peak_index, "minute", round(z, 6) zscore from t0 union all select user_id, 1, "minute", round(z, 6) from t1 union all select user_id, 2, "minute", round(z, 6) from t2""",
    "top_weights": f"with {_W}, {_TOP} select variable, snp_index, embedding_dim, weight, cast(r as integer) \"rank\" from t where r <= 20",
    "negative_weights": f"with {_W}, t as (select *, row_number() over (partition by variable order by weight, snp_index, embedding_dim) r from v where weight < 0) select variable, snp_index, embedding_dim, weight, cast(r as integer) \"rank\" from t where r <= 5",
    "weight_mass": f"""with {_W}, a as (select variable, abs(round(case when weight is null or isnan(weight) then 0 else weight end, 6)) w from w), c as (select *, row_number() over (partition by variable order by w desc) r,
 sum(cast(round(w * 1000000) as bigint)) over (partition by variable order by w desc rows between unbounded preceding and current row) s, sum(cast(round(w * 1000000) as bigint)) over (partition by variable) t from a)
select variable, coalesce(min(case when t > 0 and s >= 0.5 * t then r end), 0) n_50, coalesce(min(case when t > 0 and s >= 0.8 * t then r end), 0) n_80 from c group by 1""",
    "peaks_of_weights": f"""with {_W}, {_TOP}, {_Z}, j as (select t.variable, t.snp_index, t.embedding_dim, t.r, z.peak_index, z.zscore, z.abs_max_pos from t join (select distinct * from z) z on t.variable = z.variable and t.snp_index = z.snp_index and t.embedding_dim = z.embedding_dim where t.r <= 20)
select variable, snp_index, embedding_dim, cast(r as integer) "rank", peak_index, zscore, abs_max_pos from (select *, row_number() over (partition by variable, snp_index, embedding_dim order by zscore desc nulls last, peak_index) k from j) where k = 1""",
}

_CODES = "md5(array_to_string(list_transform(string_split(rpad({s}, cast(n as integer), 'P'), ''), lambda c: case c when 'A' then '0' when 'C' then '1' when 'G' then '2' when 'T' then '3' when 'P' then '-1' else '4' end), ','))"
ORACLES |= {f"{a}_{b}": ORACLES[a] for a, b in (("double_mutants", "all"), ("token_checksum", "whole"), ("variant_places", "whole"))} | {
    "variant_token_arrays": f"""with {_SEQ}, n as (select max(length(seq)) n from x), h as (select *, substr(seq, 1, length(seq) // 2) || 'A' || substr(seq, length(seq) // 2 + 2) m from x),
c as (select *, substr(m, 1, length(seq) - 1) || 'C' alt from h) select doc_id, record_no, {_CODES.format(s='seq')} ref, {_CODES.format(s='alt')} alt,
 {_CODES.format(s="translate(reverse(seq), 'ACGT', 'TGCA')")} ref_rc, {_CODES.format(s="translate(reverse(alt), 'ACGT', 'TGCA')")} alt_rc from c, n""",
}
_PLACED = "long is not null and lat is not null and not isnan(long) and not isnan(lat) and long > -1e30 and lat > -1e30 and long <> -9 and lat <> -9"
_TILES = f"""recursive p as (select fid, iid, long x, lat y from coords_with_bioclim where {_PLACED}), px as (select distinct x from p),
tx as (select min(x) x0 from px union all select (select min(px.x) from px where px.x > tx.x0 + 3.8) from tx where tx.x0 is not null),
ix as (select p.*, x0 from p join tx on x >= x0 and x <= x0 + 3.8), iy as (select distinct x0, y from ix),
ty as (select x0, min(y) y0 from iy group by x0 union all select ty.x0, (select min(iy.y) from iy where iy.x0 = ty.x0 and iy.y > ty.y0 + 3.8) from ty where ty.y0 is not null),
tiles as (select ix.x0 tile_x, y0 tile_y, fid, iid, x, y from ix join ty on ix.x0 = ty.x0 and y >= y0 and y <= y0 + 3.8)"""
ORACLES |= {
    "map_tiles": f"with {_TILES} select tile_x, tile_y, count(*) n, min(x) - 0.1 x0, max(x) + 0.1 x1, min(y) - 0.1 y0, max(y) + 0.1 y1 from tiles group by 1, 2",
    "map_tile_ids": f"with {_TILES} select tile_x, tile_y, fid, iid from tiles",
}
