"""Line and record formats: id lists, counts, phenotype files, JSON splits, FASTA, motif files.

Every reader is one scan whose splitting Spark does; parsing is column work. Lines that don't parse give no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch

FAM_COLUMNS = ("fid", "iid", "father", "mother", "sex", "phenotype")


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def read_whitespace_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A table without header whose fields are separated by any white space, as strings; missing last fields are NULL."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(_fields(F.col("value")).alias("f"))
    return rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    rows = read_whitespace_table(spark, path, FAM_COLUMNS)
    return rows.withColumn("phenotype", F.col("phenotype").try_cast("double"))


def read_id_list(spark: SparkSession, path: str, two_column: bool = False) -> DataFrame:
    """(iid): identifiers separated by white space; of a two-column list the first of each line. Distinct."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(_fields(F.col("value")).alias("f"))
    ids = rows.select(F.get("f", F.lit(0)).alias("iid")) if two_column else rows.select(F.explode("f").alias("iid"))
    return ids.filter("iid <> ''").dropDuplicates()


def write_id_list(ids: DataFrame, path: str, key: str = "iid", two_column: bool = False) -> None:
    k = F.col(key).cast("string")
    ids.select(F.concat_ws(" ", k, k) if two_column else k).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(id, n) of lines ``id: n``; a colon at the end of the id is dropped."""
    parts = spark.read.text(path).select(
        *[F.regexp_extract("value", r"^\s*(.+?):?\s*:\s*(\d{1,18})\s*$", i).alias(c) for i, c in ((1, "id"), (2, "n"))]
    )
    return parts.filter("n <> ''").select("id", F.col("n").cast("long").alias("n"))


def read_json_splits(spark: SparkSession, path: str, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """(iid, split) of a JSON object that lists identifiers under each split's name."""
    schema = ", ".join(f"`{n}` array<string>" for n in names)
    wide = spark.read.schema(schema).json(path, multiLine=True)
    rows = [F.struct(F.lit(n).alias("split"), F.coalesce(n, F.array().cast("array<string>")).alias("ids")) for n in names]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select(F.explode("r.ids").alias("iid"), "r.split")


def _fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): a record each, without its mark. Records part where a line starts with the mark, so a header may hold one."""
    body = spark.read.text(path, lineSep="\n>").select("*", "_metadata.file_path", "_metadata.file_block_start")
    return body.withColumn("value", F.regexp_replace("value", r"^\s*>", "")).filter(F.length(F.trim("value")) > 0)


def _header_and_seq() -> list[Column]:
    rest = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return [
        F.trim(F.substring_index("value", "\n", 1)).alias("header"),
        F.upper(F.regexp_replace(rest, r"\s+", "")).alias("seq"),
    ]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq): one row per record, upper case, line breaks removed, in no order."""
    return _fasta_records(spark, path).select(*_header_and_seq())


def read_numbered_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, header, seq): records numbered from 0 in the order of the files' names and of the records in them.

    A task reads a block of a file from its start to its end, so the file, the block's start and the order of reading
    give each record's place. Writes a table.
    """
    rows = _fasta_records(spark, path).withColumn("nth", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("file_path", "file_block_start", "nth")]
    placed = global_positions(rows, [], order, Scratch(spark, "fasta"), "records")
    return placed.select(F.col("position").alias("record_no"), *_header_and_seq())


def wrapped_record(header: Column, seq: Column, width: int = 80) -> Column:
    """One FASTA record, its sequence broken into lines."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n"))


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", width: int = 80) -> None:
    df.select(wrapped_record(F.col(header), F.col(seq), width)).write.mode("overwrite").text(path)


def region_headers(df: DataFrame, header: str = "header") -> DataFrame:
    """Adds accession (first field), chromosome, start, end of headers ``a|b|c|d|Chr1:s..e|v``; records of other headers go."""
    p = r"^([^|]*)\|.*?Chr(\d+):(\d{1,18})\.\.(\d{1,18})"
    got = df.withColumns(
        {c: F.regexp_extract(header, p, i + 1) for i, c in enumerate(("accession", "chromosome", "start", "end"))}
    ).filter("end <> ''")
    return got.withColumns(
        {"chromosome": F.col("chromosome").cast("int"), "start": F.col("start").cast("long"), "end": F.col("end").cast("long")}
    )


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(motif, position, p_a, p_c, p_g, p_t) of a motif file with blocks ``MOTIF name`` and rows of four numbers."""
    blocks = spark.read.text(path, lineSep="MOTIF ").filter(~F.col("value").startswith("MEME version"))
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    number = r"(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    lines = F.regexp_extract_all("value", F.lit(rf"(?m)^\s*({number}\s+{number}\s+{number}\s+{number})\s*$"), F.lit(1))
    rows = blocks.select(name.alias("motif"), F.posexplode(lines).alias("position", "line")).filter("motif <> ''")
    return rows.select(
        "motif",
        "position",
        *[F.get(_fields(F.col("line")), F.lit(i)).cast("double").alias(f"p_{b}") for i, b in enumerate("acgt")],
    )


def write_motifs(pwm: DataFrame, path: str) -> None:
    """A motif file of (motif, position, p_a, p_c, p_g, p_t), four decimals; blocks in a directory of parts, the header in each block's part."""
    line = F.format_string("%.4f %.4f %.4f %.4f", "p_a", "p_c", "p_g", "p_t")
    rows = pwm.select(
        "motif",
        F.struct("position", line.alias("line")).alias("r"),
    ).groupBy("motif").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    text = F.concat(
        F.lit("MOTIF "),
        "motif",
        F.lit("\nletter-probability matrix: alength= 4 w= "),
        F.size("rs").cast("string"),
        F.lit("\n"),
        F.array_join(F.transform("rs", lambda r: r["line"]), "\n"),
        F.lit("\n"),
    )
    rows.select(text).write.mode("overwrite").text(path)


def with_path_parts(df: DataFrame, pattern: str, parts: Sequence[str]) -> DataFrame:
    """Adds what the groups of ``pattern`` find in the path of each row's file; rows of other files go."""
    path = F.col("_metadata.file_path")
    out = df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(p) for i, p in enumerate(parts)])
    return out.filter(F.concat(*[F.col(p) for p in parts]) != "")
