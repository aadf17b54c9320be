"""Tables: typed CSV and TSV, genotype matrices, phenotype files, cached outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasieve.sources.text import FAM_COLUMNS


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    sep: str = ",",
    comment: str | None = None,
) -> DataFrame:
    """A delimited table with header. Give the schema where it is fixed: without one the file is read twice."""
    options = {"header": True, "sep": sep, "nanValue": "NaN"} | ({"comment": comment} if comment else {})
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_environment(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """An environment table: ids as longs, every other column as a double, with names as the header has them."""
    header = spark.read.text(path).limit(1).collect()[0][0].split(sep)
    kinds = {"fid": T.LongType(), "iid": T.LongType()}
    return read_table(spark, path, T.StructType([T.StructField(c, kinds.get(c.lower(), T.DoubleType())) for c in header]), sep)


def read_genotypes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(CHROM, POS, INDEL, gt): a genotype matrix with one column per accession, as an array of calls per site.

    The schema is made from the header, so no pass infers it; empty calls are missing (3).
    """
    header = spark.read.text(path).limit(1).collect()[0][0].split(sep)
    fixed = {"CHROM": T.ByteType(), "POS": T.LongType(), "INDEL": T.BooleanType()}
    wide = read_table(spark, path, T.StructType([T.StructField(c, fixed.get(c, T.ByteType())) for c in header]), sep)
    calls = [F.coalesce(F.col(f"`{c}`"), F.lit(3).cast("byte")) for c in header if c not in fixed]
    return wide.select(*fixed, F.array(*calls).alias("gt"))


def write_table(
    df: DataFrame,
    path: str,
    form: str = "parquet",
    force: bool = False,
    partition_by: tuple[str, ...] = (),
    **options: object,
) -> None:
    """Writes unless the output exists; ``force`` replaces it."""
    writer = df.write.mode("overwrite" if force else "ignore").options(**({"header": True} if form == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def phenotype_lines(
    fam: DataFrame,
    values: DataFrame,
    key: str = "iid",
    value: str = "value",
    missing: float = -9.0,
) -> DataFrame:
    """``value`` lines of a phenotype file whose last column is replaced by each individual's value, ``missing`` where there is none."""
    v = values.select(F.col(key).cast("string").alias("__k"), F.col(value).alias("__v")).dropDuplicates(["__k"])
    joined = fam.join(v, F.col("iid") == F.col("__k"), "left")
    return joined.select(
        F.concat_ws(" ", *[F.col(c) for c in FAM_COLUMNS[:-1]], F.coalesce("__v", F.lit(missing)).cast("string")).alias("value")
    )


def write_phenotypes(fam: DataFrame, long: DataFrame, path: str) -> None:
    """One phenotype file set per (split, variable) of ``long`` (iid, split, variable, value), in directories named by both."""
    joined = fam.join(long.withColumn("iid", F.col("iid").cast("string")), "iid")
    line = F.concat_ws(" ", *[F.col(c) for c in FAM_COLUMNS[:-1]], F.col("value").cast("string"))
    joined.select("split", "variable", line.alias("value")).write.mode("overwrite").partitionBy("split", "variable").text(path)


def rename_sites(bim: DataFrame, chrom: str = "chrom", pos: str = "pos", name: str = "id") -> DataFrame:
    """Site names as ``chrom_pos``."""
    return bim.withColumn(name, F.concat_ws("_", F.col(chrom).cast("string"), F.col(pos).cast("string")))
