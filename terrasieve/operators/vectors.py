"""Embeddings: pooling, assembly, feature indexes, linear models over them, and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.operators.clean import require_columns
from terrasieve.operators.effects import dot
from terrasieve.plans.positions import global_positions
from terrasieve.plans.scratch import Scratch


def pooled(df: DataFrame, group: Sequence[str], vector: str, how: str = "max") -> DataFrame:
    """(group, vector): elementwise max or mean over the rows of a group.

    Vectors are exploded to (index, value), combined before the shuffle, and gathered again by index.
    """
    flat = df.select(*group, F.posexplode(vector).alias("i", "v")).groupBy(*group, "i").agg(
        (F.max("v") if how == "max" else F.avg(F.col("v").cast("double"))).alias("v")
    )
    return flat.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(vector))


def strand_average(forward: Column, backward: Column) -> Column:
    """Mean of a series and the flipped series of the other strand."""
    return F.zip_with(forward, F.reverse(backward), lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def flattened(df: DataFrame, group: Sequence[str], order: str, vector: str) -> DataFrame:
    """A group's vectors in order, joined into one. A group is one accession's regions."""
    return df.groupBy(*group).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, vector))), lambda s: s[vector])).alias(vector)
    )


def nested_regions(df: DataFrame, keys: Sequence[str], nested: str) -> DataFrame:
    """(keys, chromosome, region, embedding): a list of chromosomes, each a list of region vectors, as one row a region.

    Chromosomes count from 1 and regions from 0 through all chromosomes, in order; vectors come as floats, and empty
    or null chromosomes and a null list give no rows.
    """
    chromosomes = df.select(*keys, F.col(nested).alias("__all"), F.posexplode(nested).alias("__c", "__regions"))
    before = F.aggregate(F.slice("__all", 1, F.col("__c")), F.lit(0), lambda n, c: n + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))
    rows = chromosomes.select(*keys, (F.col("__c") + 1).alias("chromosome"), before.alias("__before"), F.posexplode("__regions").alias("__r", "__v"))
    return rows.select(*keys, "chromosome", (F.col("__before") + F.col("__r")).alias("region"), F.col("__v").cast("array<float>").alias("embedding"))


def replace_row(matrix: Column, row: Column, values: Column) -> Column:
    """A matrix (array of arrays) with one row replaced."""
    return F.transform(matrix, lambda x, i: F.when(i == row, values).otherwise(x))


def feature_place(index: Column, dim: int) -> tuple[Column, Column]:
    """(region, dimension) of a feature index."""
    return F.floor(index / dim).cast("int"), F.pmod(index, F.lit(dim)).cast("int")


def explained_coefficients(models: DataFrame, coefs: str, dim: int) -> DataFrame:
    """(variable, snp_index, embedding_dim, weight): a model's coefficient vector, one row per feature."""
    rows = models.select("variable", F.posexplode(coefs).alias("i", "weight"))
    region, d = feature_place(F.col("i"), dim)
    return rows.select(
        "variable",
        region.alias("snp_index"),
        d.alias("embedding_dim"),
        F.col("weight").cast("double").alias("weight"),
    )


def linear_prediction(
    vectors: DataFrame,
    vector: str,
    weights: Column,
    intercept: float = 0.0,
    name: str = "prediction",
) -> DataFrame:
    return vectors.withColumn(name, dot(F.col(vector), weights) + F.lit(intercept))


def principal_components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """(component, share): the share of variance of the first k components; the covariance is aggregated, never collected rows."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    shares = [(i + 1, float(x)) for i, x in enumerate(model.explainedVariance)]
    return df.sparkSession.createDataFrame(shares, "component int, share double")


def truncated_svd(df: DataFrame, group: Sequence[str], order: str, vector: str, k: int) -> DataFrame:
    """(group, reduced): a group's matrix (rows in order) projected on its first k right singular vectors, flattened.

    Kept as it is where it has at most k columns. The sign of each component is fixed so that its largest loading is
    positive. A group is one accession's regions.
    """

    def reduce_(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf.sort_values(order)[vector].tolist(), np.float64)
        if m.shape[1] > k:
            _, _, vt = np.linalg.svd(m, full_matrices=False)
            vt = vt[:k]
            flip = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
            m = m @ (vt * np.where(flip == 0, 1, flip)[:, None]).T
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "reduced": [m.ravel().tolist()]})

    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return df.select(*group, order, vector).groupBy(*group).applyInPandas(reduce_, f"{fields}, reduced array<double>")


#: What a stored model must hold.
MODEL_COLUMNS = ("target", "alpha", "coefs", "intercept")


def write_model(model: DataFrame, path: str) -> None:
    require_columns(model, MODEL_COLUMNS).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A stored model, or a ValueError that names what it lacks."""
    return require_columns(spark.read.parquet(path), MODEL_COLUMNS)


def zipped(a: DataFrame, b: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column]) -> DataFrame:
    """Rows of two tables side by side in their orders; a ValueError if they differ in number. Columns of ``b`` must not clash. Writes tables."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows can't be zipped with {m}")
    scratch = Scratch(a.sparkSession, "zip")
    left = global_positions(a, [], order_a, scratch, "left", as_="__nth")
    right = global_positions(b, [], order_b, scratch, "right", as_="__nth")
    return left.join(right, "__nth").drop("__nth")
