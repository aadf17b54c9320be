"""Incremental ingestion of files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    out: str,
    checkpoint: str,
    form: str = "csv",
    **options: object,
) -> StreamingQuery:
    """Appends the rows of files not seen before to a Parquet table and stops when all are read.

    The checkpoint remembers what was read, so a second call adds only new files. Returns the finished query.
    """
    source = spark.readStream.schema(schema).format(form).options(
        **({"header": True} if form == "csv" else {}) | options
    ).load(folder)
    rows = source.withColumn("source_file", F.col("_metadata.file_name"))
    query = rows.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation",
        checkpoint,
    ).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_means(stream: DataFrame, time: str, value: str, group: str, width: str, late: str) -> DataFrame:
    """(group, start, n, mean) per tumbling window of event time; rows later than ``late`` behind the newest are dropped, which bounds the state."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(group, w).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(
        group,
        F.col("window.start").alias("start"),
        "n",
        "mean",
    )
