"""Tables written to the folder that all executors share.

An iterative operator cuts its lineage by writing a round to Parquet and reading it back. Unlike
``DataFrame.checkpoint`` the plan runs once and the copy is columnar and compressed; unlike a local
checkpoint it survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("terrasieve.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="terrasieve-")
        spark.conf.set("terrasieve.scratch", named)
    return named.rstrip("/")


class Scratch:
    """A family of scratch tables of one operator call; ``drop`` frees a round that is no longer read."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"
        _written.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, root in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # the session may be gone; the folder's owner cleans up then
            return
