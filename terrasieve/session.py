"""Session defaults for local work, and the package's code for executors; on a cluster the submitted configuration wins."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "terrasieve", memory: str = "8g") -> SparkSession:
    """A local session as the tests and the benchmark use it: UTC, AQE, few shuffle partitions."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once per application, so that their Python can import it.

    The registered queries call this; where the package is installed on every machine it changes nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_terrasieve_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="terrasieve-code-")) / "terrasieve-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(archive))
    context._terrasieve_shipped = True
