"""Sessions: defaults for local runs, and shipping of this package to executors."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, use its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spandrel")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once a context; then Python workers find it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_spandrel_shipped", False):
        root = pathlib.Path(__file__).resolve().parent
        path = pathlib.Path(tempfile.mkdtemp(prefix="spandrel-")) / "spandrel_package.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        context._spandrel_shipped = True
    return spark
