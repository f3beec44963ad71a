"""Send this package to Python workers, wherever the driver has it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once for each Spark context: Spark itself hands the archive from the driver to every executor."""
    context = spark.sparkContext
    if getattr(context, "_segno_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="segno-")) / "segno.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    context._segno_shipped = True
