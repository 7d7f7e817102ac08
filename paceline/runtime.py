"""What jobs need on executors before Python functions of this package can run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_paceline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="paceline-")) / "paceline_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    context.addPyFile(str(to))
    context._paceline_shipped = True
