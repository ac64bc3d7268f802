"""Makes the package importable in Python workers, wherever the session runs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Gives the executors the package's modules, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_talentweave_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{_PACKAGE.name}_modules.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(_PACKAGE.rglob("*.py")):
            out.write(file, str(file.relative_to(_PACKAGE.parent)))
    context.addPyFile(str(path))
    context._talentweave_shipped = True
