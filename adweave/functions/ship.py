"""The package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of ``spark``, once for each application.

    Functions that run in workers are pickled by name, so a worker imports them.
    Spark hands the archive to each executor, wherever it was started; where the
    package is installed there, or its folder is on their path, this changes nothing.
    """
    name = f"{PACKAGE.name}-{spark.sparkContext.applicationId}.zip"
    if name in spark.sparkContext._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
