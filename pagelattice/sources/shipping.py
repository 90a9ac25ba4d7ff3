"""Makes the package importable in Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once an application, unless PYTHONPATH leads them to it already."""
    package = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="pagelattice-")).resolve() / "pagelattice_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
