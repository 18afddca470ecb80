"""Sending this package to the Python workers of an application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's code to the application once, through Spark's own file server, so that workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="weftline-code-")) / "weftline-code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(package.rglob("*.py")):
            out.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
