"""Make this package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    path = Path(tempfile.mkdtemp(prefix="textloom-src-")) / "textloom_src.zip"
    path.write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
