"""Sends this package to the executors' Python workers, which may not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        if root.suffix != ".zip" and root.is_dir():
            at = Path(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
            with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            sc.addPyFile(str(at))
        _SENT.add(sc.applicationId)
    return spark
