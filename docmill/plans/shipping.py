"""Makes the package importable where the tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once a context.

    Not needed where it is installed or on the ``PYTHONPATH`` that workers inherit.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in ROOT.parts:
        return
    target = Path(tempfile.mkdtemp(prefix="docmill-")) / "docmill_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "docmill").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
