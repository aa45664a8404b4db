"""Makes the library importable for Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library's sources to the workers, once per application, unless their path leads to it anyway."""
    context = spark.sparkContext
    seen = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), ""]}
    if ROOT in seen or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="terradelta-ship-")) / "terradelta.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in [*ROOT.glob("terradelta/**/*.py"), *ROOT.glob("*.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
