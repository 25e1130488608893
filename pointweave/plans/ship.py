"""Sends this package to the executors where they can't import it themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package as a zip, served by the driver. Nothing is sent
    where PYTHONPATH, which workers inherit, holds the package."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    known = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _SENT or str(root.parent) in known or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="pointweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "pointweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)
