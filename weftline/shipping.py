"""Makes this package importable on executors that do not have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session once; does nothing where PYTHONPATH already has it. The driver
    serves the zip to executors whenever they ask, so it is kept until the driver ends."""
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="weftline-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "weftline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    context._weftline_shipped = True
