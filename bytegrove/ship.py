"""The package on executors: Python stages are sent by reference, so each executor must be able to import it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ensure(spark: SparkSession) -> None:
    """Adds the package to the application once, as a zip that Spark gives to every executor, late ones included."""
    sc = spark.sparkContext
    if getattr(sc, "_bytegrove_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # The application serves the file from where it lies, so it stays until the driver ends.
    tmp = tempfile.mkdtemp(prefix="bytegrove-package-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    path = os.path.join(tmp, f"bytegrove_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("bytegrove", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._bytegrove_shipped = True
