"""Sessions: defaults, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str = "local[8]", app: str = "tessera", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library is tested under; ANSI arithmetic and adaptive plans stay on."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files, once, so executors can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-tessera-")  # the driver serves the file from there as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
