"""Make the package importable on the executors of a cluster that doesn't have it installed."""

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application; the driver serves the file to them."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        folder = tempfile.mkdtemp(prefix="scholarmill-src-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = os.path.join(folder, f"{ROOT.name}.zip")
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        spark.sparkContext.addPyFile(at)
    return spark
