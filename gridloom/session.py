"""Session helpers: the folder that driver and executors share, and the package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_folders: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs in one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _folders[key]


def ensure_importable(spark: SparkSession) -> None:
    """Sends this package to the workers unless their path has it already (same folder or PYTHONPATH)."""
    known = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p)]
    key = spark.sparkContext.applicationId
    if key in _shipped or any(p.resolve() == ROOT for p in known):
        return
    _shipped.add(key)
    folder = tempfile.mkdtemp(prefix="gridloom-package-")
    target = f"{folder}/gridloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "gridloom").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(target)
