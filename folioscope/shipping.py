"""Giving the package to the Python workers of a session."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per context.

    Functions that run in workers are found by module name; a worker has the package only
    if its path does, or if the session brings it along.
    """
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False) or not _ROOT.is_dir():
        return
    sources = sorted(_ROOT.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:16]
    archive = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), f"folioscope-{digest}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sources:
            z.write(p, f"folioscope/{p.relative_to(_ROOT)}")
    context.addPyFile(archive)
    context._folioscope_shipped = True
