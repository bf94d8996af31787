"""Getting this package to the Python workers."""

from __future__ import annotations

import io
import os
import site
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def _found_anyway(master: str) -> bool:
    """Workers on this machine inherit the working directory and PYTHONPATH, and see what is installed."""
    if not master.startswith("local"):
        return False
    parent = str(_HERE.parent)
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    return parent in {os.path.realpath(p) for p in places if p}


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, unless the workers find it without that. Once per application."""
    from .sources.store import scratch

    sc = spark.sparkContext
    if sc.applicationId in _shipped or _found_anyway(sc.master):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_HERE.rglob("*.py")):
            out.write(path, str(path.relative_to(_HERE.parent)))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{_HERE.name}-{uuid.uuid4().hex}.zip")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(target.toString())
    _shipped.add(sc.applicationId)
