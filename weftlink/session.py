"""Session settings that the engine's plans are made for."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive plans, split skewed joins, sums before shuffles, UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def ship(spark: SparkSession) -> None:
    """Give executors this package, where they do not have it installed: Python functions name its modules."""
    home, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            # A fixed time: equal sources give equal archives.
            z.writestr(zipfile.ZipInfo(str(file.relative_to(home.parent)), (2020, 1, 1, 0, 0, 0)), file.read_bytes())
    # The driver's own copy; the session hands it to every executor.
    path = os.path.join(tempfile.mkdtemp(prefix="weftlink-package-"), "weftlink.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)


def session(name: str = "weftlink", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings, whose executors have the package; ``more`` adds settings with ``__`` for ``.``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark
