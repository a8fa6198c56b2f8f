"""Staging: results written to the folder that a cluster shares, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, or bytes, of a staged table whose size is known beforehand that go into one file.
FILE_ROWS, FILE_BYTES = 50_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on one machine, as in tests, a temporary folder is made and set; a cluster has to
    name one, as its machines do not see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="weftlink-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = "file://" + made
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weftlink/{label}-{uuid.uuid4().hex[:12]}"


def table_bytes(df: DataFrame) -> float:
    """Bytes of ``df`` by the planner's estimate: for tables that are read, those of their files."""
    # As text: the estimate of a join may be beyond 64 bits.
    number, unit = df._jdf.queryExecution().optimizedPlan().stats().simpleString().split(",")[0].removeprefix("sizeInBytes=").split()
    return float(number) * 1024 ** ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB").index(unit)


def staged(df: DataFrame, label: str, rows: int | None = None, like: DataFrame | None = None, records: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    ``rows`` is a known upper bound of its rows: a table known to be small goes into few files. ``like`` is a
    table that it is at most about as large as: files are no smaller than ``FILE_BYTES``, but for two a core.
    Both are for plans that end with a shuffle and little work after it, as files are also tasks. ``records`` is the most
    rows of a file, where rows are long.
    """
    spark = df.sparkSession
    path, files = new_path(spark, label), None
    if rows is not None:
        files = -(-rows // FILE_ROWS)
    elif like is not None:
        files = int(min(max(2 * spark.sparkContext.defaultParallelism, table_bytes(like) // FILE_BYTES), 1 << 30))
    (df if files is None else df.coalesce(max(1, files))).write.option("maxRecordsPerFile", records).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with a number that follows ``order``: sorted by range over all tasks, so no task sorts everything.

    ``order`` must tell all rows apart; then a task that runs again gives the same numbers.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
