"""Results that grow: only pairs, batches or chunks that are new are computed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def fingerprint(parameters: dict) -> str:
    """A name for a set of parameters: equal values, equal name."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def extend(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], parameters: dict | None = None) -> DataFrame:
    """Compute the wanted keys that the table at ``path`` lacks, append them, and return all wanted rows.

    Results of other ``parameters`` are another table: a changed threshold never meets old rows.
    """
    path = path if parameters is None else f"{path}/parameters={fingerprint(parameters)}"
    known = stored(spark, path)
    fresh = wanted.select(*keys).distinct()
    if known is not None:
        fresh = fresh.join(known.select(*keys).distinct(), list(keys), "left_anti")
    compute(fresh).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def stream_pairs(pairs: DataFrame, path: str, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], checkpoint: str, parameters: dict | None = None):
    """A query that computes each new pair of a stream once and appends it to the table at ``path``."""

    def batch(df: DataFrame, _: int) -> None:
        extend(df.sparkSession, path, df, keys, compute, parameters)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
