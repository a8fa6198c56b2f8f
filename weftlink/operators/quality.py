"""Summaries that tell how a step went: merged sites, normalisation, expression, correlation, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_summary(site_map: DataFrame) -> DataFrame:
    """(group_size, n_groups, n_sites): how many sites became one."""
    one = site_map.groupBy("merged_id").agg(F.max("group_size").alias("group_size"))
    return one.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("group_size").alias("n_sites"))


def normalisation_summary(before: DataFrame, after: DataFrame, threshold: float) -> DataFrame:
    """(stage, sample, mean, median, n_over): distributions of scores before and after."""
    rows = before.select(F.lit("before").alias("stage"), "sample", "value").unionByName(after.select(F.lit("after").alias("stage"), "sample", "value"))
    return rows.groupBy("stage", "sample").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.count(F.when(F.col("value") >= threshold, 1)).alias("n_over"))


def expression_summary(rna: DataFrame, threshold: float) -> DataFrame:
    """(sample, n_expressed, n_genes)."""
    return rna.groupBy("sample").agg(F.countDistinct(F.when(F.col("value") >= threshold, F.col("gene"))).alias("n_expressed"), F.countDistinct("gene").alias("n_genes"))


def correlation_summary(stats: DataFrame, by: Sequence[str] = (), bins: int = 20, r_min: float = 0.3, q_max: float = 0.05) -> DataFrame:
    """(by, bin, n, n_pass): histogram of r from -1 to 1."""
    ok = (F.col("r") > r_min) & (F.col("p_adj") < q_max)
    at = F.least(F.floor((F.col("r") + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    return stats.where("r is not null").groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_pass"))


def activity_totals(status: DataFrame) -> DataFrame:
    """(condition, n_active, n_links, share)."""
    return status.groupBy("condition").agg(F.count(F.when(F.col("active") > 0, 1)).alias("n_active"), F.count(F.lit(1)).alias("n_links")).withColumn("share", F.col("n_active") / F.col("n_links"))
