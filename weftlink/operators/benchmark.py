"""Predictions against truth: overlaps, confusion figures, best sites, bins, random references."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.stats import confusion_metrics, exact_quantile, normal_two_sided, value_counts, with_average_rank
from weftlink.operators.intervals import meeting_intervals, overlap_fraction
from weftlink.operators.numbering import numbered_within, same, small
from weftlink.sources.staging import staged


def truth_by_overlap(predicted: DataFrame, truth: DataFrame, least: float = 0.5, key: str = "id") -> DataFrame:
    """(key, truth): whether a prediction is covered by a true interval to the given share."""
    hit = predicted.join(meeting_intervals(predicted, truth, more=overlap_fraction() >= least), ["chrom", "start", "end"], "left_semi").select(key).distinct()
    return predicted.select(key).join(hit.withColumn("truth", F.lit(1)), key, "left").na.fill(0, ["truth"])


def evaluate(df: DataFrame, predicted: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and figures of binary predictions."""
    c = lambda p, t: F.count(F.when((F.col(predicted) == p) & (F.col(truth) == t), 1))
    n = df.groupBy(*by).agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))
    return n.select("*", *[v.alias(k) for k, v in confusion_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()])


def best_site_per_gene(df: DataFrame, effect: str, score: str, p: str) -> DataFrame:
    """Each gene's site: the largest score where the effect is not positive, else the smallest; ties by p, then site."""
    s = F.when(F.col(effect) > 0, F.col(score)).otherwise(-F.col(score))
    w = Window.partitionBy("gene_key").orderBy(s.asc_nulls_last(), F.col(p).asc_nulls_last(), "peak_id")
    return df.withColumn("i__", F.row_number().over(w)).where("i__ = 1").drop("i__")


def binned_counts(df: DataFrame, value: str, breaks: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, bin, n) with every bin of every group, absent ones 0; a bin holds its upper break."""
    at = F.lit(0)
    for b in breaks:
        at = at + F.when(F.col(value) > b, 1).otherwise(0)
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(breaks) + 1).select(F.col("id").cast("int").alias("bin"))
    return df.select(*by).distinct().crossJoin(F.broadcast(bins)).join(rows, [*by, "bin"], "left").na.fill(0, ["n"])


def versus_random(df: DataFrame, group: str, value: str, predicted: str, by: str, seed: int = 1) -> DataFrame:
    """(by, n, median_predicted, median_random, W, p): predicted rows against as many random others, the first by a hash of
    ``group``, in a rank-sum test: normal form with ties and continuity.

    Others are numbered by their hash, values are ranked by counted values, and all figures are sums, so a comparison of
    any size is many tasks. Rows without a value do not count; W and p are null where a side is empty or all values are one.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(group).cast("string").alias("g"), (F.col(predicted) == 1).cast("int").alias("x"), F.col(value).cast("double").alias("v")).where("x is not null")
    rows = staged(rows, "rows")
    n = staged(rows.groupBy("by").agg(F.sum("x").alias("n")), "sizes")
    n_by = n.count()
    others = rows.where("x = 0").withColumn("h", F.md5(F.concat_ws("|", "g", F.lit(str(seed)))))
    placed = numbered_within(others, ["by"], ["h", "g", "v"], "i")
    some = placed.alias("o").join(small(n, n_by).alias("n"), same("o", "n", ["by"])).where("i < n").select("o.by", "o.x", "o.v")
    chosen = staged(rows.where("x = 1").select("by", "x", "v").unionByName(some), "chosen")
    ranked = with_average_rank(chosen, "v", "rank", ["by"])
    sums = ranked.groupBy("by").agg(F.sum("x").cast("double").alias("nx"), F.sum(1 - F.col("x")).cast("double").alias("ny"), F.sum(F.col("x") * F.col("rank")).alias("rx"))
    ties = value_counts(chosen, "v", ["by"]).groupBy("by").agg(F.sum(F.pow(F.col("n__").cast("double"), 3) - F.col("n__")).alias("ties"))
    middle = exact_quantile(chosen, "v", 0.5, "m", ["by", "x"]).groupBy("by").agg(F.max(F.when(F.col("x") == 1, F.col("m"))).alias("mx"), F.max(F.when(F.col("x") == 0, F.col("m"))).alias("my"))
    both = sums.alias("s").join(small(ties, n_by).alias("t"), same("s", "t", ["by"])).join(small(middle, n_by).alias("m"), same("s", "m", ["by"]))
    both = both.select("s.*", "t.ties", "m.mx", "m.my")
    size, w = F.col("nx") + F.col("ny"), F.col("rx") - F.col("nx") * (F.col("nx") + 1) / 2
    spread = F.col("nx") * F.col("ny") / 12 * (size + 1 - F.try_divide(F.col("ties"), size * (size - 1)))
    off = w - F.col("nx") * F.col("ny") / 2
    z = F.try_divide(off - F.signum(off) * 0.5, F.sqrt(F.when(spread > 1e-12, spread)))
    tested = (F.col("nx") > 0) & (F.col("ny") > 0)
    return both.select(F.col("by").alias(by), F.col("nx").cast("long").alias("n"), F.col("mx").alias("median_predicted"), F.col("my").alias("median_random"), F.when(tested, w).alias("W"), normal_two_sided(F.when(tested, z)).alias("p"))


def normal_reference(values: Sequence[float], n: int) -> list[int]:
    """Places of n values nearest to the quantiles of a normal with the values' mean and spread, each used once."""
    from statistics import NormalDist

    v = np.asarray(values, float)
    dist = NormalDist(float(v.mean()), float(v.std(ddof=1)) or 1.0)
    free, out = np.ones(len(v), bool), []
    for i in range(min(n, len(v))):
        gap = np.where(free, np.abs(v - dist.inv_cdf((i + 0.5) / n)), np.inf)
        out.append(int(np.argmin(gap)))
        free[out[-1]] = False
    return out


def concordance(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("tf", "gene_key", "peak_id")) -> DataFrame:
    """(topic_a, topic_b, n, share): links that two topic assignments share."""
    both = a.select(*keys, F.col("topic").alias("topic_a")).distinct().join(b.select(*keys, F.col("topic").alias("topic_b")).distinct(), list(keys))
    n = both.groupBy("topic_a", "topic_b").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("topic_a")))
