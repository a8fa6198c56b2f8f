"""Statistics as expressions and windows: ranks, t tails, false discovery rates, robust scores, gamma, Fisher."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftlink.sources.staging import staged


def average_rank(value: str, by: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank from 1 with tied values averaged; null values have no rank. For groups that one task can sort."""
    x = F.col(value)
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    w = Window.partitionBy(*by)
    peers = F.count(x).over(Window.partitionBy(*by, value))
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(order)) + (peers - 1) / 2)


def value_bucket(x: Column) -> Column:
    """A bucket that grows with a number: 256 to each doubling of its size, at most about 1.1 million."""
    size = F.floor(F.log2(F.abs(x)) * 256).cast("long") + 300_000
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """(by, x__, n__, below__) of every distinct value: how often it occurs, and how many lie before it.

    Values are counted first and placed within buckets of their size, so neither a group of any size nor
    a value that very many rows share is one task's work.
    """
    own = list(by)
    some = df.where(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("x__")).agg(F.count(F.lit(1)).alias("n__")).withColumn("b__", value_bucket(F.col("x__")))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    sums = some.groupBy(*own, "b__").agg(F.sum("n__").alias("s__"))
    sums = sums.select(*own, "b__", (F.sum("s__").over(Window.partitionBy(*own).orderBy(order("b__"))) - F.col("s__")).alias("before__"))
    inside = F.sum("n__").over(Window.partitionBy(*own, "b__").orderBy(order("x__")))
    placed = some.alias("a").join(sums.alias("s"), _same("a", "s", own, "b__")).select("a.*", "s.before__")
    return placed.select(*own, "x__", "n__", (F.col("before__") + inside - F.col("n__")).alias("below__"))


def _same(a: str, b: str, own: Sequence[str], value: str) -> list[Column]:
    """Null-safe equality of the group, plain equality of the value."""
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in own] + [F.col(f"{a}.{value}") == F.col(f"{b}.{value}")]


def with_average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = False, counted: DataFrame | None = None, held: int = 0) -> DataFrame:
    """Adds the rank from 1 with tied values averaged; null values have no rank. ``counted`` is a cheaper table of the
    same rows to count from. Where there are at most ``held`` distinct values, their ranks are staged, counted and
    broadcast, so the rows are not shuffled."""
    own = list(by)
    ranks = value_counts(df if counted is None else counted, value, own, descending).select(*own, "x__", (F.col("below__") + (F.col("n__") + 1) / 2).alias(out))
    if held:
        ranks = staged(ranks, "ranks")
        ranks = F.broadcast(ranks) if ranks.count() <= held else ranks
    rows = df.withColumn("x__", F.col(value).cast("double"))
    return rows.alias("r").join(ranks.alias("k"), _same("r", "k", own, "x__"), "left").select("r.*", f"k.{out}").drop("x__")


def exact_quantile(df: DataFrame, value: str, q: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, out): the q-quantile of the values that are not null, between two places in proportion; one row with null
    for no values at all. Values are counted, not gathered, so a table of any size will do."""
    own = list(by)
    counts = value_counts(df, value, own)
    total = counts.groupBy(*own).agg(((F.sum("n__") - 1) * q).alias("h__"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"t.{c}")) for c in own]
    held = (counts.alias("c").join(total.alias("t"), same) if own else counts.alias("c").crossJoin(F.broadcast(total.alias("t")))).select("c.*", "t.h__")
    at = lambda i: F.max(F.when((F.col("below__") <= i) & (i < F.col("below__") + F.col("n__")), F.col("x__")))
    found = held.groupBy(*own).agg(at(F.floor("h__")).alias("lo__"), at(F.ceil("h__")).alias("hi__"), F.max(F.col("h__") - F.floor("h__")).alias("part__"))
    return found.select(*own, (F.col("lo__") + F.col("part__") * (F.col("hi__") - F.col("lo__"))).alias(out))


def min_rank(value: str, by: Sequence[str] = (), descending: bool = False) -> Column:
    x = F.col(value)
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom.

    The tail is a finite sum over powers of sqrt(1 - r^2); its error is about 1e-15.
    Null where r is null or n < 3; 0 where |r| >= 1.
    """
    df = n - 2
    s = F.least(F.abs(r), F.lit(1.0))
    c2 = F.lit(1.0) - s * s
    grown = lambda even, t, j: t * ((2.0 * j - 1) / (2.0 * j) if even else 2.0 * j / (2.0 * j + 1)) * c2
    step = lambda even: lambda acc, j: F.struct(grown(even, acc["t"], j).alias("t"), (acc["s"] + grown(even, acc["t"], j)).alias("s"))
    n_even, n_odd = F.floor((df - 2) / 2).cast("int"), F.floor((df - 3) / 2).cast("int")
    terms = lambda m: F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    even = F.aggregate(terms(n_even), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step(True))["s"] * s
    c = F.sqrt(c2)
    odd_sum = F.aggregate(terms(n_odd), F.struct(c.alias("t"), c.alias("s")), step(False))["s"]
    odd = F.lit(2 / math.pi) * (F.asin(s) + F.when(df > 1, s * odd_sum).otherwise(0.0))
    p = F.lit(1.0) - F.when(df % 2 == 0, even).otherwise(odd)
    return F.when((n >= 3) & r.isNotNull(), F.when(s >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), p)))


def _p_bucket(p: Column) -> Column:
    """A bucket that grows with p, fine where p is small."""
    return F.when(p <= 0, -100_000).when(p < 0.01, F.floor(F.log10(p) * 50)).otherwise(F.floor(p * 4096)).cast("long")


def benjamini_hochberg(df: DataFrame, p: str, out: str, family: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Adds adjusted p-values; null p take no part. Each family (all rows by default) is a set of tests; a row is one of
    them, or ``count`` of them.

    Distinct p are counted first; their ranks and running minima are taken within buckets of p and joined
    through one small row a bucket, so a family of any size, and a p that very many rows share, is
    dealt over many tasks. Rows with null p go past all that. The tests are staged first: they are needed more
    than once, and a condition on p would otherwise be pushed into, and repeat, the expression that made p.
    """
    own, df = list(family), staged(df, "tests")
    some = df.where(F.col(p).isNotNull()).groupBy(*own, F.col(p).alias("p__")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n__")).withColumn("b__", _p_bucket(F.col("p__")))
    # Buckets are at most 20,000 a family by their rule, so one family's are small enough for any join.
    few = (lambda t: t) if own else F.broadcast
    sums = some.groupBy(*own, "b__").agg(F.sum("n__").alias("s__"))
    w = Window.partitionBy(*own)
    sums = sums.select(*own, "b__", F.sum("s__").over(w).alias("m__"), (F.sum("s__").over(w.orderBy("b__")) - F.col("s__")).alias("below__"))
    inside = Window.partitionBy(*own, "b__").orderBy("p__")
    placed = some.alias("a").join(few(sums.alias("s")), _same("a", "s", own, "b__")).select("a.*", "s.m__", "s.below__")
    ranked = placed.withColumn("raw__", F.col("p__") * F.col("m__") / (F.col("below__") + F.sum("n__").over(inside)))
    after = Window.partitionBy(*own).orderBy(F.desc("b__")).rowsBetween(Window.unboundedPreceding, -1)
    lows = ranked.groupBy(*own, "b__").agg(F.min("raw__").alias("low__")).select(*own, "b__", F.min("low__").over(after).alias("rest__"))
    down = Window.partitionBy(*own, "b__").orderBy(F.desc("p__"))
    both = ranked.alias("a").join(few(lows.alias("l")), _same("a", "l", own, "b__")).select("a.*", "l.rest__")
    q = both.select(*own, "p__", F.least(F.lit(1.0), F.min("raw__").over(down), F.coalesce("rest__", F.lit(1.0))).alias(out))
    rows = df.where(F.col(p).isNotNull()).withColumn("p__", F.col(p)).alias("r").join(q.alias("q"), _same("r", "q", own, "p__")).select("r.*", f"q.{out}").drop("p__")
    return rows.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def robust_z(df: DataFrame, value: str, out: str, by: Sequence[str] = (), fallback_sd: bool = False, clamp: float | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD); MAD 0 gives 0, or the plain z score with ``fallback_sd``. Staged, as both medians
    need the rows again."""
    own, df = list(by), staged(df, "values")
    with_row = lambda rows, side, names: (
        rows.alias("d").join(side.alias("m"), [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in own], "left") if own else rows.alias("d").crossJoin(F.broadcast(side.alias("m")))
    ).select("d.*", *[f"m.{n}" for n in names])
    spread = df.groupBy(*own).agg(F.stddev_samp(value).alias("sd__"), F.avg(value).alias("avg__"))
    with_mid = with_row(with_row(df, spread, ["sd__", "avg__"]), exact_quantile(df, value, 0.5, "mid__", own), ["mid__"])
    far = staged(with_mid.withColumn("far__", F.abs(F.col(value) - F.col("mid__"))), "far")
    both = with_row(far, exact_quantile(far, "far__", 0.5, "mad__", own), ["mad__"])
    plain = F.try_divide(F.col(value) - F.col("avg__"), F.col("sd__")) if fallback_sd else F.lit(0.0)
    z = F.when(F.col("mad__") > 0, (F.col(value) - F.col("mid__")) / (1.4826 * F.col("mad__"))).otherwise(F.coalesce(plain, F.lit(0.0)))
    z = F.when(F.col(value).isNotNull(), z)
    if clamp is not None:
        z = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clamp)), F.lit(clamp)))
    return both.withColumn(out, z).drop("mid__", "sd__", "avg__", "mad__", "far__")


def gamma_moments(value: Column | str, least: int = 10) -> Column:
    """Aggregate: struct(n, shape, rate) by moments over positive values; null below ``least`` values."""
    x = F.col(value) if isinstance(value, str) else value
    x = F.when(x > 0, x)
    mean, var = F.avg(x), F.var_samp(x)
    ok = (F.count(x) >= least) & (var > 0)
    return F.struct(F.count(x).alias("n"), F.when(ok, mean * mean / var).alias("shape"), F.when(ok, mean / var).alias("rate"))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def gamma_quantile(p: float, shape: float, rate: float) -> float:
    """The value that a gamma variable stays below with chance p, by bisection."""
    low, high = 0.0, max(1.0, shape)
    while _gamma_p(shape, high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(shape, mid) < p else (low, mid)
    return (low + high) / 2 / rate


@F.pandas_udf(DoubleType())
def gamma_cutoff(shape: pd.Series, rate: pd.Series, p: pd.Series) -> pd.Series:
    """Quantile of each row's gamma distribution; rows are one a group."""
    return pd.Series([gamma_quantile(q, a, b) if a == a and b == b and a > 0 and b > 0 else None for a, b, q in zip(shape, rate, p, strict=True)], dtype="float64")


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """Chance of at least ``a`` in the first cell of a 2 x 2 table with these margins."""
    if min(a, b, c, d) < 0:
        return float("nan")
    lf = lambda n: math.lgamma(n + 1)
    row, colsum, n = a + b, a + c, a + b + c + d
    base = lf(row) + lf(n - row) + lf(colsum) + lf(n - colsum) - lf(n)
    terms = [base - lf(x) - lf(row - x) - lf(colsum - x) - lf(n - row - colsum + x) for x in range(a, min(row, colsum) + 1) if n - row - colsum + x >= 0]
    return min(1.0, math.fsum(math.exp(t) for t in terms))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_greater(*map(int, v)) if not any(x != x for x in v) else None for v in zip(a, b, c, d, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None).astype("float64")


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, specificity, accuracy, MCC; null where a denominator is 0."""
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    return {
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "specificity": F.try_divide(tn, tn + fp),
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "mcc": F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def second_difference(value: str, order: str, by: Sequence[str] = (), grid: str | None = None) -> Column:
    """x[i+1] - 2 x[i] + x[i-1]; with ``grid``, the second derivative on an uneven grid."""
    w = Window.partitionBy(*by).orderBy(order)
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    if grid is None:
        return after - 2 * x + before
    left, right = F.col(grid) - F.lag(grid).over(w), F.lead(grid).over(w) - F.col(grid)
    return 2 * ((after - x) / right - (x - before) / left) / (left + right)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def trigamma_inverse(y: float) -> float:
    """By Newton's method on the reciprocal."""
    if y > 1e7:
        return 1 / math.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(50):
        tri = trigamma(x)
        h = 1e-5 * x
        slope = (trigamma(x + h) - trigamma(x - h)) / (2 * h)
        step = tri * (1 - tri / y) / slope
        x += step
        if abs(step) < 1e-10 * x:
            break
    return x


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def beta_tails(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``beta_tail`` of many values at once."""
    a, b, x = (np.asarray(v, float).copy() for v in (a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a[turned], b[turned], x[turned] = b[turned], a[turned], 1 - x[turned]
    x = np.clip(x, 1e-300, 1 - 1e-16)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a if len(a) else a
    c, d = np.ones(len(a)), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(d == 0, 1e-300, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(d == 0, 1e-300, d)
            c = 1 + num / c
            c = np.where(c == 0, 1e-300, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = front * h
    return np.where(turned, 1 - out, out)


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of many t values; NaN where t or the degrees of freedom are not finite."""
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    t, df = t[ok], df[ok]
    out[ok] = np.where(t == 0, 1.0, beta_tails(df / 2, np.full(len(df), 0.5), df / (df + t * t)))
    return out


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d2 < 1e12 else 1 - _gamma_p(d1 / 2, d1 * f / 2)
