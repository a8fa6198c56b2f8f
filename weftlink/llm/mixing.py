"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Every row has a 60-bit hash. Tokens are summed by source and hash bucket; the bucket in which a
source's budget ends is refined, ten bits at a time, until it is a single hash value. A row is
then taken when its hash lies below the threshold of its source, so nothing is sorted by row, and
budgets nest: a smaller budget takes a subset of a larger one.

The hash is of the key, the text and, among rows that repeat both within a source, their number, so
rows without a key, or with the same one, are told apart.

Defined cases: a null text has size 0; a null source is a source of its own, after all others;
sources without words get target 0; null and repeated keys are rows like any other; an empty table
gives an empty result; columns other than the named ones are carried. Sources are names of collections:
targets are set over one small row a source, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import small_side, staged, text_key, word_count

#: Bits of the row hash, and bits that one histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 10
#: Copies of a threshold row when it is too large to broadcast and sources are skewed.
SALTS = 64


def row_hash(key: Column, tkey: Column, nth: Column) -> Column:
    """60 bits of md5 of the key's text form (null: empty), the text's key and the row's number among equal ones."""
    whole = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lower(F.hex(tkey)), nth.cast("string"))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): weights repeat over the sources by
    code point, null last; what exceeds ``cap`` times a source's size is shared again by weight.

    Sources are ordered by size over weight; the first one that its share does not fill fixes the
    level for all that follow.
    """
    everything = Window.partitionBy()
    w = F.lit(0)
    at = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    for i, weight in enumerate(weights):
        w = F.when(at % len(weights) == i, F.lit(int(weight))).otherwise(w)
    order = Window.partitionBy().orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        sizes.withColumn("w", w)
        .withColumn("at", F.row_number().over(order))
        .withColumn("rest", share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(after))
        .withColumn("open", cap * F.col("source_size") * F.col("rest_w") > F.col("w") * F.col("rest"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("at", "rest", "rest_w"))).over(everything))
    )
    target = F.when(F.col("at") >= F.col("first.at"), F.col("w") * F.col("first.rest") / F.col("first.rest_w"))
    return level.select("source", "source_size", F.coalesce(target, cap * F.col("source_size")).cast("double").alias("target"))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    cap: float = 3.0,
) -> DataFrame:
    """(key, source, size, source_size, target, copies) for every row of ``df``: how often the mix takes it."""
    return mixed_rows(df, key, text, source, weights, share, cap).drop("tkey")


def mixed_rows(df: DataFrame, key: str, text: str, source: str, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """The rows of ``mix`` with the key ``tkey`` of each row's text."""
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), text_key(F.col(text)).alias("tkey"), word_count(F.col(text)).alias("size"))
    # Equal rows meet before the shuffle and are numbered where they part again.
    same = rows.groupBy("key", "source", "tkey", "size").agg(F.count(F.lit(1)).alias("n"))
    each = same.select("key", "source", "tkey", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    sized = staged(each.select("key", "source", "tkey", "size", row_hash(F.col("key"), F.col("tkey"), F.col("nth")).alias("h")), "sized", like=df)
    step = HASH_BITS - LEVEL_BITS
    hist = staged(sized.groupBy("source", F.shiftright("h", step).alias("b")).agg(F.sum("size").alias("n")), "hist", like=sized)
    goals = source_targets(hist.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = staged(goals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "goals", like=hist)
    n_sources = goals.count()

    # The bucket in which each source's budget ends, and what lies before it.
    bounds = goals.select("source", "rest", F.lit(0.0).alias("acc"))
    for at in range(step, -1, -LEVEL_BITS):
        if at != step:
            open_rows = sized.withColumn("p", F.shiftright("h", at + LEVEL_BITS))
            side = small_side(bounds.select(F.col("source").alias("s"), F.col("b").alias("p_")), n_sources)
            hist = (
                open_rows.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("p") == F.col("p_")))
                .groupBy("source", F.shiftright("h", at).alias("b"))
                .agg(F.sum("size").alias("n"))
            )
        left, right = hist.alias("l"), small_side(bounds.select(F.col("source").alias("s"), "rest", "acc"), n_sources)
        run = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = left.join(right, F.col("l.source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("acc") + run)
        cells = cells.where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        bounds = staged(cells.select("source", "rest", (F.col("upto") - F.col("n")).cast("double").alias("acc"), "b", "upto"), "bounds", like=goals)
    # The last bucket is one hash value: it belongs to the mix if that comes nearer to the budget.
    near = F.col("upto") - F.col("rest") < F.col("rest") - F.col("acc")
    ends = bounds.select(F.col("source").alias("s"), (F.col("b") + near.cast("long")).alias("below"))
    marks = goals.join(small_side(ends, n_sources), F.col("source").eqNullSafe(F.col("s")), "left")
    marks = marks.select(F.col("source").alias("of"), "source_size", "target", "full", F.coalesce("below", F.lit(0)).alias("below"))
    if n_sources <= 20_000:
        out = sized.join(F.broadcast(marks), F.col("source").eqNullSafe(F.col("of")))
    else:
        salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = sized.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("h") % SALTS == F.col("salt")))
    copies = F.col("full") + (F.col("h") < F.col("below")).cast("long")
    return out.select(F.col("key").alias(key), "source", "tkey", "size", "source_size", "target", copies.alias("copies"))


def apply_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with the columns of ``df``.

    Rows that repeat key, source and text share what the mix takes of them as evenly as whole copies go; the
    rest is copies of the first of them by the other columns.
    """
    takes = mixed_rows(df.select(key, text, source), key, text, source, **options)
    own = ["key__", "source__", "tkey__"]
    takes = takes.groupBy(F.col(key).alias("key__"), F.col("source").alias("source__"), F.col("tkey").alias("tkey__"))
    takes = staged(takes.agg(F.sum("copies").alias("copies__"), F.count(F.lit(1)).alias("rows__")), "takes", like=df)
    rows = df.withColumn("own__", text_key(df[text]))
    same = rows[key].eqNullSafe(F.col("key__")) & rows[source].cast("string").eqNullSafe(F.col("source__")) & (F.col("own__") == F.col("tkey__"))
    joined = rows.join(takes, same)
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    each = F.floor(F.col("copies__") / F.col("rows__")).cast("long")
    out = joined.where(each > 0).withColumn("copy__", times(each)).select([df[c] for c in df.columns])
    uneven = (F.col("rows__") > 1) & (F.col("copies__") % F.col("rows__") > 0)
    if not takes.where(uneven).limit(1).count():
        return out
    first = joined.where(uneven).groupBy(*own).agg(F.min(F.struct(*[df[c] for c in df.columns])).alias("row"), F.first(F.col("copies__") % F.col("rows__")).alias("more"))
    return out.unionByName(first.withColumn("copy__", times(F.col("more"))).select("row.*"))
