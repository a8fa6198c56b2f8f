"""Numbers within groups of any size: sorted by range over all tasks, counts carried from part to part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.sources.staging import numbered, staged

#: Rows of a counted side that may be broadcast, at most.
FEW = 20_000


def same(a: str, b: str, keys: Sequence[str], to: Sequence[str] | None = None) -> list[Column]:
    """Null-safe equality of the key columns of two aliased tables."""
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{t}")) for k, t in zip(keys, to or keys, strict=True)]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast only where the counted rows are few."""
    return F.broadcast(df) if rows <= FEW else df


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds the number from 0 of each row of its group by ``order``, which must tell a group's rows apart. Staged:
    ``made_from`` holds the tables to forget when no later plan reads the result.

    After the sort by range a group is consecutive in each part that holds some of it, so a row's number is its place
    in the part and what the group's rows in parts before come to: one row a part and group.
    """
    own = list(by)
    rows = staged(numbered(df, [*own, *order], "pos__").withColumn("part__", F.shiftright("pos__", 33)), "numbered")
    parts = rows.groupBy(*own, "part__").agg(F.count(F.lit(1)).alias("n__"), F.min("pos__").alias("first__"))
    before = F.sum("n__").over(Window.partitionBy(*own).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    shifts = staged(parts.withColumn("shift__", F.coalesce(before, F.lit(0)) - F.col("first__")), "shifts")
    joined = rows.alias("r").join(small(shifts, shifts.count()).alias("s"), same("r", "s", [*own, "part__"]))
    placed = joined.select(*[f"r.`{c}`" for c in df.columns], (F.col("r.pos__") + F.col("s.shift__")).alias(out))
    placed.made_from = (rows, shifts)
    return placed


def running_start(df: DataFrame, order: Sequence[str], n: str, out: str) -> DataFrame:
    """Adds the sum of ``n`` over the rows before each by ``order``, which must tell all rows apart. Staged parts of a sort by range."""
    rows = staged(numbered(df, list(order), "pos__").withColumn("part__", F.shiftright("pos__", 33)), "sorted")
    sums = rows.groupBy("part__").agg(F.sum(n).alias("s__"))
    sums = sums.select("part__", (F.sum("s__").over(Window.partitionBy(F.lit(0)).orderBy("part__")) - F.col("s__")).alias("before__"))
    inside = F.sum(n).over(Window.partitionBy("part__").orderBy("pos__")) - F.col(n)
    return rows.withColumn("inside__", inside).join(F.broadcast(sums), "part__").select(*df.columns, (F.col("before__") + F.col("inside__")).alias(out))


def counts_at_least(null: DataFrame, observed: DataFrame, by: Sequence[str], value: str = "x", out: str = "larger") -> DataFrame:
    """(by, value, out): for each distinct observed value how many null values of its group are at least as large.

    ``null`` has (by, value, n) and may repeat values. Values are summed first and sought within buckets of their
    size, so neither a group of any size nor a value that most of it has is one task's work.
    """
    from weftlink.functions.stats import value_bucket

    own = list(by)
    rows = null.select(*own, F.col(value).alias("x__"), F.col("n").alias("n__"), F.lit(0).alias("seen__"))
    rows = rows.unionByName(observed.select(*own, F.col(value).alias("x__"), F.lit(0).cast("long").alias("n__"), F.lit(1).alias("seen__")))
    some = staged(rows.groupBy(*own, "x__").agg(F.sum("n__").alias("n__"), F.max("seen__").alias("seen__")).withColumn("b__", value_bucket(F.col("x__"))), "values")
    sums = some.groupBy(*own, "b__").agg(F.sum("n__").alias("s__"))
    above = F.sum("s__").over(Window.partitionBy(*own).orderBy(F.desc("b__"))) - F.col("s__")
    sums = sums.select(*own, "b__", above.alias("above__"))
    inside = F.sum("n__").over(Window.partitionBy(*own, "b__").orderBy(F.desc("x__")))
    placed = some.alias("a").join(sums.alias("s"), same("a", "s", [*own, "b__"])).select("a.*", "s.above__")
    return placed.withColumn(out, F.col("above__") + inside).where("seen__ = 1").select(*own, F.col("x__").alias(value), out)
