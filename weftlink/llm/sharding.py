"""Contiguous shards of near equal bytes: prefix sums from per-partition totals, cut at equal targets.

Rows are sorted by range over all tasks and staged with their place. One sum a sorted partition, and the
running sum of these few sums, say in which partitions the cuts fall; running sums of single rows are made
in those only. A row lies in the shard in whose equal share of all bytes its middle lies, so a shard is off
its target by less than the largest row. Places follow from the place in the partition and the rows before
it, so after the sort no row is shuffled again: each looks its shard up in a table of one entry a partition
and cut.

The law held is ``bytes``. Equal rows are not drawn together: a group of copies may hold a third of all
bytes, and no shard of an equal share could hold it. Where copies should stand side by side, let ``order``
begin with a key of the text.

Defined cases: a null text has no bytes and weighs the overhead alone, as an empty one does; null ids come
first; rows that repeat an id follow each other by the rest of their columns; rows that repeat everything
are rows of their own, and it does not matter which of them stands first; with fewer rows than shards some
shards are empty; an empty table gives an empty result; columns of the input that are named ``shard`` or
``slot`` are replaced, other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import numbered, small_side, staged

#: Shards, and bytes that a row weighs besides its text.
SHARDS, OVERHEAD = 24, 8
#: Bits of a place within its sorted partition; the bits above number the partition.
PLACE_BITS = 33


def text_bytes(text: Column, overhead: int = OVERHEAD) -> Column:
    """UTF-8 bytes of a text, none for null, and the overhead of a row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def _share(doubled: Column, total: int, n: int) -> Column:
    """The shard in whose share twice a byte position lies; exact beyond 64 bits."""
    wide = doubled.cast("decimal(38,0)") * F.lit(n).cast("decimal(10,0)")
    return F.call_function("div", wide, F.lit(2 * total).cast("decimal(38,0)")).cast("int")


def shard_starts(rows: DataFrame, n: int) -> DataFrame:
    """(part, starts): for each sorted partition of ``rows`` (pos, size) its stretches of one shard, with the
    place of the first, the shard, and what to take from a row's number to get its slot."""
    part, place = F.shiftright("pos", PLACE_BITS).alias("part"), F.col("pos").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    totals = rows.groupBy(part).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("pos").alias("pos"))
    # One row a task of the sort: sums of everything before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(totals.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "parts", 1)
    total, n_parts = parts.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    if not total:
        return parts.select("part", F.array().cast("array<struct<pos:bigint,shard:int,drop:bigint>>").alias("starts"))
    low = _share(2 * F.col("before"), total, n)
    high = F.least(_share(2 * (F.col("before") + F.col("bytes")), total, n), F.lit(n - 1))
    parts = parts.withColumn("low", low).withColumn("cut", low < high)
    cut = small_side(parts.where("cut").select("part", "before", "rows_before"), n_parts)
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = rows.select(part, "pos", "size").join(cut, "part").withColumn("shard", _share(2 * (F.col("before") + upto) - F.col("size"), total, n))
    found = within.groupBy("part", "shard", "rows_before").agg(F.min("pos").alias("pos"))
    whole = parts.where("not cut").select("part", F.col("low").alias("shard"), "rows_before", "pos")
    starts = staged(found.unionByName(whole).select("part", "shard", "pos", (F.col("rows_before") + place).alias("nth")), "starts", n_parts + n)
    first = starts.groupBy("shard").agg(F.min("nth").alias("first"))
    entry = F.struct("pos", "shard", (F.col("first") - F.col("rows_before")).alias("drop"))
    return starts.join(first, "shard").join(parts.select("part", "rows_before"), "part").groupBy("part").agg(F.array_sort(F.collect_list(entry)).alias("starts"))


def balanced_shards(df: DataFrame, size: Column, order: list[str], n: int = SHARDS) -> DataFrame:
    """The columns of ``df`` with shard int (0 to n - 1, contiguous in ``order``) and slot long (from 0 in each).

    ``size`` is a row's weight, a whole number above 0. All columns are sorted and staged: give only those that
    the result needs.
    """
    if n < 1:
        raise ValueError("there must be a shard at least")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    plain = [F.col(f"`{c}`") for c in kept]
    # The hash and the place in the input tell rows apart that share an id, so no task sorts all of them.
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in kept if "map<" not in df.schema[c].dataType.simpleString()])
    by = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    keyed = df.select(F.struct(*plain).alias("row"), size.cast("long").alias("size"), *by, hashed.alias("tie"), F.monotonically_increasing_id().alias("given"))
    placed = numbered(keyed, [*[f"o{i}" for i in range(len(by))], "tie", "given"], "pos").select("row", "size", "pos")
    rows = staged(placed, "sharded", like=df)
    starts = staged(shard_starts(rows.select("pos", "size"), n), "stretches", 1)
    mine = F.element_at(F.filter("starts", lambda s: s["pos"] <= F.col("pos")), -1)
    part, place = F.shiftright("pos", PLACE_BITS), F.col("pos").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    out = rows.withColumn("part", part).join(small_side(starts, starts.count()), "part").withColumn("mine", mine)
    return out.select("row.*", F.col("mine.shard").alias("shard"), (place - F.col("mine.drop")).alias("slot"))


def write_shards(df: DataFrame, path: str, text: str = "text", order: list[str] | None = None, n: int = SHARDS) -> DataFrame:
    """Write ``df`` as folders ``shard=0`` and so on, sorted by slot within each, and read them back."""
    made = balanced_shards(df, text_bytes(F.col(f"`{text}`")), order or ["doc_id"], n)
    made.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)
