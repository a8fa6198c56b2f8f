"""Shared pieces of the training-data operators: words, keys, checked broadcast, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.sources.staging import forget, new_path, numbered, shared_dir, staged

__all__ = ["forget", "new_path", "numbered", "shared_dir", "staged", "connected_components", "small_side", "text_key", "word_count"]

#: White space that separates words; every other code point belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side of at most this many rows (of a few dozen bytes each) may be broadcast.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty differ."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit(""))))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (columns a, b): component is the smallest node reachable.

    Alternating large-star and small-star contraction on DataFrames; each round is staged.
    Hubs meet only in joins that the engine can split and in sums that combine before the shuffle.
    """
    links = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
        like=edges,
    )
    # A set of links stands still when its size and two sums of hashes do.
    sums = [F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in (0, 1)]
    mark = tuple(links.agg(F.count(F.lit(1)), *sums).first())
    for _ in range(rounds if mark[0] else 0):
        n = mark[0]
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged, so that the links of a hub are split over tasks where they come back to its sum.
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", 2 * n)
        large = (
            both.join(small_side(low, low.count()), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = staged(large, "large", n)
        lows = staged(large.groupBy("u").agg(F.min("v").alias("m")), "lows", n)
        small = (
            large.join(small_side(lows, lows.count()), "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = staged(small, "small", 2 * n)
        before, mark = mark, tuple(small.agg(F.count(F.lit(1)), *sums).first())
        forget(links, low, large, lows)
        links = small
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    heads = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
