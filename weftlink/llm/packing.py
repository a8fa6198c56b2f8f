"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Open bins stand in order of their residual. Each bin carries a bitmap of its sources and one of
its duplicate clusters. Pieces come largest first; a piece goes to the tightest bin that holds it
and is compatible: no piece of its duplicate cluster is in the bin, and the bin's sources stay
within ``max_sources``. The successor search steps from residual to residual until such a bin is
found; if none is, a bin opens.

Documents longer than the capacity are cut into full pieces, each a bin of its own, and a rest.
Work is dealt by hash into shards of about ``SHARD_PIECES`` pieces that are packed independently;
identical rows are counted first and then spread over the shards, so no key fills one.

Defined cases: null or empty documents have size 0 and still get a bin (they take no room); a null
source is a source of its own; a null cluster conflicts with nothing; repeated rows conflict like
any copies, if they have a cluster; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import staged

#: Words in a bin, distinct sources in a bin, and pieces in a shard.
CAPACITY, MAX_SOURCES, SHARD_PIECES = 4096, 8, 8192


class BestFit:
    """Open bins by residual. ``stock[r]`` lists the bins with residual r; bit r of ``present`` says
    that it is not empty, so the next residual upward is one operation on the bitmap."""

    def __init__(self, capacity: int, max_sources: int):
        self.capacity, self.max_sources = capacity, max_sources
        self.stock: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []

    def successor(self, residual: int) -> int:
        """The least residual >= the given one that some open bin has, or -1."""
        above = self.present >> residual
        return residual + (above & -above).bit_length() - 1 if above else -1

    def place(self, size: int, source: int, cluster: int, start: int) -> tuple[int, int]:
        """Put a piece (bitmaps ``source``, ``cluster``) into the tightest compatible bin with residual of
        at least ``start``. Returns the bin and the residual it had."""
        r = self.successor(start)
        while r >= 0:
            bins = self.stock[r]
            for i in range(len(bins) - 1, -1, -1):
                b = bins[i]
                if not self.clusters[b] & cluster and (self.sources[b] & source or self.sources[b].bit_count() < self.max_sources):
                    bins.pop(i)
                    if not bins:
                        self.present &= ~(1 << r)
                    self._add(b, size, source, cluster)
                    return b, r
            r = self.successor(r + 1) if r < self.capacity else -1
        b = len(self.left)
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self._add(b, size, source, cluster)
        return b, self.capacity + 1

    def _add(self, b: int, size: int, source: int, cluster: int) -> None:
        self.left[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.stock[self.left[b]].append(b)
        self.present |= 1 << self.left[b]


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES) -> list[tuple[int, int, int, int]]:
    """(row, piece, bin, words) of every piece; rows in the given order, ties by it."""
    out, rests, n_bins = [], [], 0
    for i, size in enumerate(sizes):
        full, rest = divmod(int(size), capacity)
        for p in range(full):
            out.append((i, p, n_bins, capacity))
            n_bins += 1
        if rest or not full:
            rests.append((-rest, i, full))
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    order = [(size, clusters[i] or b"", source_bit[sources[i]], i, piece) for size, i, piece in rests]
    order.sort(key=lambda x: (x[0], x[1], x[2], x[3], x[4]))
    fit, before, start = BestFit(capacity, max_sources), None, 0
    for minus, cluster, source, i, piece in order:
        size, mark = -minus, cluster_bit.get(clusters[i], 0)
        # Alike pieces of one cluster come together, and a bin that refused one refuses the next:
        # the search goes on where it stood.
        same = before == (size, mark, source) and mark
        b, found = fit.place(size, source, mark, start if same else size)
        before, start = (size, mark, source), found if found <= capacity else capacity
        if found > capacity and same:
            start = capacity
        out.append((i, piece, n_bins + b, size))
    return out


def pack(df: DataFrame, key: str, size: str, source: str, cluster: str, capacity: int = CAPACITY, max_sources: int = MAX_SOURCES) -> DataFrame:
    """(key, copy, piece, n_words, shard, bin, source) for the pieces of all rows; a bin is named by shard and bin."""
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("binary").alias("cluster")
    )
    same = staged(rows.groupBy("id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("copies")), "sizes", like=df)
    n = same.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.floor(F.col("size") / capacity)).alias("full")).first()
    shards = max(1, -(-((n.n or 0) + (n.full or 0)) // SHARD_PIECES))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    shard = F.pmod(F.xxhash64("id", "size", "source", "cluster") + F.col("copy"), F.lit(shards)).alias("shard")

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "copy", "size", "source", "cluster"], kind="stable", na_position="first").reset_index(drop=True)
        none = lambda col: [None if v is None or v is pd.NA or v != v else v for v in part[col]]
        made = pack_shard(part["size"].tolist(), none("source"), none("cluster"), capacity, max_sources)
        at = [m[0] for m in made]
        out = part.loc[at, ["id", "copy", "source", "shard"]].reset_index(drop=True)
        return out.assign(piece=[m[1] for m in made], bin=[m[2] for m in made], n_words=[m[3] for m in made])[["id", "copy", "piece", "n_words", "shard", "bin", "source"]]

    out = each.select("id", "size", "source", "cluster", "copy", shard).groupBy("shard").applyInPandas(packed, "id long, copy int, piece int, n_words long, shard long, bin long, source string")
    return out.withColumnRenamed("id", key)


def iter_bins(packed: DataFrame) -> Iterator:
    """Bins of a packed table as (shard, bin), for small results and tests."""
    return iter(packed.select("shard", "bin").distinct().sort("shard", "bin").toLocalIterator())
