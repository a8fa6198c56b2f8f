"""Centroid clustering with partial-distance search, in whole numbers.

A vector and all centroids are first compared on the few dimensions of highest variance. The centroid that
is nearest there gives the first bound; the others follow in the order of their partial distances. Squared
differences are added block by block of dimensions, and a centroid is abandoned once its sum is strictly
above the best distance found; survivors finish all dimensions, and ties go to the smaller number. As sums
of squares only grow, no nearest centroid is ever abandoned, in whatever order dimensions come.

Each round every task assigns its vectors and passes on one sum a centroid; only these sums are shuffled,
and only the centroids, whose number and length are parameters, reach the driver. The vectors themselves
are read in place. All sums are of whole numbers, so reruns and other partitions give the same result.

Defined cases: vectors of another length, and those that are null or hold null or non-finite components,
take no part and have no row; a zero vector is a vector; rows that repeat a vec_id are vectors of their own,
ordered by their components where a seed is chosen; rows without a vec_id are assigned, and become seeds
last; with fewer vectors than centroids there are as many centroids as vectors; equal centroids share
nothing: the smaller number takes all; an empty table gives an empty result; other columns are ignored;
components beyond 2^27 after scaling are refused, as distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import forget, small_side, staged
from weftlink.llm.integer_vectors import block, check_range, floor_means, integers

#: Centroids, rounds that move them, components in a vector, factor before rounding down.
CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Dimensions that are added before sums are held against the bound again.
STEP = 8
#: Squared differences of a first block that are held in memory at once.
CELLS = 1 << 21


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ``order`` is the order of dimensions."""
    n, k, d = len(x), len(centroids), x.shape[1]
    x, c = x[:, order], centroids[:, order]
    rows = np.arange(n)
    first = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(2)
    by = np.argsort(first, axis=1, kind="stable")
    best = by[:, 0].copy()
    dist = first[rows, best] + ((x[:, STEP:] - c[best, STEP:]) ** 2).sum(1)
    for r in range(1, k):
        at = np.flatnonzero(first[rows, by[:, r]] <= dist)
        so_far = first[at, by[at, r]]
        for lo in range(STEP, d, STEP):
            if not len(at):
                break
            so_far = so_far + ((x[at, lo : lo + STEP] - c[by[at, r], lo : lo + STEP]) ** 2).sum(1)
            near = so_far <= dist[at]
            at, so_far = at[near], so_far[near]
        won = (so_far < dist[at]) | (by[at, r] < best[at])
        at, so_far = at[won], so_far[won]
        best[at], dist[at] = by[at, r], so_far
    return best, dist


def in_slices(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` in slices of bounded memory."""
    rows = max(1, CELLS // (len(centroids) * STEP))
    parts = [nearest(x[at : at + rows], centroids, order) for at in range(0, len(x), rows)] or [nearest(x, centroids, order)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def round_sums(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors: their number and componentwise sums."""
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            x = block(b.column(0), d)
            c, _ = in_slices(x, centroids, order)
            n += np.bincount(c, minlength=k)
            np.add.at(sums, c, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(used, pa.int32()), "n": pa.array(n[used]), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    parts = vectors.select("x").mapInArrow(add, "c int, n long, sums array<long>")
    # One row a task and centroid; wide sums, as those of tasks together may pass 64 bits.
    got = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(d)]).alias("sums"))
    return {r["c"]: (r["n"], r["sums"]) for r in got.collect()}


def centroid_clusters(
    df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", seed: int = 1
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a vector that takes part."""
    spark = df.sparkSession
    vectors = staged(integers(df, key, vector, scale).where(F.size("x") == dims), "integer-vectors")
    check_range(vectors, dims)
    by_hash = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("x")]
    seeds = vectors.orderBy(*by_hash).limit(k).select("x").collect()
    if not seeds:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in seeds], np.int64)
    spread = vectors.agg(F.array(*[F.var_pop(F.col("x")[i]) for i in range(dims)])).first()[0]
    order = np.argsort(-np.array(spread), kind="stable")
    for _ in range(rounds):
        for c, (n, sums) in round_sums(vectors, centroids, order).items():
            centroids[c] = floor_means(sums, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, dist = in_slices(block(b.column("x"), dims), centroids, order)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "cluster": pa.array(c, pa.int32()), "distance": pa.array(dist)})

    assigned = staged(vectors.select("id", "x").mapInArrow(assign, "id long, cluster int, distance long"), "assigned")
    forget(vectors)
    own = {r["cluster"]: r["i"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    whole = sum(own.values())
    facts = [(c, own.get(c, 0), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(small_side(named, len(facts)), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
