"""Permutations of groups of any size: rows find their places by hash, a range of a round's hashes a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weftlink.functions.stats import benjamini_hochberg
from weftlink.operators.numbering import counts_at_least, same, small
from weftlink.sources.staging import staged

#: Places of a group whose runs one array holds, and numbers that are hashed at once.
HELD, BLOCK = 4_096, 1 << 17


def permutation_hash(seed: int, by: str, round_: Column, *number: Column) -> Column:
    """What a round's permutation of a group orders its numbered rows by; without a number, what hashes of numbers start with."""
    return F.xxhash64(F.lit(seed), F.col(by).cast("string"), round_.cast("long"), *[n.cast("long") for n in number])


def hashes(numbers: np.ndarray, start: int) -> np.ndarray:
    """``xxhash64`` of longs from a start, as unsigned numbers in the order of the signed hashes. Different numbers have different ones."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        h = (np.uint64(start % (1 << 64)) + five + np.uint64(8)) ^ (turned(numbers.astype(np.uint64) * two, 31) * one)
        h = turned(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32)) ^ np.uint64(1 << 63)


def _blocks(at: np.ndarray, n: np.ndarray, *values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The numbers of runs, with their values, about ``BLOCK`` at a time."""
    pieces = -(-n // BLOCK)
    run = np.repeat(np.arange(len(n)), pieces)
    skip = (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * BLOCK
    at, n, values = at[run] + skip, np.minimum(n[run] - skip, BLOCK), [v[run] for v in values]
    cuts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // BLOCK, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
        m = n[a:b]
        yield (np.repeat(at[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum()), *[np.repeat(v[a:b], m) for v in values])


def _runs(batch: pa.RecordBatch, kind: int) -> tuple[np.ndarray, ...]:
    """First number, length, value and whether it is null, of the runs of a kind."""
    rows = batch.filter(pc.equal(batch.column("kind__"), kind))
    at, n, v = (rows.column(c).flatten() for c in ("at__", "n__", "v__"))
    return at.to_numpy(), n.to_numpy(), v.to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False)


def _products(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted products of one range of a round: the rows whose hash is in it, in its order, get the places after those of lower hashes."""
    own, lower, found, sites = key[2].as_py(), 0, [], []
    for batch in batches:
        start, bits = batch.column("start__")[0].as_py(), batch.column("bits__")[0].as_py()
        sites.append(_runs(batch, 1))
        for numbers, g, none in _blocks(*_runs(batch, 0)):
            h = hashes(numbers, start)
            if bits:
                range_ = h >> np.uint64(64 - bits)
                lower += int(np.count_nonzero(range_ < own))
                kept = range_ == own
                h, g, none = h[kept], g[kept], none[kept]
            found.append((h, g, none))
    h, g, none = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h)
    at, n, p, p_none = (np.concatenate(x) for x in zip(*sites, strict=True))
    first = np.argsort(at)
    n = np.maximum(np.minimum(at + n, lower + len(h)) - np.maximum(at, lower), 0)[first]
    if n.sum() != len(h):
        raise ValueError("places of a range of hashes lie too far from where they are expected")
    x = np.repeat(p[first], n) * g[order]
    x, count = np.unique(x[~(np.repeat(p_none[first], n) | none[order])], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(x)), pa.array(x), pa.array(count.astype(np.int64))], names=["by__", "x", "n"])


def _arrays(runs: DataFrame, by: str, value: str, kind: int) -> DataFrame:
    """(by, kind__, from__, to__, at__, n__, v__): runs as arrays of those that begin in ``HELD`` places."""
    held = runs.groupBy(by, F.floor(F.col("at__") / HELD).alias("c__")).agg(F.collect_list(F.struct("at__", "n__", F.col(value).cast("double").alias("v__"))).alias("x__"), F.min("at__").alias("from__"), F.max(F.col("at__") + F.col("n__")).alias("to__"))
    return held.select(by, F.lit(kind).alias("kind__"), "from__", "to__", F.col("x__.at__"), F.col("x__.n__"), F.col("x__.v__"))


def permuted_products(sites: DataFrame, genes: DataFrame, groups: DataFrame, by: str, rounds: int, seed: int, at_once: int) -> DataFrame:
    """(by, x, n): products of site and gene score over all rounds, counted by value; one may come in several rows.

    A group's rows are numbered; ``sites`` (by, at__, n__, peak_score) and ``genes`` (by, at__, n__, gene_score) are its runs
    of equal scores, ``groups`` (by, all__) its size, staged. A task hashes the numbers of its group and orders those in its own
    range of hashes, ``at_once`` of them about, so no row is shuffled: runs of genes go to every task of the group, those
    of sites to where a range's places may lie, 12 standard deviations on both sides of where they are expected.
    """
    bits = F.when(F.col("all__") <= at_once, 0).otherwise(F.ceil(F.log2(F.col("all__") / at_once))).cast("int")
    turns = groups.withColumn("bits__", bits).withColumn("round__", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    turns = turns.withColumn("range__", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("bits__")).cast("int") - 1)))
    turns = staged(turns.withColumn("start__", permutation_hash(seed, by, F.col("round__"))), "turns", 1)
    n_turns, few = turns.count(), lambda t: small(t, n_turns)
    share, wide = F.col("t.all__") / F.pow(F.lit(2), F.col("t.bits__")), F.sqrt(F.col("t.all__")) * 6
    near = (F.col("a.from__") < (F.col("t.range__") + 1) * share + wide) & (F.col("a.to__") > F.col("t.range__") * share - wide)
    runs = _arrays(genes, by, "gene_score", 0).unionByName(_arrays(sites, by, "peak_score", 1))
    dealt = runs.alias("a").join(few(turns.alias("t")), [*same("a", "t", [by]), (F.col("a.kind__") == 0) | near])
    dealt = dealt.select(F.col(f"a.{by}").alias("by__"), "t.round__", "t.range__", "t.start__", "t.bits__", "a.kind__", "a.at__", "a.n__", "a.v__")
    keys, cores = ["by__", "round__", "range__"], groups.sparkSession.sparkContext.defaultParallelism
    # As many tasks as are named: the work of one is not seen in what it reads.
    dealt = dealt.repartition(int(max(1, min(n_turns, 50 * cores))), *keys)
    shape = StructType([StructField("by__", dealt.schema["by__"].dataType), StructField("x", DoubleType()), StructField("n", LongType())])
    return dealt.groupBy(*keys).applyInArrow(_products, shape).withColumnRenamed("by__", by)


def permuted_p(sites: DataFrame, genes: DataFrame, observed: DataFrame, by: str, rounds: int, seed: int, at_once: int) -> DataFrame:
    """(by, x, p_perm, q_perm) of each distinct observed product: ``observed`` has (by, x, n__), n__ rows with a product x."""
    seen = staged(observed.groupBy(by, "x").agg(F.sum("n__").alias("n__")), "observed")
    groups = staged(seen.groupBy(by).agg(F.sum("n__").alias("all__")), "sizes")
    null = permuted_products(sites, genes, groups, by, rounds, seed, at_once)
    seen = seen.where("x is not null")
    larger = counts_at_least(null, seen.select(by, "x"), [by])
    found = seen.alias("o").join(larger.alias("l"), [*same("o", "l", [by]), F.col("o.x") == F.col("l.x")]).select("o.*", "l.larger")
    sized = found.alias("f").join(small(groups, groups.count()).alias("s"), same("f", "s", [by])).select("f.*", "s.all__")
    p = (1 + F.col("larger")) / (1 + rounds * F.col("all__"))
    return benjamini_hochberg(sized.withColumn("p_perm", p), "p_perm", "q_perm", (by,), count="n__").select(by, "x", "p_perm", "q_perm")
