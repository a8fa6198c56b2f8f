"""LDA by Metropolis-Hastings sampling with delayed counts: a document and a word phase in turn, tokens in place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from weftlink.operators.numbering import small
from weftlink.sources.staging import forget, staged

#: Proposals that a token gets in a phase.
PROPOSALS = 2
#: Numbers of a block of cells that are held in memory at once.
CELLS = 1 << 21
#: Tokens of a piece of a cell, at most, and of a file of pieces, about.
PIECE, FILE_TOKENS = 1 << 13, 1 << 20
#: Steps between the keys of a cell's tokens.
STEP = 0xD1342543DE82EF95


def uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in [0, 1) from keys and the number of a stream: mixed bits, so they do not depend on order or task."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((stream * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def token_keys(cell: np.ndarray, n: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
    """A key for every token from the key of its cell and its place there; a piece of a cell begins at ``start``."""
    place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.repeat(cell.view(np.uint64), n) + place * np.uint64(STEP)


def draw(counts: np.ndarray, row: np.ndarray, prior: float, u: np.ndarray) -> np.ndarray:
    """A topic for each token in proportion to its row's counts plus the prior."""
    upto = np.cumsum(counts + prior, axis=1)
    upto /= upto[:, -1:]
    k = counts.shape[1]
    # Rows one after the other make one rising sequence, as each ends with 1.
    flat = (upto + np.arange(len(upto))[:, None]).ravel()
    return np.clip(np.searchsorted(flat, u + row, "right") - row * k, 0, k - 1)


def phase(z: np.ndarray, proposed: np.ndarray, row: np.ndarray, counts: np.ndarray, prior: float, totals: np.ndarray, key: np.ndarray, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """(topics, new proposals) of tokens. Proposals were drawn from the other side's counts, so that side cancels: one is
    taken by the ratio of this side's counts over that of the topics' totals. New ones are drawn from this side's counts."""
    z = z.copy()
    for m in range(PROPOSALS):
        new = proposed[:, m]
        ratio = (counts[row, new] + prior) / (counts[row, z] + prior) * totals[z] / totals[new]
        z = np.where(uniform(key, stream + m) < ratio, new, z)
    drawn = np.stack([draw(counts, row, prior, uniform(key, stream + PROPOSALS + m)) for m in range(PROPOSALS)], 1)
    return z, drawn


def ints(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def tallies(row: np.ndarray, z: np.ndarray, rows: int, k: int) -> pa.Array:
    """How many tokens of each row are of each topic, as arrays."""
    return lists(np.bincount(row * k + z, minlength=rows * k), np.full(rows, k))


def side_counts(cells: DataFrame, side: str, k: int) -> DataFrame:
    """(side, all): tokens of each topic, as an array, summed from those of pieces."""
    each = cells.select(side, F.posexplode("c").alias("topic", "n")).groupBy(side, "topic").agg(F.sum("n").alias("n"))
    held = each.groupBy(side).agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("m"))
    return held.select(side, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("all"))


def _counted(pieces: DataFrame, k: int) -> DataFrame:
    """Pieces with the counts of their topics."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("z").value_lengths().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, tallies(np.repeat(np.arange(len(b)), n), ints(b.column("z")), len(b), k)], [*b.schema.names, "c"])

    return pieces.mapInArrow(work, StructType([*pieces.schema.fields, StructField("c", ArrayType(IntegerType()))]))


def _run(cells: DataFrame, side: str, n_side: int, k: int, prior: float, totals: np.ndarray, stream: int, records: int) -> DataFrame:
    """One phase over all pieces of cells: each meets the counts of its document or word."""
    # A piece is about as many numbers as it has tokens, and a row of counts.
    met = cells.join(small(side_counts(cells, side, k), n_side), side).select("d", "t", "h", "s", "z", "q", "all")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("z").value_lengths().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff((np.cumsum(sizes + k)) // CELLS, prepend=0)).tolist()
            for lo, hi in zip([0, *cut], [*cut, len(whole)], strict=True):
                if lo < hi:
                    b, n = whole.slice(lo, hi - lo), sizes[lo:hi]
                    counts = ints(b.column("all")).reshape(len(b), k).astype(float)
                    key = token_keys(b.column("h").to_numpy(zero_copy_only=False), n, b.column("s").to_numpy(zero_copy_only=False))
                    row = np.repeat(np.arange(len(b)), n)
                    z, q = phase(ints(b.column("z")), ints(b.column("q")).reshape(-1, PROPOSALS), row, counts, prior, totals, key, stream)
                    same = [b.column(c) for c in ("d", "t", "h", "s")]
                    yield pa.RecordBatch.from_arrays([*same, lists(z, n), lists(q.ravel(), n * PROPOSALS), tallies(row, z, len(b), k)], ["d", "t", "h", "s", "z", "q", "c"])

    return staged(met.mapInArrow(work, cells.schema), "tokens", records=records)


def topic_totals(cells: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k)
    for r in cells.select(F.posexplode("c").alias("topic", "n")).groupBy("topic").agg(F.sum("n").alias("n")).collect():
        out[r.topic] = r.n
    return out


def sample_topics(doc_term: DataFrame, k: int, count: str = "pseudo_count", sweeps: int = 50, alpha: float | None = None, beta: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(theta, phi) of (doc_id, term_id, count): whole counts above 0 are tokens, added where a cell repeats; ``alpha`` is
    50 / k by default.

    A cell holds its tokens' topics and proposals. In a phase it meets the counts of its word, or of its document,
    made from all tokens of the phase before, so tokens of one word or document need not be in one task, however
    many there are. A cell of many tokens is several pieces, and pieces are dealt to files of about ``FILE_TOKENS``, so
    few cells of many tokens are many tasks too; counts are summed from those of pieces. Every phase is staged; random
    numbers come from the seed, the cell and the place, so a task that runs again, and another partitioning, give the
    same topics.
    """
    alpha = 50.0 / k if alpha is None else alpha
    rows = doc_term.where(F.col(count) >= 1).groupBy(F.col("doc_id").alias("d"), F.col("term_id").alias("t")).agg(F.sum(F.col(count).cast("long")).cast("int").alias("n"))
    rows = staged(rows, "cells")
    last = F.floor((F.col("n") - 1) / PIECE).cast("int")
    n_docs, n_terms, tokens, pieces = rows.agg(F.countDistinct("d"), F.countDistinct("t"), F.sum("n"), F.sum(last + 1)).first()
    files = -(-(tokens or 0) // FILE_TOKENS) or 1
    records = -(-(pieces or 0) // files) or 1
    cut = rows.withColumn("s", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * PIECE))).repartition(files, "d", "t", "s")
    first = cut.withColumn("h", F.xxhash64(F.lit(seed), F.col("d"), F.col("t"))).withColumn("e", F.least(F.col("n"), F.col("s") + PIECE))
    pick = lambda i, salt: F.pmod(F.xxhash64("h", i, F.lit(salt)), F.lit(k)).cast("int")
    z = F.transform(F.sequence(F.col("s") + 1, F.col("e")), lambda i: pick(i, "z"))
    q = F.transform(F.sequence(F.col("s") * PROPOSALS + 1, F.col("e") * PROPOSALS), lambda i: pick(i, "q"))
    cells = staged(_counted(first.select("d", "t", "h", "s", z.alias("z"), q.alias("q")), k), "tokens", records=records)
    for sweep in range(sweeps if n_docs else 0):
        for side, size, prior, at in (("t", n_terms, beta, 0), ("d", n_docs, alpha, 1)):
            totals = topic_totals(cells, k) + n_terms * beta
            after = _run(cells, side, size, k, prior, totals, (2 * sweep + at) * 2 * PROPOSALS, records)
            forget(cells)
            cells = after
    totals = topic_totals(cells, k)
    share = lambda df, name, value: df.select(name, F.posexplode(value).alias("at", "x")).withColumn("topic", (F.col("at") + 1).cast("int"))
    own = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x)
    theta = share(side_counts(cells, "d", k), "d", F.transform("all", lambda x: (x + alpha) / (own + k * alpha)))
    below = F.array(*[F.lit(float(v + n_terms * beta)) for v in totals])
    phi = share(side_counts(cells, "t", k), "t", F.zip_with("all", below, lambda x, y: (x + beta) / y))
    return theta.select(F.col("d").alias("doc_id"), "topic", F.col("x").alias("theta")), phi.select("topic", F.col("t").alias("term_id"), F.col("x").alias("phi"))
