"""Vector codes by product quantisation, its codebooks trained by Yinyang Lloyd in whole numbers.

A vector is cut into parts; each part position has a codebook. The entries of a codebook are clustered into
groups of about ten once. With a vector go, for each part, its entry and a lower bound of the distance to
every other entry of each group. After entries have moved, a bound is lowered by the largest move in its
group. The distance to the own entry is then found exactly; a group whose lowered bound is above it holds
no entry as near and is passed over, and only the other groups are scanned. Bounds are floating-point
numbers rounded down and moves are rounded up, so they decide only what is scanned: every distance that
decides an entry is a sum of squares of whole numbers, and ties go to the lower index.

Bounds and entries are staged from round to round beside the vectors. Each round passes on one sum a task
and entry; codebooks, whose size is a parameter times the length of a vector, are all that reaches the
driver.

Defined cases: vectors that are null or hold null or non-finite components take no part and have no row. The
parts must be equal, so of the lengths that the number of parts divides the commonest counts (the shorter
one, where two are as common); vectors of other lengths take no part. Rows that repeat a vec_id are vectors
of their own, in the order of their components where first entries are chosen; rows without a vec_id come
last there; with fewer vectors than entries, codebooks have as many entries as there are vectors; equal
entries stay apart, the lower index taking all; null labels are one label; an empty table gives an empty
result; other columns are ignored; components so large that a distance would not fit 64 bits are refused.
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

#: Parts of a vector, entries of a codebook, rounds that move entries, factor before rounding down.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a group, about; rows whose distances are held in memory at once.
GROUP, SLICE = 10, 1024

STATE = "id long, label int, x array<long>, now binary, lower binary"


def grouped(words: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """A group number for each entry of a codebook: a few rounds of k-means over the entries."""
    k = len(words)
    g = -(-k // size)
    w = words.astype(np.float64)
    heads = w[np.linspace(0, k - 1, g).astype(int)]
    for _ in range(rounds):
        near = ((w[:, None] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([w[near == j].mean(0) if (near == j).any() else heads[j] for j in range(g)])
    return ((w[:, None] - heads[None]) ** 2).sum(2).argmin(1)


def below(distance2: np.ndarray) -> np.ndarray:
    """A lower bound, in 32 bits, of the root of exact squares."""
    return np.nextafter(np.sqrt(distance2.astype(np.float64)).astype(np.float32), np.float32(-np.inf))


def reassign(x: np.ndarray, words: np.ndarray, group: np.ndarray, now: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds, distances made) for rows of one part.

    ``now`` is each row's entry so far and ``lower`` a bound, a group, of its distance to all other entries.
    """
    own = ((x - words[now]) ** 2).sum(1)
    best, dist, lower = now.copy(), own.copy(), lower.copy()
    scans, made = [], len(x)
    for g in range(lower.shape[1]):
        members = np.flatnonzero(group == g)
        # Above the distance to the best so far, and by more than a root may be off: nothing here is as near.
        at = np.flatnonzero(lower[:, g] <= np.sqrt(dist.astype(np.float64)) * (1 + 1e-9)) if len(members) else members
        if not len(at):
            continue
        d = ((x[at][:, None, :] - words[members]) ** 2).sum(2)
        made += d.size
        j = d.argmin(1)
        least, which = d[np.arange(len(at)), j], members[j]
        d[np.arange(len(at)), j] = np.iinfo(np.int64).max
        scans.append((g, at, which, least, d.min(1)))
        won = (least < dist[at]) | ((least == dist[at]) & (which < best[at]))
        best[at[won]], dist[at[won]] = which[won], least[won]
    # The entry that a row has left is one of the others of its group.
    left = np.flatnonzero(best != now)
    lower[left, group[now[left]]] = np.minimum(lower[left, group[now[left]]], below(own[left]))
    for g, at, which, least, second in scans:
        lower[at, g] = below(np.where(which == best[at], second, least))
    return best, dist, lower, made


def moved(lower: np.ndarray, old: np.ndarray, new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bounds lowered by the largest move in each group."""
    step = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64)) * (1 + 1e-9)
    drift = np.array([step[group == g].max(initial=0.0) for g in range(lower.shape[1])])
    return np.nextafter((lower.astype(np.float64) - drift).astype(np.float32), np.float32(-np.inf))


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.nbytes // max(1, len(rows))
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def entry_sums(state: DataFrame, parts: int, k: int, d: int) -> list:
    """(part, entry, n, sums) of every entry that some part is nearest to."""
    width = d // parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for b in batches:
            x = block(b.column("x"), d)
            now = np.frombuffer(b"".join(b.column("now").to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                n[p] += np.bincount(now[:, p], minlength=k)
                np.add.at(sums[p], now[:, p], x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]), "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))}
        )

    made = state.select("x", "now").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    wide = F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)])
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), wide.alias("sums")).collect()


def assigned(rows: DataFrame, old: np.ndarray | None, words: np.ndarray, groups: np.ndarray, schema: str) -> DataFrame:
    """``rows`` with the nearest entry of each part, the bounds and the error, as far as ``schema`` names them.

    ``old`` are the codebooks that the bounds in ``rows`` belong to; null where there are no bounds yet.
    """
    parts, k, width = words.shape
    d, n_groups = parts * width, int(groups.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = block(b.column("x"), d), len(b)
            now, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            lower = np.full((n, parts, n_groups), -np.inf, np.float32)
            if old is not None:
                now = np.frombuffer(b"".join(b.column("now").to_pylist()), np.uint8).reshape(n, parts).copy()
                lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.float32).reshape(n, parts, n_groups).copy()
            for p in range(parts):
                for at in range(0, n, SLICE):
                    s = slice(at, at + SLICE)
                    bound = lower[s, p] if old is None else moved(lower[s, p], old[p], words[p], groups[p])
                    now[s, p], dist, lower[s, p], _ = reassign(x[s, p * width : (p + 1) * width], words[p], groups[p], now[s, p].astype(np.intp), bound)
                    error[s] += dist
            made = {"id": b.column("id"), "label": b.column("label"), "x": b.column("x"), "now": fixed(now), "lower": fixed(lower), "error": pa.array(error)}
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([made[c] for c in names], names)

    return rows.mapInArrow(run, schema)


def vector_codes(
    df: DataFrame, parts: int = PARTS, k: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), one row a vector that takes part."""
    if not 1 <= k <= 256:
        raise ValueError("an entry's index is one byte")
    spark = df.sparkSession
    schema = "id long, code string, error long, label_error long, codebooks_sha256 string"
    everything = staged(integers(df.withColumnRenamed(label, "label"), key, vector, scale, "label"), "integer-vectors")
    size = F.size("x")
    length = everything.where((size > 0) & (size % parts == 0)).groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    vectors = everything.where(size == d)
    check_range(vectors, d)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(k).select("x").collect()
    words = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, d // parts).swapaxes(0, 1).copy()
    groups = np.stack([grouped(w) for w in words])
    labelled = f"label {vectors.schema['label'].dataType.simpleString()}"
    state, old = vectors, None
    for _ in range(rounds):
        new = staged(assigned(state, old, words, groups, STATE.replace("label int", labelled)), "codes-and-bounds")
        if old is not None:
            forget(state)
        state, old = new, words
        words = words.copy()
        for r in entry_sums(state, parts, len(first), d):
            words[r["part"], r["entry"]] = floor_means(r["sums"], r["n"])
    done = staged(assigned(state, old, words, groups, f"id long, {labelled}, now binary, error long"), "codes")
    forget(everything, *([state] if old is not None else []))
    digest = hashlib.sha256(",".join(map(str, words.ravel().tolist())).encode()).hexdigest()
    sums = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = staged(sums, "label-errors", like=done)
    named = small_side(sums.withColumnRenamed("label", "its_label"), sums.count())
    out = done.join(named, F.col("label").eqNullSafe(F.col("its_label")))
    return out.select("id", F.lower(F.hex("now")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
