"""Non-negative factors of a sparse table by multiplicative updates: cells meet factors in joins, factors are arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.operators.numbering import small
from weftlink.sources.staging import forget, staged

METHODS = ("brunet", "lee", "nsNMF")
#: Added to what is divided by.
EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def numbers(v: np.ndarray) -> Column:
    """A small vector or matrix as a literal array."""
    v = np.asarray(v, float)
    return F.array(*[numbers(x) if v.ndim > 1 else F.lit(float(x)) for x in v])


def smooth(f: Column, k: int, theta: float) -> Column:
    """Each entry drawn to the mean of all by the share ``theta``."""
    mean = F.aggregate(f, F.lit(0.0), lambda s, x: s + x) / k
    return F.transform(f, lambda x: (1 - theta) * x + theta * mean)


def first_factors(names: DataFrame, name: str, k: int, top: float, seed: int, run: int) -> DataFrame:
    """(name, f): factors between 0 and the largest cell, from hashes of the name, so equal at any partitioning."""
    unit = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(run), F.lit(name), F.col(name), F.lit(i)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return names.select(name, F.array(*[unit(i) * top for i in range(k)]).alias("f"))


@dataclass
class Table:
    """Cells with the sizes of both sides and the largest cell."""

    cells: DataFrame
    rows: int
    columns: int
    top: float


def column_sums(f: DataFrame, k: int) -> np.ndarray:
    return np.array(f.agg(*[F.sum(F.col("f")[i]) for i in range(k)]).first(), float)


def gram(f: DataFrame, k: int) -> np.ndarray:
    """The k x k products of a side's factors."""
    got = f.agg(*[F.sum(F.col("f")[i] * F.col("f")[j]) for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = got
    return np.maximum(out, out.T)


def half_step(t: Table, mine: DataFrame, other: DataFrame, me: str, it: str, n_me: int, n_it: int, k: int, method: str, theta: float) -> DataFrame:
    """The factors of one side after an update against the other's. Cells are summed before the shuffle, one row a name."""
    there = other.select(it, (smooth(F.col("f"), k, theta) if method == "nsNMF" else F.col("f")).alias("g"))
    rows = t.cells.join(small(there, n_it), it)
    if method == "lee":
        part = F.transform("g", lambda x: x * F.col("x"))
        below = gram(other, k)
        under = F.transform(numbers(below), lambda row: dot(row, F.col("f")) + EPS)
    else:
        rows = rows.join(small(mine, n_me), me)
        ratio = F.col("x") / (dot(F.col("g"), F.col("f")) + EPS)
        part = F.transform("g", lambda x: x * ratio)
        below = column_sums(there.withColumnRenamed("g", "f"), k)
        under = numbers(below + EPS)
    sums = rows.select(me, part.alias("p")).groupBy(me).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias("s"))
    moved = F.zip_with(F.zip_with("f", "s", lambda a, b: a * b), under, lambda a, b: a / b)
    return staged(mine.join(small(sums, n_me), me).select(me, moved.alias("f")), "factors")


def loss_of(t: Table, w: DataFrame, h: DataFrame, k: int, method: str, theta: float) -> float:
    """Divergence of the cells from the product, or half the squared distance (``lee``); empty cells count too."""
    g = smooth(F.col("f"), k, theta) if method == "nsNMF" else F.col("f")
    both = t.cells.join(small(w.select("d", g.alias("w")), t.rows), "d").join(small(h.withColumnRenamed("f", "h"), t.columns), "t").select("x", dot(F.col("w"), F.col("h")).alias("m"))
    if method == "lee":
        r = both.agg(F.sum(F.col("x") ** 2).alias("xx"), F.sum(F.col("x") * F.col("m")).alias("xm")).first()
        return float(r.xx / 2 - r.xm + (gram(w, k) * gram(h, k)).sum() / 2)
    part = both.agg(F.sum(F.col("x") * F.log((F.col("x") + EPS) / (F.col("m") + EPS)) - F.col("x")).alias("s")).first()["s"]
    return float(part + column_sums(w.select(g.alias("f")), k) @ column_sums(h, k))


def factors(doc_term: DataFrame, k: int, count: str = "weight", method: str = "brunet", runs: int = 1, rounds: int = 100, seed: int = 1, tolerance: float = 1e-5, every: int = 10, theta: float = 0.5) -> tuple[DataFrame, DataFrame, dict]:
    """(documents, terms, figures): factors (d, f) and (t, f) of the cells (doc_id, term_id, count), the best of several
    starts. Cells are added where they repeat; those that are null or not above 0 are empty.

    ``brunet`` lowers the divergence, ``lee`` the squared distance, ``nsNMF`` the divergence with smoothed factors, its
    document factors scaled to columns of sum 1. A start ends after ``rounds`` or when ``every`` rounds lower the loss by less
    than the tolerance's share. Only sums of k, or k x k, numbers reach the driver.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    cells = doc_term.where(F.col(count) > 0).groupBy(F.col("doc_id").alias("d"), F.col("term_id").alias("t")).agg(F.sum(F.col(count).cast("double")).alias("x"))
    cells = staged(cells, "cells")
    docs, terms = staged(cells.select("d").distinct(), "documents"), staged(cells.select("t").distinct(), "terms")
    top = cells.agg(F.max("x")).first()[0]
    t = Table(cells, docs.count(), terms.count(), top or 0.0)
    best = None
    for run in range(runs):
        w, h = staged(first_factors(docs, "d", k, t.top, seed, run), "factors"), staged(first_factors(terms, "t", k, t.top, seed, run), "factors")
        losses = []
        for done in range(rounds if top else 0):
            new = half_step(t, h, w, "t", "d", t.columns, t.rows, k, method, theta)
            forget(h)
            h = new
            new = half_step(t, w, h, "d", "t", t.rows, t.columns, k, method, theta)
            forget(w)
            w = new
            if method == "nsNMF":
                scale = numbers(column_sums(w, k) + EPS)
                new = staged(w.select("d", F.zip_with("f", scale, lambda a, b: a / b).alias("f")), "factors")
                forget(w)
                w = new
            if (done + 1) % every == 0 or done == rounds - 1:
                losses.append(loss_of(t, w, h, k, method, theta))
                if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * abs(losses[-2]):
                    break
        if best is None or (losses and losses[-1] < best[2]["loss"]):
            best = w, h, {"k": k, "loss": losses[-1] if losses else 0.0, "losses": losses, "run": run}
    return best
