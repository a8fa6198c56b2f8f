"""Running-sum enrichment: scores of gene sets over ranked genes, chances down to very small ones by multilevel splitting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.stats import benjamini_hochberg
from weftlink.operators.numbering import numbered_within, same, small
from weftlink.sources.staging import staged

#: Genes that one ranking holds, at most: its weights go to every task that draws sets from it.
MAX_RANKED = 2_000_000
#: Random sets as extreme that are enough to take a share of them; chains of a level; the smallest chance sought.
ENOUGH, CHAINS, LEAST_P = 10, 201, 1e-50
#: Numbers of random sets that are held in memory at once.
CELLS = 1 << 22


def scores(at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Score of each row of sorted places: the largest distance of the weighted share of hits from the share of misses."""
    m = at.shape[1]
    hits = np.cumsum(w[at], axis=1)
    total = hits[:, -1:]
    if m >= n:
        return np.zeros(len(at))
    hits = hits / np.where(total > 0, total, 1)
    miss = (at - np.arange(m)) / (n - m)
    up = (hits - miss).max(1)
    down = np.minimum(np.concatenate([np.zeros((len(at), 1)), hits[:, :-1]], 1) - miss, 0).min(1)
    return np.where(total[:, 0] > 0, np.where(up > -down, up, down), 0.0)


def random_sets(rng: np.random.Generator, count: int, m: int, n: int) -> np.ndarray:
    """Sorted places of random sets."""
    step = max(1, CELLS // n)
    parts = [np.argpartition(rng.random((min(step, count - at), n)), m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (min(step, count - at), 1)) for at in range(0, count, step)]
    return np.sort(np.concatenate(parts), axis=1)


def moved(rng: np.random.Generator, at: np.ndarray, value: np.ndarray, w: np.ndarray, n: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Sets after each has offered to change its places one by one, keeping a score of the level or more."""
    k, m = at.shape
    for _ in range(max(m, 20)):
        new, out = rng.integers(0, n, k), rng.integers(0, m, k)
        fresh = ~(at == new[:, None]).any(1)
        offer = at.copy()
        offer[np.arange(k), out] = new
        offer.sort(axis=1)
        got = scores(offer, w, n)
        take = fresh & (got >= level)
        at, value = np.where(take[:, None], offer, at), np.where(take, got, value)
    return at, value


def tail_by_levels(rng: np.random.Generator, w: np.ndarray, m: int, targets: np.ndarray, chains: int = CHAINS, least: float = LEAST_P) -> np.ndarray:
    """Chance that a random set scores at least each target: the better half of the sets is kept and spread again and again."""
    n, out, log_p, last = len(w), np.full(len(targets), np.nan), 0.0, -np.inf
    at = random_sets(rng, chains, m, n)
    value = scores(at, w, n)
    while np.isnan(out).any():
        level = float(np.sort(value)[chains // 2])
        if level <= last and (value > last).any():
            # Half of the sets or more have one score: the next one above it is the level.
            level = float(value[value > last].min())
        last = level
        now = np.isnan(out) & ((targets <= level) | (log_p < np.log(least)) | (level >= value.max()))
        out[now] = np.exp(log_p) * np.maximum((value[None, :] >= targets[now][:, None]).mean(1), 1 / (chains + 1))
        if not np.isnan(out).any():
            break
        keep = np.flatnonzero(value >= level)
        log_p += np.log(len(keep) / chains)
        pick = np.concatenate([keep, rng.choice(keep, chains - len(keep))])
        at, value = moved(rng, at[pick], value[pick], w, n, level)
    return out


def chances(rng: np.random.Generator, w: np.ndarray, m: int, observed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, normalised score) of observed scores among random sets of one size; by side, and by levels where too few random
    sets are as extreme."""
    n = len(w)
    null = scores(random_sets(rng, rounds, m, n), w, n)
    p, scaled = np.full(len(observed), np.nan), np.full(len(observed), np.nan)
    for sign, ranked in ((1, w), (-1, w[::-1])):
        mine = np.flatnonzero(observed >= 0 if sign > 0 else observed < 0)
        side = np.abs(null[null >= 0] if sign > 0 else null[null < 0])
        if not len(mine):
            continue
        e = np.abs(observed[mine])
        as_far = len(side) - np.searchsorted(np.sort(side), e, "left")
        p[mine] = (1 + as_far) / (1 + len(side))
        if len(side) and side.mean() > 0:
            scaled[mine] = observed[mine] / side.mean()
        rare = (as_far < ENOUGH) & (e > 0)
        if rare.any() and m < n:
            # From the other end of the ranking, a score below 0 is one above.
            p[mine[rare]] = np.minimum(tail_by_levels(rng, ranked, m, e[rare]) * (1 + rounds) / (1 + len(side)), 1.0)
    return p, scaled


def running_sum(ranks: DataFrame, pathways: DataFrame, min_size: int = 10, max_size: int = 500, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(topic, set, size, es, nes, p, p_adj, leading_edge) by the weighted running sum over a topic's ranked genes (topic, gene,
    score), against random sets of equal size. A set's size is that of its overlap with the ranked genes; a gene that
    repeats counts with its best score; the leading edge are the set's genes up to the largest distance.

    Genes are numbered in place, sets meet them in a join, and a set's score is made from its own places. Random sets are
    drawn once a topic and size of set, each a task's work of its own, so no topic is one task. A ranking of more than
    ``MAX_RANKED`` genes is refused.
    """
    best = ranks.where("gene is not null and score is not null").groupBy("topic", "gene").agg(F.max("score").alias("score"))
    ranked = staged(numbered_within(best.withColumn("minus", -F.col("score").cast("double")), ["topic"], ["minus", "gene"], "i").withColumn("w", F.abs(F.col("minus"))), "ranked-genes")
    topics = staged(ranked.groupBy("topic").agg(F.count(F.lit(1)).alias("n")), "topics")
    n_topics, most = topics.agg(F.count(F.lit(1)), F.max("n")).first()
    if (most or 0) > MAX_RANKED:
        raise ValueError(f"a ranking of {most} genes; running sums take {MAX_RANKED} at most")
    met = ranked.join(pathways.select("set", "gene").distinct(), "gene").select("topic", "set", "i", "w", "gene")
    sized = met.groupBy("topic", "set").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(min_size, max_size))
    held = met.alias("m").join(sized.alias("s"), same("m", "s", ["topic", "set"]), "left_semi")
    sets = held.groupBy("topic", "set").agg(F.array_sort(F.collect_list(F.struct("i", "w", "gene"))).alias("g"))
    sets = sets.alias("x").join(small(topics, n_topics).alias("t"), same("x", "t", ["topic"])).select("x.topic", "x.set", "t.n", "x.g.i", "x.g.w", "x.g.gene")
    kinds = {c: t for c, t in (*ranks.dtypes, *pathways.dtypes)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            es, edge = [], []
            for n, at, w, genes in zip(b["n"], b["i"], b["w"], b["gene"], strict=True):
                # The set's own weights stand at its places; no other place is read.
                own = np.asarray(w, float)
                hits, miss = np.cumsum(own), (np.asarray(at) - np.arange(len(own))) / max(1, n - len(own))
                if not hits[-1] or len(own) == n:
                    es.append(0.0)
                    edge.append([])
                    continue
                hits = hits / hits[-1]
                up, down = hits - miss, np.concatenate([[0], hits[:-1]]) - miss
                es.append(float(up.max() if up.max() > -min(down.min(), 0) else down.min()))
                edge.append(list(genes[: up.argmax() + 1] if es[-1] >= 0 else genes[down.argmin() :]))
            yield pd.DataFrame({"topic": b["topic"], "set": b["set"], "size": b["n"] * 0 + [len(x) for x in b["i"]], "es": es, "leading_edge": edge})

    shape = f"topic {kinds['topic']}, set {kinds['set']}, size long, es double, leading_edge array<{kinds['gene']}>"
    found = staged(sets.mapInPandas(score, shape), "scores")
    weights = ranked.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("weights"))
    work = found.groupBy("topic", "size").agg(F.array_sort(F.collect_set("es")).alias("es"))
    work = work.alias("k").join(weights.alias("w"), same("k", "w", ["topic"])).select("k.topic", "k.size", "k.es", "w.weights")

    def null(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for topic, size, es, w in zip(b["topic"], b["size"], b["es"], b["weights"], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(topic).encode()), int(size)])
                p, scaled = chances(rng, np.asarray(w, float), int(size), np.asarray(es, float), rounds)
                yield pd.DataFrame({"topic": [topic] * len(p), "size": [size] * len(p), "es": es, "nes": pd.Series(scaled).astype(object).where(np.isfinite(scaled), None), "p": p})

    tails = staged(work.repartition("topic", "size").mapInPandas(null, f"topic {kinds['topic']}, size long, es double, nes double, p double"), "chances")
    on = [F.col("f.topic").eqNullSafe(F.col("t.topic")), F.col("f.size") == F.col("t.size"), F.col("f.es") == F.col("t.es")]
    out = found.alias("f").join(tails.alias("t"), on).select("f.topic", "f.set", F.col("f.size").cast("int").alias("size"), "f.es", "t.nes", "t.p", "f.leading_edge")
    return benjamini_hochberg(out, "p", "p_adj", ("topic",)).select("topic", "set", "size", "es", "nes", "p", "p_adj", "leading_edge")
