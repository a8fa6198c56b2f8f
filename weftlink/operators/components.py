"""Connected components of links of any size, and links of rows that agree in most places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.sources.staging import forget, staged

#: Rows of a bucket that are compared as one block, at most.
BLOCK = 1024


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``links`` with the smallest node that it is linked to, over any number of links.

    Each round hangs the larger neighbours of a node on its smallest one, and then every node with its other smaller
    neighbours on the smallest of these; a graph is done when all its nodes hang on one. Rounds grow with the
    logarithm of the links. They are sums and joins, each staged, so a node with very many links is no task's work.
    """
    down = lambda df: df.where("hi <> lo").distinct()
    start = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = staged(down(start.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))), "links")
    for _ in range(rounds):
        ends = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("at", "near")
        least = staged(ends.groupBy("at").agg(F.least(F.min("near"), F.col("at")).alias("least")), "least")
        above = ends.join(least, "at").where("near > at").select(F.col("near").alias("hi"), F.col("least").alias("lo"))
        large = staged(down(above), "large")
        least_below = staged(large.groupBy("hi").agg(F.min("lo").alias("least")), "least-below")
        others = large.join(least_below, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = staged(down(others.unionByName(least_below.withColumnRenamed("least", "lo"))), "small")
        # Done when every node has one link down and none has any further down.
        deeper = small.join(small.select(F.col("hi").alias("top")).distinct(), F.col("lo") == F.col("top"), "left_semi").limit(1).count()
        forget(now, least, large, least_below)
        now = small
        if not deeper and not small.groupBy("hi").count().where("count > 1").limit(1).count():
            heads = now.select(F.col("lo").alias("node")).distinct()
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(heads.withColumn("component", F.col("node")))
    raise RuntimeError("components did not settle")


def spanning_links(x: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, head): links that join all rows which chains of agreement in ``need`` places join; heads are left out."""
    head = np.full(len(x), -1)
    rows, heads = [], []
    for i in range(len(x)):
        if head[i] >= 0:
            continue
        head[i], front = i, [i]
        while front:
            free = np.flatnonzero(head < 0)
            if not len(free):
                break
            near = free[(x[free] == x[front.pop()]).sum(1) >= need]
            head[near] = i
            front.extend(near.tolist())
            rows.append(near)
            heads.append(np.full(len(near), i))
    none = np.zeros(0, int)
    return np.concatenate(rows or [none]), np.concatenate(heads or [none])


def _runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal key of a sorted partition, one frame a key; the last one of a batch waits for the next."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        v = b[key].to_numpy()
        edges = [0, *(np.flatnonzero((v[1:] != v[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
            yield b.iloc[lo:hi]
        rest = b.iloc[edges[-2] :]
    if rest is not None:
        yield rest


def agreeing(rows: DataFrame, group: str, key: str, values: str, least: float, block: int = BLOCK) -> DataFrame:
    """(group, key, cluster): rows of one group whose arrays are equal (null like null) in at least ``least`` of all
    places are linked; a cluster is a chain of links, named by its smallest key. Arrays have one length.

    Equal arrays are one class. Arrays that agree in k of m places share one of any m - k + 1 of their (place, value)
    pairs, if both take them in one order: each class is held only against those that share one of its m - k + 1 rarest
    pairs. What shares a pair is compared in blocks, block with block, and passes on a spanning forest of its
    links, so a group of any size, and a value that most of it shares, are many tasks.
    """
    own = [f.dataType.simpleString() for f in (rows.schema[group], rows.schema[key])]
    # Null is like null; infinity stands for it, as values are finite or null.
    flat = staged(rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.transform(values, lambda v: F.coalesce(v.cast("double") + F.lit(0.0), F.lit(float("inf")))).alias("v")), "signatures")
    classes = staged(flat.groupBy("g", "v").agg(F.min("k").alias("head"), F.count(F.lit(1)).alias("n")), "classes")
    width = classes.agg(F.max(F.size("v"))).first()[0] or 0
    need = max(1, int(np.ceil(least * width - 1e-9)))
    cells = classes.select("g", "head", F.posexplode("v").alias("place", "value"))
    often = cells.groupBy("g", "place", "value").agg(F.count(F.lit(1)).alias("often"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("g", "place", "value")]
    ranked = cells.alias("c").join(often.alias("o"), same).select("c.*", "o.often")
    rare = F.slice(F.array_sort(F.collect_list(F.struct("often", "place", "value"))), 1, width - need + 1)
    prefix = ranked.groupBy("g", "head").agg(rare.alias("rare")).select("g", "head", F.explode("rare").alias("r")).where("r.often > 1")
    blocks = F.ceil(F.col("r.often") / block).cast("int")
    placed = prefix.withColumn("i", F.pmod(F.xxhash64("head"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    meet = [F.least("i", "j"), F.greatest("i", "j"), F.col("r.place"), F.col("r.value")]
    # Two hashes name a bucket and its pair of blocks.
    dealt = placed.select("g", "head", F.xxhash64("g", *meet).alias("p"), F.xxhash64(F.lit("q"), *meet, "g").alias("q"))
    dealt = dealt.alias("d").join(classes.select("g", "head", "v").alias("c"), [F.col("d.g").eqNullSafe(F.col("c.g")), F.col("d.head").eqNullSafe(F.col("c.head"))]).select("d.head", "d.p", "d.q", "c.v")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in _runs(batches, ["p", "q"]):
            if len(one) > 1:
                a, b = spanning_links(np.stack(one["v"].to_numpy()), need)
                names = one["head"].to_numpy()
                yield pd.DataFrame({"a": names[a], "b": names[b]})

    found = dealt.repartition("p", "q").sortWithinPartitions("p", "q").mapInPandas(link, f"a {own[1]}, b {own[1]}").distinct()
    joined = components(found)
    named = classes.join(joined, F.col("head") == F.col("node"), "left").select("g", "v", F.coalesce("component", "head").alias("cluster"))
    mine = [F.col("r.g").eqNullSafe(F.col("n.g")), F.col("r.v") == F.col("n.v")]
    return flat.alias("r").join(named.alias("n"), mine).select(F.col("r.g").alias(group), F.col("r.k").alias(key), "n.cluster")
