"""Communities of a weighted graph of any size: moves of many nodes at once that raise modularity, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftlink.operators.numbering import numbered_within, small
from weftlink.sources.staging import FILE_ROWS, forget, numbered, staged


def modularity(edges: DataFrame, own: DataFrame) -> float:
    """Share of weight within communities beyond what their degrees let expect; ``edges`` (i, j, w) undirected, ``own`` (i, c)."""
    n = own.count()
    a, b = own.select(F.col("i").alias("ai"), F.col("c").alias("ca")), own.select(F.col("i").alias("bi"), F.col("c").alias("cb"))
    rows = edges.join(small(a, n), F.col("i") == F.col("ai")).join(small(b, n), F.col("j") == F.col("bi"))
    ends = rows.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w"))).alias("e")).groupBy("e.c").agg(F.sum("e.w").alias("t"))
    r = rows.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside")).first()
    if not r.m:
        return 0.0
    return float(r.inside / r.m - ends.agg(F.sum((F.col("t") / (2 * r.m)) ** 2)).first()[0])


def _part(df: DataFrame, few: bool) -> DataFrame:
    """A table of a graph of few rows as one part: its sums and joins then need neither shuffles nor broadcasts, so a round
    is one job of one stage."""
    return df.coalesce(1) if few else df


def _beside(df: DataFrame, n: int, few: bool) -> DataFrame:
    """A side of a join, of at most ``n`` rows."""
    return df.coalesce(1).hint("shuffle_hash") if few else small(df, n)


def _moves(edges: DataFrame, seed: int, rounds: int, level: int, settle: float, few: bool) -> tuple[DataFrame, int]:
    """(i, c) after local moves, and how many were made. Each round half of the nodes, by hash, look at the communities of
    their neighbours and move to the best one; of two lone nodes the larger moves, so none change places."""
    edges = _part(edges, few)
    degree = edges.select(F.explode(F.array(F.struct("i", "w"), F.struct(F.col("j").alias("i"), "w"))).alias("e")).groupBy("e.i").agg(F.sum("e.w").alias("k"))
    own = staged(degree.withColumn("c", F.col("i")), "communities")
    n, total = own.agg(F.count(F.lit(1)), F.sum("k")).first()
    # A node is its own neighbour at weight 0: the own community is a choice even where no neighbour is in it.
    ways = F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    both = edges.where("i <> j").select(F.explode(ways).alias("e")).select("e.*")
    both = both.unionByName(own.select("i", F.col("i").alias("j"), F.lit(0.0).alias("w")))
    both = staged(_part(both, few).join(_beside(_part(own, few).select("i", "k"), n, few), "i"), "both-ways")
    moved, still = 0, 0
    for turn in range(rounds):
        wakes = f"pmod(xxhash64({seed}, {level}, {turn}, i), 2) = 0"
        now = _part(own, few)
        size = now.groupBy("c").agg(F.expr("sum(k) AS t"), F.expr("count(1) AS n"))
        there = now.selectExpr("i AS j", "c").join(_beside(size, n, few), "c")
        near = _part(_part(both, few).where(f"{wakes} OR i = j").join(_beside(there, n, few), "j"), few)
        rows = near.groupBy("i", "c").agg(F.expr("struct(sum(w) AS to, max(i = j) AS own, max(k) AS k, max(t) AS t, max(n) AS n) AS s")).selectExpr("i", "c", "s.*")
        rows = rows.selectExpr("*", f"to - (t - CASE WHEN own THEN k ELSE 0D END) * k / {float(total)!r}D AS gain")
        best = rows.groupBy("i").agg(F.expr("max(k) AS k"), F.expr("max(struct(gain, -c AS minus, n)) AS b"), F.expr("max(CASE WHEN own THEN struct(gain, n, c) END) AS o"))
        # Nodes that sleep have their own community alone to choose. Of two lone nodes the smaller stays.
        went = f"b.gain > o.gain + {1e-12 * float(total)!r}D AND NOT (b.n = 1 AND o.n = 1 AND -b.minus > i)"
        counted = Observation()
        after = best.selectExpr("i", "k", f"{went} AS went", "b.minus", "o.c").selectExpr("i", "k", "CASE WHEN went THEN -minus ELSE c END AS c", "went")
        after = staged(after.observe(counted, F.expr("count_if(went) AS went")).drop("went"), "communities")
        forget(own)
        own, gone = after, counted.get["went"]
        moved += gone
        # Halves take turns: only two quiet rounds end a level.
        still = still + 1 if gone <= settle * n else 0
        if still == 2:
            break
    forget(both)
    return own.select("i", "c"), moved


def communities(links: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", seed: int = 1, rounds: int = 40, levels: int = 20, settle: float = 0.001) -> DataFrame:
    """(node, community): communities of high modularity of the undirected links (a, b, weight above 0), numbered from 1 by
    their smallest node.

    Gains of moves are sums of the links by node and community. When moves end, communities become the nodes of a
    graph of summed links, until a level moves nothing. No node's links, and no links as a whole, come to one task.
    """
    rows = links.where((F.col(weight) > 0) & F.col(a).isNotNull() & F.col(b).isNotNull())
    summed = rows.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    summed = staged(summed, "links")
    names = staged(numbered(summed.select(F.col("a").alias("node")).union(summed.select("b")).distinct(), ["node"], "i"), "nodes")
    n = names.count()
    # Nodes and both ways of the links, at most, of what is one part; levels above only have fewer.
    few = n + 2 * summed.count() <= FILE_ROWS
    left, right = names.select(F.col("node").alias("a"), "i"), names.select(F.col("node").alias("b"), F.col("i").alias("j"))
    edges = staged(summed.join(small(left, n), "a").join(small(right, n), "b").select("i", "j", "w"), "edges")
    of = names.select("node", F.col("i").alias("c"))
    for level in range(levels if n else 0):
        own, moved = _moves(edges, seed, rounds, level, settle, few)
        if not moved:
            break
        own = _part(own, few)
        step = own.select(F.col("i").alias("c"), F.col("c").alias("up"))
        of = staged(_part(of, few).join(_beside(step, n, few), "c").select("node", F.col("up").alias("c")), "membership")
        x, y = own.select("i", F.col("c").alias("ci")), own.select(F.col("i").alias("j"), F.col("c").alias("cj"))
        higher = _part(edges, few).join(_beside(x, n, few), "i").join(_beside(y, n, few), "j")
        edges = staged(higher.groupBy(F.least("ci", "cj").alias("i"), F.greatest("ci", "cj").alias("j")).agg(F.sum("w").alias("w")), "edges")
    firsts = of.groupBy("c").agg(F.min("node").alias("first"))
    labels = numbered_within(firsts.withColumn("all", F.lit(1)), ["all"], ["first"], "number").select("c", (F.col("number") + 1).cast("int").alias("community"))
    return of.join(small(labels, n), "c").select("node", "community")
