"""Embedding near-duplicates with a forest of random-projection trees.

Vectors of one label are split by random hyperplanes at the median, again and again; vectors close
to a split go to both sides (spill). The upper part of a tree is fitted on a bounded hash sample;
below it, cells of more than ``CELL_ROWS`` vectors are split again, level by level, at quantiles that
are aggregates, and every other cell is split further where its vectors are: no task holds more than
such a cell at any size of table. Many trees are grown. Equal vectors of a label are one class, which
stands in the trees once and counts with its number of copies.

Splits cut through a group of near copies that is a large share of its cell. So before every split, upper
ones included, a hash sample of the cell is looked at: where one of its vectors (a pivot) has at least the
spill's share of them within the threshold, the cell does not fall apart there. The vectors of the cell within the
threshold of a pivot are its core; all their links in the cell lie within twice that angle. Core and
surroundings become a leaf of their own, in which core vectors are compared with all, block against block where it is
large; the other vectors of the cell are split further. A group's share of its cell grows with every split, so
it is seen at some level however small its share of the table is, as long as it is larger than a leaf.

Within a leaf vectors are compared exactly in double precision, in memory; a
pair counts in the smallest of the leaves that compare it, so no pair is written or counted
twice. Each leaf passes on one count a vector and a spanning forest of its links; components are
joined from the forests.

A vector that spills at every level stands in more leaves the deeper the tree: the spill of a level is
therefore at most ``SPILL_SUM`` over the number of levels, which holds the leaves of a vector at about
exp(2 * ``SPILL_SUM``) a tree at any size of table.

Defined cases: there is one result row a row. Vectors that are null, empty, zero or hold null or
non-finite components, and rows without a label or an id, link with nothing and are kept; vectors of
unlike length never link; rows that repeat a vec_id are vectors of their own, and link with each other if
they are alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.aq_search import matrix, usable
from weftlink.llm.common import connected_components, forget, numbered, small_side, staged

#: Trees, vectors in a leaf, share of a cell that spills over a split, vectors the upper splits are fitted on.
TREES, LEAF, SPILL, FIT_ROWS = 8, 512, 0.08, 4096
#: Sum of the spills of all levels of a tree, at most.
SPILL_SUM = 0.7
#: Vectors of a cell, at most, that one task splits into leaves.
CELL_ROWS = 50_000
#: A cell of the upper tree holds at least this many sample vectors, and about this many vectors.
SAMPLE_LEAF, UPPER_ROWS = 64, 12_500
#: Vectors of a cell that are looked at; vectors of the cell, and of those looked at, that a pivot stands for at least.
LOOK, DENSE, DENSE_SEEN = 256, 128, 8
#: Vectors in a block of a large leaf.
BLOCK = 4096
#: Earlier leaves of a part whose shared pairs are found by products; those of the rest are looked up.
COMMON = 256


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def pivots(seen: np.ndarray, rows: float, threshold: float, spill: float) -> np.ndarray:
    """Unit vectors out of those ``seen`` of a cell of ``rows``, densest first, until none has enough of those
    that are left within the threshold."""
    left, chosen = np.ones(len(seen), bool), []
    least = max(DENSE_SEEN, spill * len(seen), DENSE * len(seen) / max(rows, 1))
    near = seen @ seen.T >= threshold
    while len(seen) and (n := (near & left).sum(1)).max() >= least:
        best = int(n.argmax())
        chosen.append(best)
        left &= ~near[best]
    return seen[chosen]


def around(unit: np.ndarray, found: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the pivot it is core of, or -1, and whether it lies around each pivot."""
    # Twice the angle of the threshold, a little wider than the rounding of single precision.
    wide = 2 * threshold**2 - 1 - 1e-6 if threshold > 0 else -2.0
    cos = unit @ found.T
    best = cos.argmax(1)
    return np.where(cos[np.arange(len(unit)), best] >= threshold, best, -1), cos >= wide


def grow(x: np.ndarray, at: np.ndarray, leaf: int, spill: float, threshold: float, rng: np.random.Generator, path: int = 1) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Leaves (path, rows, which are core) of one random tree over the rows ``at`` of the unit vectors ``x``."""
    out = []
    if len(at) > leaf:
        seen = at if len(at) <= LOOK else at[rng.choice(len(at), LOOK, replace=False)]
        if len(found := pivots(x[seen], len(at), threshold, spill)):
            core, near = around(x[at], found, threshold)
            out += [(f"{path}:{k}", at[near[:, k]], core[near[:, k]] == k) for k in range(len(found)) if (core == k).any()]
            at = at[core < 0]
    if len(at) <= leaf or path >= 1 << 40:
        return [*out, (str(path), at, np.ones(len(at), bool))] if len(at) else out
    p = x[at] @ rng.standard_normal(x.shape[1])
    low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
    left, right = at[p <= high], at[p >= low]
    if len(left) == len(at) or len(right) == len(at):
        # Projections that cannot be told apart: halves by order, each with the other's edge.
        order = np.argsort(p, kind="stable")
        half, edge = len(at) // 2, max(1, int(len(at) * spill))
        left, right = at[np.sort(order[: half + edge])], at[np.sort(order[half - edge :])]
    return out + grow(x, left, leaf, spill, threshold, rng, 2 * path) + grow(x, right, leaf, spill, threshold, rng, 2 * path + 1)


class UpperTree:
    """Splits fitted on a sample of unit vectors, each of which stands for ``share`` vectors: node to low and high
    on a direction made from its number, and the pivots of a node."""

    def __init__(self, sample: np.ndarray, tree: int, spill: float, threshold: float, share: float):
        self.tree, self.nodes, self.found, self.d = tree, {}, {}, sample.shape[1]
        self.spill, self.threshold, self.share = spill, threshold, share
        self._fit(sample, 1)

    def _way(self, node: int) -> np.ndarray:
        return np.random.default_rng([self.tree, node]).standard_normal(self.d)

    def _fit(self, x: np.ndarray, node: int) -> None:
        if len(x) < 2 * SAMPLE_LEAF or len(x) * self.share <= UPPER_ROWS:
            return
        seen = x if len(x) <= LOOK else x[np.random.default_rng([self.tree, node, 2]).choice(len(x), LOOK, replace=False)]
        if len(found := pivots(seen, len(x) * self.share, self.threshold, self.spill)):
            self.found[node] = found
            x = x[around(x, found, self.threshold)[0] < 0]
            if len(x) < 2 * SAMPLE_LEAF:
                return
        p = x @ self._way(node)
        low, high = np.quantile(p, [0.5 - self.spill, 0.5 + self.spill])
        left, right = x[p <= high], x[p >= low]
        if len(left) == len(x) or len(right) == len(x):
            return
        self.nodes[node] = low, high
        self._fit(left, 2 * node)
        self._fit(right, 2 * node + 1)

    def route(self, x: np.ndarray, at: np.ndarray | None = None, node: int = 1) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, pivot, rows, which are core) of the cells (pivot -1) and of the leaves around pivots."""
        at, out = np.arange(len(x)) if at is None else at, []
        if node in self.found and len(at):
            core, near = around(x[at], self.found[node], self.threshold)
            out = [(node, k, at[near[:, k]], core[near[:, k]] == k) for k in range(near.shape[1])]
            at = at[core < 0]
        if node not in self.nodes or not len(at):
            return [*out, (node, -1, at, np.ones(len(at), bool))] if len(at) else out
        low, high = self.nodes[node]
        p = x[at] @ self._way(node)
        return out + self.route(x, at[p <= high], 2 * node) + self.route(x, at[p >= low], 2 * node + 1)


def earlier_leaves(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are in, and core of, the commonest leaves before this one; and keys of the rest, a row each (-1: none)."""
    own, keys = int(part["leaf"].iat[0]), part["leaves"].to_numpy()
    row, key = np.repeat(np.arange(len(part)), [len(k) for k in keys]), np.concatenate(keys).astype(np.int64)
    row, key = row[(key & -2) < own], key[(key & -2) < own]
    leaf, column, n = np.unique(key & -2, return_inverse=True, return_counts=True)
    # A leaf of one row shares no pair.
    order = np.argsort(-n, kind="stable")
    place = np.full(len(leaf), -1)
    common = order[:COMMON][n[order[:COMMON]] > 1]
    place[common] = np.arange(len(common))
    inside, core = np.zeros((len(part), len(common)), np.float32), np.zeros((len(part), len(common)), np.float32)
    hit = place[column] >= 0
    inside[row[hit], place[column[hit]]] = 1
    core[row[hit], place[column[hit]]] = key[hit] & 1
    more = ~hit & (n[column] > 1)
    row, column, flag = row[more], column[more], key[more] & 1
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    rest = np.full((len(part), int(nth.max()) + 1 if len(nth) else 0), -1, np.int64)
    rest[row, nth] = 2 * column + flag
    return inside, core, rest, (rest >= 0).any(1)


def leaf_links(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts and a spanning forest of the links of a leaf, or between two blocks of a large one: rows
    (a, n, null) and (a, null, b)."""
    part = part.sort_values(["block", "id"], kind="stable").reset_index(drop=True)
    unit, ids, copies = units(matrix(part["v"])), part["id"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
    own_core, block = (part["key"].to_numpy(np.int64) & 1).astype(bool), part["block"].to_numpy()
    a, b = np.nonzero(block == part["x"].iat[0])[0], np.nonzero(block == part["y"].iat[0])[0]
    inside, core, rest, has_rest = earlier_leaves(part)
    counts, top, links = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for lo in range(0, len(a), 256):
        rows = a[lo : lo + 256]
        near = (unit[rows] @ unit[b].T >= threshold) & (own_core[rows][:, None] | own_core[b]) & (b > rows[:, None])
        if inside.shape[1] and near.any():
            near &= core[rows] @ inside[b].T + inside[rows] @ core[b].T == 0
        i, j = np.nonzero(near & has_rest[rows][:, None] & has_rest[b])
        for at in range(0, len(i), 20_000):
            ii, jj = i[at : at + 20_000], j[at : at + 20_000]
            p, q = rest[rows[ii]], rest[b[jj]]
            shared = np.zeros(len(ii), bool)
            for c in range(rest.shape[1]):
                mine = p[:, c : c + 1]
                shared |= ((mine >= 0) & (q >= 0) & (mine >> 1 == q >> 1) & ((mine | q) & 1 == 1)).any(1)
            near[ii[shared], jj[shared]] = False
        counts[rows] += near @ copies[b]
        counts[b] += copies[rows] @ near
        for i, hits in zip(rows, near, strict=True):
            to = b[hits]
            other = to[top[to] != top[i]]
            if len(other):
                heads, first = np.unique(top[other], return_index=True)
                links += [(i, j) for j in other[first]]
                top[np.isin(top, heads)] = top[i]
    some = np.nonzero(counts > 0)[0]
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[some], ids[[p for p, _ in links]]]).astype(np.int64),
            "n": pd.array([*counts[some], *[None] * len(links)], dtype="Int64"),
            "b": pd.array([*[None] * len(some), *ids[[q for _, q in links]]], dtype="Int64"),
        }
    )


def in_blocks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows``, one a leaf, with the pairs of blocks (x, y) they meet in: one pair in leaves of up to ``BLOCK`` vectors;
    in larger ones blocks of core vectors meet all blocks."""
    is_core = F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1
    n = marks.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_core).alias("n_core")).where(F.col("n") > BLOCK)
    parts = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    n = staged(n.select("leaf", parts(F.col("n_core")).alias("cores"), parts(F.col("n") - F.col("n_core")).alias("others")), "leaves-large")
    rows = rows.join(small_side(n, n.count()), "leaf", "left")
    at = lambda blocks: F.pmod(F.xxhash64("id", "leaf"), F.col(blocks)).cast("int")
    rows = rows.withColumn("block", F.when(F.col("cores").isNull(), 0).when(is_core, at("cores")).otherwise(F.col("cores") + at("others")))
    last = F.when(F.col("cores").isNull(), 0).when(is_core, F.col("cores") + F.col("others") - 1).otherwise(F.col("cores") - 1)
    # A leaf of the upper tree may have no core in some labels: nothing is compared there.
    rows = rows.withColumn("o", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return rows.withColumn("x", F.least("block", "o")).withColumn("y", F.greatest("block", "o")).drop("cores", "others", "o")


CELL = ["label", "d", "tree", "node"]


def take_dense(rows: DataFrame, sizes: DataFrame, n_sizes: int, threshold: float, spill: float) -> tuple[DataFrame, DataFrame | None]:
    """What is left of large cells (label, d, tree, node, n) without the cores of their pivots, and the marks
    (id, mark, core) of the leaves around those; no task holds more than about ``CELL_ROWS`` vectors."""
    large = rows.join(small_side(sizes, n_sizes), CELL)
    part = F.pmod(F.xxhash64("id", "tree", F.lit("look")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def find(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("id", kind="stable")
        found = pivots(units(matrix(cell["v"])), float(cell["n"].iat[0]), threshold, spill)
        return pd.DataFrame({**{c: cell[c].iat[0] for c in [*CELL, "n"]}, "pivot": np.arange(len(found)), "w": pd.Series(list(found), dtype=object)}, columns=[*CELL, "n", "pivot", "w"])

    shape = "label string, d int, tree int, node long"
    found = staged(large.where(part < F.lit(2.0 * LOOK) / F.col("n")).groupBy(*CELL).applyInPandas(find, shape + ", n long, pivot int, w array<double>"), "pivots")
    if not found.limit(1).count():
        return rows, None
    chunks = F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int")

    def mark(cell: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        names = [*CELL, "id", "v", "pivot", "core"]
        if not len(cell) or not len(found):
            return cell.assign(pivot=-1, core=True)[names]
        found = found.sort_values("pivot")
        core, near = around(units(matrix(cell["v"])), matrix(found["w"]), threshold)
        out = [cell[core < 0].assign(pivot=-1, core=True)]
        out += [cell[near[:, k]].assign(pivot=p, core=core[near[:, k]] == k, v=None) for k, p in enumerate(found["pivot"])]
        return pd.concat(out)[names]

    left = large.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).drop("n").groupBy(*CELL, "chunk")
    right = found.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("n").groupBy(*CELL, "chunk")
    looked = staged(left.cogroup(right).applyInPandas(mark, shape + ", id long, v array<float>, pivot int, core boolean"), "cells-looked")
    name = F.concat_ws("|", *CELL, F.concat(F.lit("c"), F.col("pivot")))
    small = rows.join(small_side(sizes.select(CELL), n_sizes), CELL, "left_anti")
    return small.unionByName(looked.where("pivot < 0").drop("pivot", "core")), looked.where("pivot >= 0").select("id", name.alias("mark"), "core")


def split_again(cells: DataFrame, spill: float, take: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The cells (label, d, tree, node, id, v) with those of more than ``CELL_ROWS`` vectors split, level by level,
    after ``take`` has taken out of (cells, sizes of the large ones, their number) what is not to be split.

    A level projects the vectors of large cells, takes both quantiles of each cell as an aggregate and
    sends each vector to one child, or between the quantiles to both. Where the quantiles are equal,
    the vectors upon them are told apart by a hash, with the same spill.
    """
    cell = CELL

    def project(batches):
        for batch in batches:
            p = np.zeros(len(batch))
            for (tree, node), at in batch.groupby(["tree", "node"]).indices.items():
                for d, own in pd.Series(at).groupby(batch["d"].to_numpy()[at]):
                    p[own] = matrix(batch["v"].iloc[own]) @ np.random.default_rng([tree, node]).standard_normal(d)
            yield batch.assign(p=p)

    done, rows = None, staged(cells, "cells")
    while True:
        sizes = staged(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS), "cells-large")
        n_large = sizes.count()
        if not n_large:
            return rows if done is None else done.unionByName(rows)
        if take is not None:
            rows = take(rows, sizes, n_large)
        small = rows.join(small_side(sizes.select(cell), n_large), cell, "left_anti")
        done = small if done is None else done.unionByName(small)
        shape = "label string, d int, tree int, node long, id long, v array<float>"
        large = staged(rows.join(small_side(sizes.select(cell), n_large), cell, "left_semi").select(*cell, "id", "v").mapInPandas(project, shape + ", p double"), "cells-projected")
        cuts = staged(large.groupBy(*cell).agg(F.percentile_approx("p", F.array(F.lit(0.5 - spill), F.lit(0.5 + spill)), 10_000).alias("cut")), "cells-cut")
        cut = large.join(small_side(cuts, n_large), cell).withColumn("low", F.col("cut")[0]).withColumn("high", F.col("cut")[1])
        place = F.when(F.col("low") == F.col("high"), F.pmod(F.xxhash64("id", "tree", "node"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
        left = F.when(F.col("p") == F.col("low"), F.coalesce(place <= 0.5 + spill, F.lit(True))).otherwise(F.col("p") <= F.col("high"))
        right = F.when(F.col("p") == F.col("low"), F.coalesce(place >= 0.5 - spill, F.lit(True))).otherwise(F.col("p") >= F.col("low"))
        child = F.explode(F.array_compact(F.array(F.when(left, 2 * F.col("node")), F.when(right, 2 * F.col("node") + 1))))
        rows = staged(cut.select("label", "d", "tree", child.alias("node"), "id", "v"), "cells")


def near_duplicates(
    df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", trees: int = TREES, leaf: int = LEAF, spill: float = SPILL
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``df``."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"), F.col(label).cast("string").alias("label"))
    takes_part = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("v")), F.lit(False))
    usable_rows = rows.where(takes_part)
    # Equal vectors of a label (no component is a negative zero by now), under 128 bits that stand for them.
    usable_rows = usable_rows.withColumn("p", F.xxhash64("v")).withColumn("q", F.xxhash64(F.lit("second"), "v"))
    own = usable_rows.groupBy("label", "p", "q").agg(F.min(F.struct("id", "v")).alias("m"), F.count(F.lit(1)).alias("copies"))
    # Classes are numbered in the order of their ids: the smallest number of a component has its smallest id.
    classes = numbered(own.select("m.id", "label", "m.v", "p", "q", "copies", F.size("m.v").alias("d")).withColumnRenamed("id", "vec"), ["vec", "label", "p", "q"], "id")
    good = staged(classes, "classes", like=df)
    n_good = good.count()
    spill = min(spill, SPILL_SUM / max(1, math.ceil(math.log2(max(2, n_good / leaf)))))
    got = good.select("v", "d", F.xxhash64("id", F.lit("fit")).alias("h")).orderBy("h").limit(FIT_ROWS).toPandas()
    share = n_good / max(1, len(got))
    uppers = {int(d): [UpperTree(units(matrix(g["v"])), t, spill, threshold, share) for t in range(trees)] for d, g in got.groupby("d")} if len(got) else {}

    def placed(part: pd.DataFrame, d: int, dense: bool):
        """(tree, nodes, pivots, rows, core) of the cells of each tree that the vectors go to, or of the leaves around pivots."""
        x = units(matrix(part["v"]))
        for t in range(trees):
            cells = uppers[d][t].route(x) if d in uppers else [(1, -1, np.arange(len(x)), np.ones(len(x), bool))]
            if cells := [c for c in cells if (c[1] >= 0) == dense]:
                size = [len(c[2]) for c in cells]
                yield t, np.repeat([c[0] for c in cells], size), np.repeat([c[1] for c in cells], size), *(np.concatenate([c[i] for c in cells]) for i in (2, 3))

    def route(batches):
        for batch in batches:
            for d, part in batch.groupby("d"):
                ids, labels, v = part["id"].to_numpy(), part["label"].to_numpy(), part["v"].to_numpy()
                for t, node, _, at, _ in placed(part, d, False):
                    yield pd.DataFrame({"label": labels[at], "d": d, "tree": t, "node": node, "id": ids[at], "v": v[at]})

    def route_dense(batches):
        for batch in batches:
            for d, part in batch.groupby("d"):
                ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
                for t, node, pivot, at, core in placed(part, d, True):
                    yield pd.DataFrame({"label": labels[at], "d": d, "tree": t, "node": node, "pivot": pivot, "id": ids[at], "core": core})

    def count_cells(batches):
        for batch in batches:
            for d, part in batch.groupby("d"):
                labels = part["label"].to_numpy()
                for t, node, _, at, _ in placed(part, d, False):
                    n = pd.DataFrame({"label": labels[at], "node": node}).groupby(["label", "node"], as_index=False).size()
                    yield n.rename(columns={"size": "n"}).assign(d=d, tree=t)[["label", "d", "tree", "node", "n"]]

    dense = []
    if any(u.found for of_d in uppers.values() for u in of_d):
        at_pivots = good.mapInPandas(route_dense, "label string, d int, tree int, node long, pivot int, id long, core boolean")
        dense.append(at_pivots.select("id", F.concat_ws("|", *CELL, F.concat(F.lit("u"), F.col("pivot"))).alias("mark"), "core"))

    def take(cells: DataFrame, sizes: DataFrame, n_sizes: int) -> DataFrame:
        left, marks = take_dense(cells, sizes, n_sizes, threshold, spill)
        dense.extend([] if marks is None else [marks])
        return left

    cells = good.mapInPandas(route, "label string, d int, tree int, node long, id long, v array<float>")
    counted = good.mapInPandas(count_cells, "label string, d int, tree int, node long, n long").groupBy(*CELL).agg(F.sum("n").alias("n"))
    if counted.where(F.col("n") > CELL_ROWS).limit(1).count():
        cells = split_again(cells, spill, take)

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x, tree, node = units(matrix(part["v"])), int(part["tree"].iat[0]), int(part["node"].iat[0])
        leaves = grow(x, np.arange(len(x)), leaf, spill, threshold, np.random.default_rng([tree, node, 1]))
        ids = part["id"].to_numpy()
        mark = [f"{part['label'].iat[0]}|{part['d'].iat[0]}|{tree}|{node}|{path}" for path, _, _ in leaves]
        size = [len(at) for _, at, _ in leaves]
        return pd.DataFrame({"id": np.concatenate([ids[at] for _, at, _ in leaves]), "mark": np.repeat(mark, size), "core": np.concatenate([core for _, _, core in leaves])})

    marks = cells.groupBy(*CELL).applyInPandas(split, "id long, mark string, core boolean")
    for more in dense:
        marks = marks.unionByName(more)
    # A leaf is an even number; a key of its core vectors is one more.
    leaf_of = F.shiftleft(F.xxhash64("mark"), 1)
    marks = staged(marks.select("id", leaf_of.alias("leaf"), (leaf_of + F.col("core").cast("long")).alias("key")), "marks")
    leaves = marks.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("leaves"))
    spread = good.select("id", "v", "copies").join(leaves, "id").withColumn("key", F.explode("leaves")).withColumn("leaf", F.col("key").bitwiseAND(F.lit(-2).cast("long")))
    found = in_blocks(spread, marks).groupBy("leaf", "x", "y").applyInPandas(lambda part: leaf_links(part, threshold), "a long, n long, b long")
    found = staged(found, "links")
    forget(marks)
    counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    heads = good.select(F.col("id").alias("component"), F.col("vec").alias("head"))
    by_class = good.select("id", "vec", "label", "p", "q", "copies").join(counts, "id", "left").join(parts.withColumnRenamed("node", "id").join(heads, "component"), "id", "left")
    by_class = by_class.select("label", "p", "q", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "vec").alias("component_id"))
    linked = usable_rows.select("id", "label", "p", "q").join(by_class, ["label", "p", "q"]).select("id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
