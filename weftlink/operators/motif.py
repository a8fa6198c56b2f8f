"""Motifs: position matrices, alignment, similarity, clustering, co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGT"


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Columns that sum to 1; an empty column is uniform."""
    total = counts.sum(0)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), 0.25)


def reverse_complement(m: np.ndarray) -> np.ndarray:
    return m[::-1, ::-1]


def _column_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of all columns of a (4 x w) with all of b, 0 where a column is constant."""
    x, y = a - a.mean(0), b - b.mean(0)
    sx, sy = np.sqrt((x**2).sum(0)), np.sqrt((y**2).sum(0))
    d = sx[:, None] * sy[None, :]
    return np.where(d > 1e-15, x.T @ y / np.where(d > 1e-15, d, 1), 0.0)


def best_alignment(a: np.ndarray, b: np.ndarray, min_overlap: int = 1) -> dict:
    """The offset and strand of b with the largest mean column correlation; ties by the correlation over
    the longer motif's width, then by overlap, then forward first."""
    best = None
    for strand, m in (("+", b), ("-", reverse_complement(b))):
        c = _column_correlations(a, m)
        wa, wb = c.shape
        for off in range(-wb + min_overlap, wa - min_overlap + 1):
            d = np.diagonal(c, -off)
            if len(d) < min_overlap:
                continue
            cor = float(d.mean())
            row = (round(cor, 12), round(cor * len(d) / max(wa, wb), 12), len(d))
            if best is None or row > best[0]:
                best = row, strand, off
    (cor, ncor, width), strand, off = best
    return {"cor": cor, "ncor": ncor, "overlap": width, "strand": strand, "offset": off}


def pairwise_alignments(motifs: DataFrame, min_overlap: int = 1, blocks: int = 16) -> DataFrame:
    """(a, b, cor, ncor, overlap, strand, offset) of all motifs a < b: ``motifs`` is (id, w, m) with m the
    rows A, C, G, T one after another. Motifs meet block by block."""
    rows = motifs.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("o")
    dealt = rows.select("id", "w", "m", "k", each).withColumn("x", F.least("k", "o")).withColumn("y", F.greatest("k", "o"))

    def align(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x, y = int(part["x"].iat[0]), int(part["y"].iat[0])
        ms = [probabilities(np.asarray(m, float).reshape(4, w)) for m, w in zip(part["m"], part["w"], strict=True)]
        ids, ks = part["id"].tolist(), part["k"].tolist()
        out = []
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                if {ks[i], ks[j]} == {x, y} and (x != y or ks[i] == ks[j]):
                    out.append({"a": ids[i], "b": ids[j]} | best_alignment(ms[i], ms[j], min_overlap))
        return pd.DataFrame(out, columns=["a", "b", "cor", "ncor", "overlap", "strand", "offset"])

    return dealt.groupBy("x", "y").applyInPandas(align, "a string, b string, cor double, ncor double, overlap int, strand string, offset int")


def similarity_table(pairs: DataFrame, ids: DataFrame, value: str = "ncor") -> DataFrame:
    """(a, b, similarity) in both orders, with 1 on the diagonal."""
    up = pairs.select("a", "b", F.col(value).alias("similarity"))
    return up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(ids.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def motif_peak_stats(annotation: DataFrame, site_map: DataFrame | None = None, min_support: int = 100) -> tuple[DataFrame, DataFrame]:
    """(motif, support) and (a, b, shared): weighted counts of peaks of motifs, and of peaks they share;
    a merged peak weighs its group size. Motifs below the support are left out."""
    rows = annotation.select("peak", "motif").where("peak is not null and motif is not null").distinct()
    if site_map is not None:
        rows = rows.join(site_map.groupBy(F.col("merged_id").alias("peak")).agg(F.max("group_size").alias("w")), "peak", "left").na.fill(1, ["w"])
    else:
        rows = rows.withColumn("w", F.lit(1))
    support = rows.groupBy("motif").agg(F.sum("w").alias("support")).where(F.col("support") >= min_support)
    rows = rows.join(support.select("motif"), "motif", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    shared = a.join(b, (F.col("a.peak") == F.col("b.peak")) & (F.col("a.motif") < F.col("b.motif"))).groupBy(F.col("a.motif").alias("a"), F.col("b.motif").alias("b")).agg(F.sum("a.w").alias("shared"))
    return support, shared


def motif_similarity(support: DataFrame, shared: DataFrame, method: str = "jaccard") -> DataFrame:
    """(a, b, similarity) of motifs by shared peaks: weighted Jaccard or cosine."""
    s = support
    rows = shared.join(s.select(F.col("motif").alias("a"), F.col("support").alias("ca")), "a").join(s.select(F.col("motif").alias("b"), F.col("support").alias("cb")), "b")
    w = F.col("shared").cast("double")
    v = F.try_divide(w, F.col("ca") + F.col("cb") - w) if method == "jaccard" else F.try_divide(w, F.sqrt(F.col("ca").cast("double") * F.col("cb")))
    return rows.select("a", "b", v.alias("similarity"))


def hybrid_similarity(reference: DataFrame, data: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha x reference + (1 - alpha) x data over pairs that both have; alpha within 0..1."""
    alpha = min(1.0, max(0.0, alpha))
    r = reference.select("a", "b", F.col("similarity").alias("r"))
    return r.join(data.select("a", "b", F.col("similarity").alias("d")), ["a", "b"]).select("a", "b", (alpha * F.col("r") + (1 - alpha) * F.col("d")).alias("similarity"))


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of hierarchical clustering of a distance table: average, complete,
    single or ward; ties to the smaller pair."""
    n = len(d)
    d = d.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), [1] * n, []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf))), n)
        i, j = min(i, j), max(i, j)
        h = float(d[i, j])
        a, b, rest = size[i], size[j], np.array(size, float)
        if method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        elif method == "ward":
            new = ((a + rest) * d[i] + (b + rest) * d[j] - rest * h) / (a + b + rest)
        else:
            new = np.maximum(d[i], d[j]) if method == "complete" else np.minimum(d[i], d[j])
        out.append((*sorted((name[i], name[j])), float(np.sqrt(h)) if method == "ward" else h, a + b))
        new[i] = np.inf
        d[i], d[:, i] = new, new
        alive[j], size[i], name[i] = False, a + b, n + step
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Cluster numbers from 1, in order of first member, after all but k - 1 merges."""
    top = list(range(2 * n - 1))

    def head(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for step, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        top[head(a)] = top[head(b)] = n + step
    of = [head(i) for i in range(n)]
    order = {v: i + 1 for i, v in enumerate(dict.fromkeys(of))}
    return np.array([order[v] for v in of])


def silhouette(d: np.ndarray, own: np.ndarray) -> float:
    """Mean silhouette; members of singletons count 0."""
    names, at = np.unique(own, return_inverse=True)
    if len(names) < 2:
        return 0.0
    hot = np.eye(len(names))[at]
    n, sums = hot.sum(0), d @ hot
    mine = n[at]
    a = np.where(mine > 1, sums[np.arange(len(d)), at] / np.maximum(mine - 1, 1), 0)
    other = np.where(hot > 0, np.inf, sums / n)
    b = other.min(1)
    return float(np.where(mine > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def best_k(d: np.ndarray, merges, grid: Sequence[int] | None = None) -> tuple[int, list[tuple[int, float]]]:
    """k with the smallest sum of ranks of silhouette and of bend (second derivative), and the curve."""
    n = len(d)
    grid = [k for k in (grid or range(20 if n > 40 else 2, min(600, n - 1) + 1, 5 if n > 40 else 1)) if 2 <= k < n] or [1]
    curve = [(k, silhouette(d, cut(merges, n, k))) for k in grid]
    s = np.array([v for _, v in curve])
    bend = np.full(len(s), np.nan)
    for i in range(1, len(s) - 1):
        l, r = grid[i] - grid[i - 1], grid[i + 1] - grid[i]
        bend[i] = 2 * ((s[i + 1] - s[i]) / r - (s[i] - s[i - 1]) / l) / (l + r)
    rank = lambda v: np.array([1 + (v[~np.isnan(v)] < x).sum() if x == x else (~np.isnan(v)).sum() + 1 for x in v])
    total = rank(-s) + rank(bend)
    return grid[int(np.argmin(total))], curve


#: Items that hierarchical clustering takes to the driver, at most.
MAX_ITEMS = 5000


def cluster_similarity(table: DataFrame, k: int | None = None, method: str = "average") -> tuple[list[tuple[str, int]], int]:
    """(item, cluster) from (a, b, similarity); absent pairs are 0. The number of items is checked."""
    if table.select(F.explode(F.array("a", "b"))).distinct().limit(MAX_ITEMS + 1).count() > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    got = table.select("a", "b", "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity")).toPandas()
    ids = sorted({*got["a"], *got["b"]})
    at = {v: i for i, v in enumerate(ids)}
    d = np.ones((len(ids), len(ids)))
    i, j = got["a"].map(at).to_numpy(int), got["b"].map(at).to_numpy(int)
    d[i, j] = d[j, i] = 1 - got["similarity"].to_numpy(float)
    np.fill_diagonal(d, 0)
    merges = linkage(d.copy(), method)
    k = min(k, len(ids)) if k else best_k(d, merges)[0]
    return list(zip(ids, cut(merges, len(ids), k).tolist(), strict=True)), k


def cluster_name(tfs: Sequence[str], max_parts: int = 4, max_chars: int = 45) -> str:
    """Representative factor names joined, within limits."""
    names = list(dict.fromkeys(sorted(tfs)))
    out = "_".join(names[:max_parts])
    return (out[: max_chars - 1] + "~") if len(out) > max_chars else out


def cluster_peak_summary(annotation: DataFrame, clusters: DataFrame, top_n: int = 5) -> DataFrame:
    """(cluster, n_peaks, n_motifs, motifs_per_peak, top): peaks of each motif cluster and its top motifs."""
    rows = annotation.select("peak", "motif").distinct().join(clusters, "motif")
    per = rows.groupBy("cluster", "peak").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_peaks"), F.avg("m").alias("motifs_per_peak"), F.count(F.when(F.col("m") > 1, 1)).alias("n_shared"))
    by = rows.groupBy("cluster", "motif").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "motif")
    top = by.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top_n)
    top = top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "motif"))), lambda x: x["motif"]), ",").alias("top"))
    return per.join(by.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_motifs")), "cluster").join(top, "cluster")


def cluster_matrices(motifs: DataFrame, k: int = 233, min_overlap: int = 1) -> list[tuple[str, int]]:
    """(motif, cluster) of position matrices: all alignments, 1 - score, average linkage, cut at k."""
    return cluster_similarity(similarity_table(pairwise_alignments(motifs, min_overlap), motifs.select("id")), k)[0]


def cluster_by_sites(annotation: DataFrame, reference: DataFrame | None = None, mode: str = "data", alpha: float = 0.5, k: int | None = None, min_support: int = 100, method: str = "jaccard") -> tuple[list[tuple[str, int]], int]:
    """(motif, cluster) by shared sites (``data``), or mixed with a reference similarity (``hybrid``)."""
    data = motif_similarity(*motif_peak_stats(annotation, min_support=min_support), method)
    return cluster_similarity(hybrid_similarity(reference, data, alpha) if mode == "hybrid" and reference is not None else data, k)


def apply_clusters(motif_db: DataFrame, clusters: DataFrame) -> DataFrame:
    """The motif table with cluster number and name; motifs without one keep null."""
    names = clusters.join(motif_db.select("motif", "gene_symbol"), "motif").groupBy("cluster").agg(F.array_sort(F.collect_set("gene_symbol")).alias("g"))
    names = names.select("cluster", F.array_join(F.slice("g", 1, 4), "_").alias("cluster_name"))
    return motif_db.drop("cluster").join(clusters.join(names, "cluster"), "motif", "left")
