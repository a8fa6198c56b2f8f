"""Networks of links: aggregation, deltas, hubs, neighbourhoods, communities, topic summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.stats import exact_quantile, robust_z
from weftlink.operators.numbering import same, small
from weftlink.sources.staging import forget, staged

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5))}


def topic_network(
    links: DataFrame, topic=None, score: str = "link_score", how: str = "sum", min_score: float | None = None, top_n: int | None = None, min_tf: int = 0, min_gene: int = 0, per_site: bool = False
) -> DataFrame:
    """(tf, gene, score, n_sites) of a topic: scores aggregated, sites counted once; the best ``top_n``
    edges; then factors and genes with too few edges go."""
    rows = links if topic is None else links.where(F.col("topic") == topic)
    net = rows.groupBy("tf", "gene").agg(AGGREGATES[how](F.col(score)).alias("score"), F.countDistinct("enhancer").alias("n_sites"))
    if per_site:
        net = net.withColumn("score", F.try_divide(F.col("score"), F.col("n_sites")))
    if min_score is not None:
        net = net.where(F.col("score") >= min_score)
    if top_n is not None:
        net = net.orderBy(F.desc("score"), "tf", "gene").limit(top_n)
    if min_tf:
        net = net.withColumn("d__", F.count(F.lit(1)).over(Window.partitionBy("tf"))).where(F.col("d__") >= min_tf).drop("d__")
    if min_gene:
        net = net.withColumn("d__", F.count(F.lit(1)).over(Window.partitionBy("gene"))).where(F.col("d__") >= min_gene).drop("d__")
    return net


def delta_network(base: DataFrame, contrast: DataFrame, min_delta: float = 0, min_score: float | None = None) -> DataFrame:
    """Both networks side by side (absent edges 0), edges with a large enough change or score."""
    a = base.select("tf", "gene", F.col("score").alias("score_base"))
    b = contrast.select("tf", "gene", F.col("score").alias("score_contrast"))
    rows = a.join(b, ["tf", "gene"], "outer").na.fill(0.0, ["score_base", "score_contrast"]).withColumn("delta", F.col("score_contrast") - F.col("score_base"))
    keep = F.abs("delta") >= min_delta
    if min_score is not None:
        keep = keep | (F.col("score_base") >= min_score) | (F.col("score_contrast") >= min_score)
    return rows.where(keep)


def hub_scores(edges: DataFrame, by: str = "topic", rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """(by, tf, hub): HITS hub scores of the distinct edges of each group, scaled to 1; out-degrees where
    they are all zero.

    Power iteration over all groups at once: a round is two joins of the edges with scores and their sums, staged, until
    no score moves by more than the tolerance. A factor's or gene's edges meet only in sums, so a group of any size is
    many tasks.
    """
    e = edges.select(F.col(by).alias("g"), "tf", F.col("gene_key").alias("gene")).where("tf is not null and gene is not null")
    e = staged(e.distinct(), "edges")
    now = staged(e.groupBy("g", "tf").agg(F.count(F.lit(1)).cast("double").alias("degree")).withColumn("h", F.lit(1.0)), "hubs")
    n_groups = now.select("g").distinct().count()
    for _ in range(rounds if n_groups else 0):
        authority = e.alias("e").join(now.alias("h"), same("e", "h", ["g", "tf"])).groupBy("e.g", "e.gene").agg(F.sum("h.h").alias("a"))
        sums = e.alias("e").join(authority.alias("a"), same("e", "a", ["g", "gene"])).groupBy("e.g", "e.tf").agg(F.sum("a.a").alias("s"))
        new = staged(sums.alias("s").join(now.alias("h"), same("s", "h", ["g", "tf"])).select("s.g", "s.tf", "s.s", "h.degree", F.col("h.h").alias("old")), "hub-sums")
        norm = new.groupBy("g").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
        scaled = new.alias("n").join(small(norm, n_groups).alias("m"), same("n", "m", ["g"]))
        after = staged(scaled.select("n.g", "n.tf", "n.degree", F.coalesce(F.try_divide(F.col("n.s"), F.col("m.norm")), F.lit(0.0)).alias("h"), "n.old"), "hubs")
        gap = after.agg(F.max(F.abs(F.col("h") - F.col("old")))).first()[0]
        forget(now, new)
        now = after
        if gap < tolerance:
            break
    top = now.groupBy("g").agg(F.max("h").alias("most"), F.max("degree").alias("most_edges"))
    share = F.when(F.col("t.most") > 0, F.col("n.h") / F.col("t.most")).otherwise(F.col("n.degree") / F.col("t.most_edges"))
    return now.alias("n").join(small(top, n_groups).alias("t"), same("n", "t", ["g"])).select(F.col("n.g").alias(by), "n.tf", share.alias("hub"))


def explode_topics(df: DataFrame, topics: str = "topics", sep: str = ";") -> DataFrame:
    """One row a topic of a packed list."""
    return df.withColumn("topic", F.explode(F.split(topics, sep))).withColumn("topic", F.trim("topic")).where("topic <> ''").drop(topics)


def sign_faults(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of which two sign columns disagree: must be empty."""
    return df.where(F.coalesce(F.signum(a) != F.signum(b), F.lit(False)))


def topic_summary(edges: DataFrame, min_delta: float = 0.25, weight_by_r: bool = False, hubs: bool = True) -> DataFrame:
    """(topic, tf, ...) sums, counts, hub score (if asked) and ranks of annotated links (topics packed).

    Links are summed by topic, factor and gene once and staged: all else, hub scores too, is made from those sums.
    """
    d = F.col("delta_link_score") * (F.abs("r_tf") if weight_by_r else F.lit(1.0))
    rows = explode_topics(edges.where(F.abs("delta_link_score") >= min_delta)).withColumn("d__", d)
    sums = [F.count(F.lit(1)).alias("n_links"), F.sum("d__").alias("sum_delta"), F.sum(F.abs("d__")).alias("sum_abs_delta"), F.max("log2FC_tf_expr").alias("log2fc_tf")]
    edges = staged(rows.groupBy("topic", "tf", "gene_key").agg(*sums), "topic-edges")
    agg = edges.groupBy("topic", "tf").agg(
        F.sum("n_links").alias("n_links"),
        F.count("gene_key").alias("n_genes"),
        F.coalesce(F.sum("sum_delta"), F.lit(0.0)).alias("sum_delta"),
        F.coalesce(F.sum("sum_abs_delta"), F.lit(0.0)).alias("sum_abs_delta"),
        F.max("log2fc_tf").alias("log2fc_tf"),
    )
    per = edges.groupBy("topic").agg(F.coalesce(F.sum("sum_abs_delta"), F.lit(0.0)).alias("topic_abs_delta"), F.sum("n_links").alias("topic_links"))
    topic_rank = F.row_number().over(Window.orderBy(F.desc("topic_abs_delta"), "topic"))
    tf_rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("sum_abs_delta"), "tf"))
    out = agg.join(per.withColumn("topic_rank", topic_rank), "topic").withColumn("tf_rank", tf_rank)
    return out.join(hub_scores(edges, "topic"), ["topic", "tf"], "left") if hubs else out


def expression_bubbles(summary: DataFrame, top_n: int = 20) -> DataFrame:
    """The top factors of each topic with sign x log2(|sum| + 1) and a clamped robust z of their change."""
    w = Window.partitionBy("topic").orderBy(F.desc("sum_abs_delta"), "tf")
    rows = summary.withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= top_n).drop("nth__")
    rows = rows.withColumn("signed_log", F.signum("sum_delta") * F.log2(F.abs("sum_delta") + 1))
    return robust_z(rows, "log2fc_tf", "color_z", clamp=3.0)


def hub_overview(summary: DataFrame, top_links: int = 150, top_sum: int = 150) -> DataFrame:
    """Per factor over all topics, with marks for those that labels go to."""
    agg = summary.groupBy("tf").agg(F.sum("n_links").alias("n_links"), F.sum("sum_abs_delta").alias("sum_abs"), F.sum("sum_delta").alias("sum_signed"), F.percentile("log2fc_tf", F.lit(0.5)).alias("log2fc_tf"))
    r1, r2 = (F.row_number().over(Window.orderBy(F.desc(c), "tf")) for c in ("n_links", "sum_abs"))
    rows = agg.withColumn("labelled", (r1 <= top_links) | (r2 <= top_sum))
    return rows.withColumn("x_abs", F.log2(F.col("sum_abs") + 1)).withColumn("x_signed", F.signum("sum_signed") * F.log2(F.abs("sum_signed") + 1))


def site_gene_sums(edges: DataFrame) -> DataFrame:
    """Signed sums of passing edges by site and gene."""
    s = F.when(F.col("link_sign") == "-", -1.0).otherwise(1.0) * F.col("delta_link_score")
    return edges.groupBy("peak_id", "gene_key").agg(F.coalesce(F.sum(F.when(F.col("pass"), s)), F.lit(0.0)).alias("weight"), F.count(F.when(F.col("pass"), 1)).alias("n_pass"))


def caps(df: DataFrame, value: str, q: float = 0.995) -> DataFrame:
    """The quantile of positive and of negative magnitudes, 1 where there are none."""
    x = F.col(value)
    sizes = df.select(F.when(x > 0, x).cast("double").alias("cap_pos"), F.when(x < 0, -x).cast("double").alias("cap_neg"))
    one = lambda name: exact_quantile(sizes, name, q, name).select(F.coalesce(name, F.lit(1.0)).alias(name))
    return one("cap_pos").crossJoin(F.broadcast(one("cap_neg")))


def shared_sites(edges: DataFrame, least: int = 2) -> DataFrame:
    """Sites that several factors link through: the ones drawn as nodes."""
    return edges.groupBy("peak_id").agg(F.countDistinct("tf").alias("n_tfs"), F.countDistinct("gene_key").alias("n_genes")).where(F.col("n_tfs") >= least)


def uncovered_direct(direct: DataFrame, through_sites: DataFrame) -> DataFrame:
    """Direct edges that no drawn site explains."""
    return direct.join(through_sites.select("tf", "gene_key").distinct(), ["tf", "gene_key"], "left_anti")


def strongest_edges(edges: DataFrame, per_tf: int, min_abs: float = 0, one_a_pair: bool = True, ties: bool = False) -> DataFrame:
    """The best edges of each factor by |delta|; first the best site of each (tf, gene) if asked."""
    d = F.abs("delta_link_score")
    rows = edges.where(d >= min_abs)
    if one_a_pair:
        w = Window.partitionBy("tf", "gene_key").orderBy(d.desc(), "peak_id")
        rows = rows.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")
    w = Window.partitionBy("tf").orderBy(d.desc(), *([] if ties else ["gene_key", "peak_id"]))
    return rows.withColumn("n__", (F.rank() if ties else F.row_number()).over(w)).where(F.col("n__") <= per_tf).drop("n__")


def root_neighbourhood(edges: DataFrame, root: str) -> DataFrame:
    """(node, role): the root's targets that are factors, factors that target it, co-parents of its target
    genes, and its genes: common with those factors or its own alone."""
    e = edges.select("tf", "gene_key").distinct()
    tfs = e.select(F.col("tf").alias("node")).distinct()
    mine = e.where(F.col("tf") == root).select(F.col("gene_key").alias("node")).distinct()
    child = mine.join(tfs, "node", "left_semi").withColumn("role", F.lit("child_tf"))
    parent = e.where((F.col("gene_key") == root) & (F.col("tf") != root)).select(F.col("tf").alias("node")).distinct().withColumn("role", F.lit("parent_tf"))
    genes = mine.join(tfs, "node", "left_anti")
    near = child.select("node").union(parent.select("node")).distinct()
    theirs = e.join(near, e["tf"] == near["node"], "left_semi").select(F.col("gene_key").alias("node")).distinct()
    common = genes.join(theirs, "node", "left_semi").withColumn("role", F.lit("common_gene"))
    only = genes.join(theirs, "node", "left_anti").withColumn("role", F.lit("root_gene"))
    co = e.join(genes, e["gene_key"] == genes["node"], "left_semi").where(F.col("tf") != root).select(F.col("tf").alias("node")).distinct()
    co = co.join(near, "node", "left_anti").withColumn("role", F.lit("co_parent_tf"))
    return child.unionByName(parent).unionByName(common).unionByName(only).unionByName(co)


def node_medians(edges: DataFrame) -> DataFrame:
    """(node, kind, value): medians of expression changes of factors and genes."""
    t = edges.groupBy(F.col("tf").alias("node")).agg(F.percentile("log2FC_tf_expr", F.lit(0.5)).alias("value")).withColumn("kind", F.lit("tf"))
    g = edges.groupBy(F.col("gene_key").alias("node")).agg(F.percentile("log2FC_gene_expr", F.lit(0.5)).alias("value")).withColumn("kind", F.lit("gene"))
    return t.unionByName(g)


#: Comparisons that linkage takes to the driver, at most.
MAX_COMPARISONS = 5000

def assign_communities(edges: DataFrame, weight: str = "delta_link_score", min_abs: float | None = None, seed: int = 1) -> DataFrame:
    """(comparison_id, tf, gene_key, peak_id, topic_score, topic), as far as ``edges`` has these columns: each distinct edge of
    positive weight with the community of its gene. Factors and genes of one name are one node; weights are summed
    over sites and comparisons first."""
    from weftlink.operators.communities import communities

    w = F.col(weight).cast("double")
    rows = edges.where(F.col("tf").isNotNull() & F.col("gene_key").isNotNull() & (w > 0) & ~F.isnan(w) & (w < float("inf")))
    if min_abs is not None:
        rows = rows.where(w >= min_abs)
    held = [c for c in ("comparison_id", "tf", "gene_key", "peak_id") if c in edges.columns]
    rows = staged(rows.select(*held, w.alias("topic_score")).distinct(), "weighted-edges")
    found = communities(rows.select(F.col("tf").cast("string").alias("a"), F.col("gene_key").cast("string").alias("b"), "topic_score"), weight="topic_score", seed=seed)
    return rows.join(found, F.col("gene_key").cast("string") == F.col("node")).select(*held, "topic_score", F.col("community").alias("topic"))


#: Rows of nodes and edges that one JSON text holds, at most.
MAX_DRAWN = 100_000


def network_json(nodes: DataFrame, edges: DataFrame) -> str:
    """{"nodes": [...], "edges": [...]}, each row an object without its nulls; refused beyond ``MAX_DRAWN`` rows."""
    parts = {}
    for name, df in (("nodes", nodes), ("edges", edges)):
        got = [r[0] for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).orderBy("j").limit(MAX_DRAWN + 1).collect()]
        if len(got) > MAX_DRAWN:
            raise ValueError(f"a drawn network holds {MAX_DRAWN} {name} at most")
        parts[name] = got
    return "{" + ", ".join(f'"{name}": [{", ".join(rows)}]' for name, rows in parts.items()) + "}"


def topic_filter(topics: str, topic: str, sep: str = ";"):
    """Whether a packed list holds a topic as a whole item."""
    return F.array_contains(F.transform(F.split(topics, sep), lambda x: F.trim(x)), topic)


def factor_delta_table(edges: DataFrame, factors: Sequence, min_abs: float = 1) -> DataFrame:
    """Sum of |delta| by comparison, one column a factor, absent ones 0."""
    rows = edges.where(F.abs("delta_link_score") >= min_abs)
    return rows.groupBy("comparison_id").pivot("tf", list(factors)).agg(F.sum(F.abs("delta_link_score"))).na.fill(0.0)


def cluster_comparisons(edges: DataFrame, factors: Sequence, k: int, min_abs: float = 1) -> list[tuple[str, int]]:
    """(comparison, cluster) by Ward linkage of their factor sums; beyond ``MAX_COMPARISONS`` it is refused."""
    from weftlink.operators.motif import cut, linkage

    got = factor_delta_table(edges, factors, min_abs).orderBy("comparison_id").limit(MAX_COMPARISONS + 1).toPandas()
    if len(got) > MAX_COMPARISONS:
        raise ValueError(f"linkage takes {MAX_COMPARISONS} comparisons at most")
    x = got.drop(columns="comparison_id").to_numpy(float)
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
    return list(zip(got["comparison_id"], cut(linkage(d, "ward"), len(got), min(k, len(got))).tolist(), strict=True))


def topic_delta_network(deltas: DataFrame, summary: DataFrame, topic: str, top_tfs: int = 20, min_delta: float = 2, gene_fold: float = 1.5, topics: str = "topics") -> DataFrame:
    """Edges of a topic (packed list) of its top factors by |delta|, with pass flags for change and gene fold."""
    w = Window.partitionBy("topic").orderBy(F.desc("sum_abs_delta"), "tf")
    best = summary.where(F.col("topic") == topic).withColumn("i__", F.row_number().over(w)).where(F.col("i__") <= top_tfs).select("tf")
    rows = deltas.where(topic_filter(topics, topic)).join(best, "tf", "left_semi")
    changed = F.coalesce(F.abs("log2FC_gene_expr") >= float(np.log2(gene_fold)), F.lit(False))
    return rows.withColumn("pass", F.coalesce(F.abs("delta_link_score") >= min_delta, F.lit(False))).withColumn("gene_changed", changed)
