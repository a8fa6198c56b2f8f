"""Gene-set enrichment with local tables: over-representation, running sums, non-redundant sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.stats import benjamini_hochberg
from weftlink.operators.running import running_sum
from weftlink.operators.topics import marker_overlap

__all__ = ["non_redundant", "over_representation", "pathway_links", "running_sum"]


def over_representation(gene_sets: DataFrame, pathways: DataFrame, universe: int, min_genes: int = 5, q_max: float | None = 0.05) -> DataFrame:
    """(topic, set, overlap, coverage, odds_ratio, p, p_adj): hypergeometric test of every pathway (set,
    gene) against every topic's genes; adjusted within the topic."""
    large = gene_sets.groupBy("topic").agg(F.countDistinct("gene").alias("n")).where(F.col("n") >= min_genes)
    rows = marker_overlap(gene_sets.join(large.select("topic"), "topic", "left_semi"), pathways, universe).where("overlap > 0")
    out = benjamini_hochberg(rows, "p", "p_adj", ("topic",))
    return out.where(F.col("p_adj") < q_max) if q_max is not None else out


def non_redundant(hits: list[tuple[str, float, set]], threshold: float = 0.8) -> list[str]:
    """Pathways (name, p, genes) without those that a larger one holds, or shares the threshold of the
    smaller set with; larger first, then smaller p, then name."""
    kept: list[tuple[str, set]] = []
    for name, _, genes in sorted(hits, key=lambda h: (-len(h[2]), h[1], h[0])):
        if all(len(genes & other) < threshold * min(len(genes), len(other)) for _, other in kept):
            kept.append((name, genes))
    return [n for n, _ in kept]


def pathway_links(links: DataFrame, pathways: DataFrame) -> DataFrame:
    """Links whose gene is in a pathway: the sub-network of each set."""
    return links.join(pathways.select("set", F.col("gene").alias("gene_key")).distinct(), "gene_key")
