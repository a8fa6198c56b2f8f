"""The engine's three modules end to end, as compositions of operators.

Tables that several later steps read are staged in the shared folder: each is computed once, plans stay small
and a lost executor costs no more than the step it was in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.operators import compare, correlate, graph, links, matrix, topics
from weftlink.operators.matrix import OmicsSet
from weftlink.sources.staging import staged


@dataclass(frozen=True)
class Cutoffs:
    """Thresholds of a study."""

    fp_score: float = 2
    gene_expr: float = 10
    tf_expr: float = 10
    min_samples: int = 1
    min_bound: int = 1
    r_min: float = 0.3
    q_max: float = 0.05
    link_q_max: float = 0.01


def prepare(study: OmicsSet, cut: Cutoffs = Cutoffs(), condition: str = "condition") -> OmicsSet:
    """Shared samples, peaks bound often enough, normalised scores, and tables by condition:
    ``fp_condition``, ``rna_condition``, ``fp_bound_condition``, ``rna_expressed``."""
    s = study.restricted()
    kept = matrix.often_bound(s.fp_bound, cut.min_bound)
    s = s.with_tables(fp_score=matrix.keep_keys(s.fp_score, kept), fp_bound=matrix.keep_keys(s.fp_bound, kept), fp_annotation=matrix.keep_keys(s.fp_annotation, kept))
    normal = staged(matrix.quantile_normalise(s.fp_score), "normal")
    tables = {
        "fp_normal": normal,
        "fp_condition": matrix.by_condition(normal, s.samples, ["peak"], condition=condition),
        "rna_condition": matrix.by_condition(s.rna, s.samples, ["gene"], condition=condition),
        "rna_expressed": matrix.expressed_flags(s.rna, s.samples, cut.gene_expr, cut.min_samples, condition),
    }
    if s.atac_overlap is not None:
        tables["fp_bound_condition"] = matrix.bound_by_condition(s.fp_bound, s.fp_score, s.atac_overlap, s.fp_annotation, s.samples, cut.fp_score, cut.min_samples, condition)
    if s.motif_db is not None:
        tables["fp_annotation"] = matrix.attach_tfs(s.fp_annotation, s.motif_db)
    return s.with_tables(**{name: t if name == "fp_normal" else staged(t, name) for name, t in tables.items()})


def factors_of_sites(study: OmicsSet, cut: Cutoffs = Cutoffs(), mode: str = "canonical", family: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Factor statistics by both methods, all of them and those that pass."""
    out = {}
    for m in ("pearson", "spearman"):
        found = staged(correlate.correlate_tfs_to_footprints(study.fp_annotation, study.derived["fp_normal"], study.rna, m, mode, study.tf_list, family=family), f"tfs-{m}")
        out[m], out[f"{m}_kept"] = found, correlate.passing(found, cut.r_min, cut.q_max)
    return out


def link_study(study: OmicsSet, candidates: DataFrame, tf_stats: DataFrame, cut: Cutoffs = Cutoffs(), condition: str = "condition") -> dict[str, DataFrame]:
    """Links of candidate (region, gene) pairs: tested by both methods, filtered, supported by their factor,
    and lit in every condition."""
    rows = study.fp_annotation.withColumn("tf", F.explode(F.split("tfs", ","))).join(candidates, "region").select("peak", "gene", "tf", "motif").distinct()
    rows = staged(rows, "candidates")
    p, s = (staged(correlate.correlate_footprints_to_genes(rows, study.derived["fp_normal"], study.rna, m), f"genes-{m}") for m in ("pearson", "spearman"))
    both = correlate.add_tf_gene_correlation(links.combine_methods(p, s), study.rna)
    kept = staged(links.supported_by_tf(links.links_by_criteria(both, cut.link_q_max, cut.r_min), tf_stats, cut.r_min, cut.q_max), "links")
    named = kept.select("tf", "gene", "peak", *[F.col(f"{c}_pearson").alias(c) for c in ("n", "r", "p", "p_adj")])
    basal = links.basal_links(named, tf_stats, matrix.variance_table(study.derived["fp_normal"], "peak"), matrix.variance_table(study.rna, "gene"))
    basal = staged(basal, "basal")
    d = study.derived
    lit = links.light_by_condition(basal, study.samples.select(F.col(condition).alias("condition")), d["fp_condition"], d["fp_bound_condition"], d["rna_condition"], d["rna_expressed"], tf_min=cut.tf_expr)
    lit = staged(lit, "lit")
    return {"links": kept, "basal": basal, "by_condition": lit, "status": links.link_status(basal, d["fp_bound_condition"], d["rna_expressed"])}


def differential(by_condition: DataFrame, specs: DataFrame, gene_log2fc: float = 0.5, fp_delta: float = 0.5, **options) -> dict[str, DataFrame]:
    """Deltas of all comparisons, filtered and directed, with hubs."""
    deltas = staged(compare.compare_many(compare.standard_links(by_condition), specs, **options), "deltas")
    directed = compare.with_direction(compare.filter_deltas(deltas, gene_log2fc=gene_log2fc), gene_log2fc, fp_delta)
    return {"deltas": deltas, "directed": directed, "hubs": compare.tf_hub_summary(directed)}


def topics_of_deltas(deltas: DataFrame, ks: Sequence[int], clusters: DataFrame | None = None, fit=topics.fit_lda, **options) -> tuple[DataFrame, dict[int, topics.TopicModel]]:
    """Documents of filtered deltas and a model for each k."""
    edges = topics.tf_documents(compare.filter_for_topics(deltas), clusters=clusters)
    edges = staged(edges, "edges")
    terms = staged(topics.joint_terms(edges, "delta_fp_score", "delta_gene_expr"), "terms")
    return edges, {k: fit(terms, k, **options) for k in ks}


def model_grid(terms: DataFrame, settings: dict[str, dict], fit=topics.fit_lda) -> tuple[dict[str, topics.TopicModel], list[tuple[str, dict, str]]]:
    """A model for each named setting, and (name, setting, error) of those that could not be fitted: one that fails
    does not cost the others."""
    models, failures = {}, []
    for name, options in settings.items():
        try:
            models[name] = fit(terms, **options)
        except Exception as error:  # noqa: BLE001  whatever a model fails with belongs to the summary
            failures.append((name, options, str(error).split("\n")[0]))
    return models, failures


def regulatory_topics(edges: DataFrame, model: topics.TopicModel, method: str = "link_score_prob", binarize: str = "gammafit") -> dict[str, DataFrame]:
    """Membership of terms, links that pass, gene sets, and the network summary of a model."""
    scores = topics.normalised_scores(model.phi).select("topic", "term_id", "score")
    member = topics.binarize(scores, binarize)
    member = staged(member, "members")
    found = staged(topics.topic_links(edges, scores, member, method), "topic-links")
    passing = topics.passing_links(found, "gene_prob" if method == "gene_prob" else "link_prob")
    return {"members": member, "links": found, "passing": passing, "gene_sets": topics.link_gene_sets(passing), "hubs": graph.hub_scores(passing)}
