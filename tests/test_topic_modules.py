"""Topic modules end to end: from differential links to documents, models, links of topics, gene sets and hubs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.operators import topics
from weftlink.plans import workflows


@pytest.fixture(scope="module")
def deltas(spark):
    """Two groups of factors: one changes with sites and genes of its own in each comparison."""
    rng = np.random.default_rng(8)
    rows = []
    for c in ("c1_vs_c0", "c2_vs_c0", "c3_vs_c0"):
        for t in range(4):
            for g in range(8):
                for p in range(2):
                    if t % 2 == g % 2:
                        sign = 1 if rng.random() < 0.8 else -1
                        fp, gene = sign * (1.5 + 2 * rng.random()), sign * (1.2 + rng.random())
                        rows.append((c, f"TF{t}", f"G{g}", f"chr1:{100 * g + 10 * p}-{100 * g + 10 * p + 8}", fp, fp, gene, gene * 3, 1, 5.0, 4.0, 1.0, 1.0, 0.5, float(fp * gene)))
    cols = "comparison_id string, tf string, gene_key string, peak_id string, delta_fp_score double, log2FC_fp_score double, log2FC_gene_expr double, delta_gene_expr double, active_any int, fp_score_case double, fp_score_ctrl double, active_case double, active_ctrl double, log2FC_tf_expr double, delta_link_score double"
    return spark.createDataFrame(rows, cols)


@pytest.mark.parametrize("fit", [topics.fit_sampled_lda])
def test_topics_of_differential_links(spark, deltas, fit):
    options = {"sweeps": 2, "alpha": 0.5}
    edges, models = workflows.topics_of_deltas(deltas, [2], fit=fit, **options)
    docs = {r.doc_id for r in edges.select("doc_id").distinct().collect()}
    assert docs and all(len(d.split("::")) == 3 for d in docs)
    m = models[2]
    theta = m.theta.toPandas().pivot(index="doc_id", columns="topic", values="theta")
    assert set(theta.index) <= docs and len(theta) > 8 and np.allclose(theta.sum(1), 1, atol=1e-6)
    found = workflows.regulatory_topics(edges, m)
    links = found["links"]
    per_link = links.groupBy("doc_id", "tf", "gene_key", "peak_id").agg(F.sum("link_prob").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per_link) == edges.select("doc_id", "tf", "gene_key", "peak_id").distinct().count()
    assert all(r.n == 2 and r.p == pytest.approx(1) for r in per_link)
    on = {(r.topic, r.term_id) for r in found["members"].where("in_topic").collect()}
    passing = found["passing"].collect()
    assert passing and all((r.topic, f"PEAK:{r.peak_id}") in on and (r.topic, f"GENE:{r.gene_key}") in on and r.prob >= 0.3 for r in passing)
    genes = {(r.topic, r.gene) for r in found["gene_sets"].collect()}
    assert {(r.topic, r.gene_key) for r in passing} <= genes and {(r.topic, r.tf) for r in passing} <= genes
    hubs = found["hubs"].collect()
    assert {(r.topic, r.tf) for r in hubs} == {(r.topic, r.tf) for r in passing} and max(r.hub for r in hubs) == pytest.approx(1)


def test_a_model_that_fails_does_not_cost_the_others(spark):
    terms = spark.createDataFrame([(f"d{i}", f"t{j}", 1 + (i + j) % 3) for i in range(6) for j in range(4)], "doc_id string, term_id string, pseudo_count int")
    models, failures = workflows.model_grid(terms, {"good": {"k": 2, "sweeps": 1}, "bad": {"k": 2, "sweeps": 1, "count": "absent"}}, fit=topics.fit_sampled_lda)
    assert list(models) == ["good"] and [f[0] for f in failures] == ["bad"] and models["good"].theta.count() == 12
