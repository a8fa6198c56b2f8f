"""Every query of the plan against its SQL twin on the smallest tables, and the workflows end to end."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.plans import queries

FOLDER = "/root/testdata/sf0.001"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.5f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted([norm(r[i]) for i in order] for r in data)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def same(x: str, y: str) -> bool:
    """Equal, or numbers whose last digit was rounded another way."""
    if x == y:
        return True
    try:
        return math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-5)
    except ValueError:
        return False


def study(spark):
    """Forty samples of four conditions; the gene of a factor drives its sites, and these their target."""
    from weftlink.operators.matrix import OmicsSet

    rng = np.random.default_rng(6)
    samples = [(f"s{i:02}", f"c{i % 4}") for i in range(40)]
    names = [s for s, _ in samples]
    tf = {t: 20 + 8 * rng.random(40) + 6 * (np.arange(40) % 4 == k) for k, t in enumerate(("TFA", "TFB", "TFC"))}
    rna = {**tf, **{f"G{k}": 15 + tf[("TFA", "TFB", "TFC")[k % 3]] + rng.normal(0, 0.5, 40) for k in range(6)}}
    sites = {f"chr1:{100 * k}-{100 * k + 20}": tf[("TFA", "TFB", "TFC")[k % 3]] / 4 + rng.normal(0, 0.1, 40) for k in range(12)}
    long = lambda t, key: spark.createDataFrame([(k, s, float(v)) for k, x in t.items() for s, v in zip(names, x, strict=True)], f"{key} string, sample string, value double")
    fp = long(sites, "peak")
    bound = fp.select("peak", "sample", F.lit(1).alias("value"))
    annotation = spark.createDataFrame([(p, f"chr1:{200 * (k // 2)}-{200 * (k // 2) + 150}", f"M{k % 3}") for k, p in enumerate(sites)], "peak string, region string, motif string")
    overlap = annotation.select("region").distinct().crossJoin(fp.select("sample").distinct()).withColumn("value", F.lit(1))
    motifs = spark.createDataFrame([("M0", "TFA"), ("M1", "TFB"), ("M2", "TFC")], "motif string, gene_symbol string")
    return OmicsSet(samples=spark.createDataFrame(samples, "sample string, condition string"), fp_score=fp, fp_bound=bound, fp_annotation=annotation, rna=long(rna, "gene"), atac_overlap=overlap, motif_db=motifs)


def test_workflows_end_to_end(spark):
    from weftlink.plans import workflows as w

    cut = w.Cutoffs()
    s = w.prepare(study(spark), cut)
    found = w.factors_of_sites(s, cut)
    kept = {(r.peak, r.tf) for r in found["pearson_kept"].collect()}
    assert len(kept) >= 10 and {t for _, t in kept} == {"TFA", "TFB", "TFC"}
    pairs = spark.createDataFrame([(f"chr1:{200 * k}-{200 * k + 150}", f"G{g}") for k in range(6) for g in range(6)], "region string, gene string")
    linked = w.link_study(s, pairs, found["pearson_kept"], cut)
    links = linked["links"].select("tf", "gene", "peak").distinct().collect()
    assert links and all((r.peak, r.tf) in kept for r in links)
    by_condition = linked["by_condition"]
    assert by_condition.select("condition").distinct().count() == 4 and by_condition.count() == 4 * linked["basal"].count()
    specs = spark.createDataFrame([("c1_vs_c0", "c1", "c0"), ("c2_vs_c0", "c2", "c0")], "comparison_id string, case string, control string")
    out = w.differential(by_condition, specs, 0.05, 0.05)
    assert out["deltas"].count() == 2 * linked["basal"].count() and out["deltas"].where("rank_case is null").count() == 0
    assert set(out["hubs"].columns) and out["directed"].count() >= 0


def test_entry_holds_without_the_optional_package(spark):
    import __spark_entry__ as e
    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).schema.names
