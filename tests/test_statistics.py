import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.functions import scalars, stats


def test_adjusted_p_of_a_known_family(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.2])] + [(9, None)], "i int, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", "q").collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.2] and got[9] is None


def test_adjusted_p_against_numpy_with_ties_and_families(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), float(p)) for f in (0, 1) for p in np.round(rng.random(300) ** 3, 3)]
    got = stats.benjamini_hochberg(spark.createDataFrame(rows, "f int, p double"), "p", "q", ["f"]).toPandas()
    for f in (0, 1):
        p = np.sort([x for g, x in rows if g == f])
        q = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
        assert np.allclose(np.sort(got.loc[got.f == f, "q"]), np.sort(q))


@pytest.mark.parametrize("df,t", [(1, 12.706204736), (2, 4.3026527297), (3, 3.1824463053), (7, 2.3646242510), (10, 2.2281388520), (30, 2.0422724563), (31, 2.0395134464)])
def test_critical_t_gives_five_percent(spark, df, t):
    r = t / math.sqrt(df + t * t)
    p = spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(df + 2)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-8)
    assert stats.t_two_sided(t, df) == pytest.approx(0.05, abs=1e-8)


def test_p_of_extremes(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 5), (0.5, 2), (0.0, 9)], "r double, n int")
    got = [x.p for x in df.select(stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got == [0.0, None, None, 1.0]


def test_average_ranks_keep_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (5.0,)], "x double")
    got = sorted((r.x, r.k) for r in df.withColumn("k", stats.average_rank("x")).collect() if r.x is not None)
    assert got == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 4.0)]


def test_fisher_gamma_and_digamma():
    assert stats.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert stats.gamma_quantile(0.5, 1.0, 1.0) == pytest.approx(math.log(2), rel=1e-9)
    assert stats.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-8)
    assert stats.trigamma(stats.trigamma_inverse(0.3)) == pytest.approx(0.3, rel=1e-6)
    assert stats.f_upper(4.0, 2, 10) == pytest.approx(0.0530, abs=1e-3)


def test_robust_z_without_spread_is_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(9.0,)], "x double")
    assert {r.z for r in stats.robust_z(df, "x", "z").collect()} == {0.0}


def test_numbers_regions_and_labels(spark):
    df = spark.createDataFrame([("chr1:10-20", float("nan"), "b, a::a"), ("odd", float("inf"), ""), (None, 2.0, None)], "r string, x double, l string")
    got = df.select(scalars.parse_region("r").alias("p"), scalars.finite("x").alias("x"), scalars.split_list("l").alias("l")).collect()
    assert (got[0].p.chrom, got[0].p.start, got[0].p.end, got[0].x, got[0].l) == ("chr1", 10, 20, None, ["a", "b"])
    assert got[1].p.start is None and got[1].x is None and got[1].l == [] and got[2].x == 2.0
    d = spark.createDataFrame([("a_vs_b::T::x::Up",), ("one",)], "d string").select(scalars.doc_parts("d").alias("p")).collect()
    assert (d[0].p.comparison, d[0].p.entity, d[0].p.direction) == ("a_vs_b", "T::x", "Up") and d[1].p.direction is None
    assert scalars.snake("geneKey.TF") == "gene_key_tf" and scalars.safe_name("a b/c") == "a_b_c"


def test_spread_ranks_and_adjusted_p_equal_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    x = [float(v) for v in np.round(rng.normal(0, 3, 300), 1)] + [0.0, 0.0, None, None, 1e300, -1e-300, 7.0, 7.0]
    rows = [(i, "ab"[i % 2] if i % 7 else None, v, abs(v) % 1 if v is not None else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(900 + i, "a", 1.0, 0.0) for i in range(50)], "i int, g string, x double, p double")
    for down in (False, True):
        got = stats.with_average_rank(df, "x", "k", ["g"], down)
        assert got.count() == df.count() and got.join(df.withColumn("want", stats.average_rank("x", ["g"], down)).select("i", "want"), "i").where("not (k <=> want)").count() == 0
    for family in ((), ("g",)):
        got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", "q", family).collect()}
        assert len(got) == df.count()
        for g in {r[1] if family else 0 for r in rows}:
            part = [(r.p, r.i) for r in df.collect() if r.p is not None and (not family or r.g == g)]
            least = 1.0
            for n, (p, i) in reversed(list(enumerate(sorted(part), 1))):
                least = min(least, p * len(part) / n)
                same = [q for v, q in part if v == p]
                assert got[max(same, key=lambda k: got[k])] == pytest.approx(min(least, 1.0)) or p in [v for v, _ in sorted(part)[n:]]


def test_too_large_work_is_refused(spark, monkeypatch):
    from weftlink.operators import enrich, graph, running

    monkeypatch.setattr(running, "MAX_RANKED", 8)
    sets = spark.createDataFrame([(f"s{k}", f"g{i}") for k in range(3) for i in range(5)], "set string, gene string")
    ranks = spark.createDataFrame([("t", f"g{i}", float(i)) for i in range(9)], "topic string, gene string, score double")
    with pytest.raises(ValueError):
        enrich.running_sum(ranks, sets, 3, rounds=5)
    assert enrich.running_sum(ranks.where("score > 0"), sets, 3, rounds=5).count() == 3
    monkeypatch.setattr(graph, "MAX_COMPARISONS", 2)
    edges = spark.createDataFrame([(f"c{i}", "f", float(i + 1)) for i in range(3)], "comparison_id string, tf string, delta_link_score double")
    with pytest.raises(ValueError):
        graph.cluster_comparisons(edges, ["f"], 2)


def test_exact_quantiles_equal_the_engine_s(spark):
    rng = np.random.default_rng(8)
    rows = [("ab"[i % 2] if i % 5 else None, float(v)) for i, v in enumerate(np.round(rng.normal(0, 2, 201), 1))] + [("a", None), ("z", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {r.g: r.v for r in df.groupBy("g").agg(F.percentile("x", F.lit(q)).alias("v")).collect() if r.v is not None}
        got = {r.g: r.v for r in stats.exact_quantile(df, "x", q, "v", ["g"]).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
        assert stats.exact_quantile(df, "x", q, "v").first().v == pytest.approx(df.agg(F.percentile("x", F.lit(q))).first()[0])
    assert stats.exact_quantile(df.limit(0), "x", 0.5, "v").collect()[0].v is None


def test_robust_z_by_group(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), ("b", 5.0), (None, 1.0), (None, None), ("n", None)]
    got = sorted(((r.g or "", r.x if r.x is not None else -1, r.z) for r in stats.robust_z(spark.createDataFrame(rows, "g string, x double"), "x", "z", ["g"]).collect()), key=str)
    assert len(got) == len(rows) and [z for g, x, z in got if g == "b"] == [0.0, 0.0] and all(z is None for _, x, z in got if x == -1)
    assert {x: z for g, x, z in got if g == "a"} == pytest.approx({x: (x - 3) / 1.4826 for x in (1, 2, 3, 4, 100)})


def test_models_that_fail_are_listed(spark):
    from weftlink.plans import workflows

    def fit(terms, k):
        if k > 2:
            raise ValueError("too many topics\nmore")
        return k

    assert workflows.model_grid(None, {"a": {"k": 2}, "b": {"k": 9}}, fit) == ({"a": 2}, [("b", {"k": 9}, "too many topics")])
