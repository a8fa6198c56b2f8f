import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.operators import compare, correlate, graph, intervals, matrix, motif, topics
from weftlink.operators.components import agreeing


def test_overlap_conventions(spark):
    a = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("d", 0, 5)], "chrom string, start int, end int")
    b = spark.createDataFrame([("c", 10, 30)], "chrom string, start int, end int")
    assert intervals.overlap_join(a, b, bin_size=7).count() == 1
    assert intervals.overlap_join(a, b, closed=True, bin_size=7).count() == 2
    assert intervals.overlap_join(a, b, how="left", bin_size=7).count() == 3


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 2, 3), ("c", 21, 30)], "chrom string, start int, end int")
    got = sorted((r.start, r.end, r.group_size) for r in intervals.merged(df, ["chrom"], "start", "end").collect())
    assert got == [(0, 20, 3), (21, 30, 1)]


def test_alike_sites_chain_and_null_equals_null(spark):
    df = spark.createDataFrame([("r", "A", [1.0, 2.0, None]), ("r", "B", [1.0, 9.0, None]), ("r", "C", [7.0, 9.0, None])], "region string, peak string, v array<double>")
    got = {r.peak: r.cluster for r in agreeing(df, "region", "peak", "v", 0.6).collect()}
    assert set(got.values()) == {"A"}


def test_correlation_of_odd_rows(spark):
    x = [("a", s, float(s)) for s in range(6)] + [("k", s, 3.0) for s in range(6)] + [("n", 0, 1.0), ("n", 1, float("nan"))]
    y = [("y", s, float(s * s)) for s in range(6)]
    X = spark.createDataFrame(x, "peak string, sample int, value double")
    Y = spark.createDataFrame(y, "gene string, sample int, value double")
    pairs = spark.createDataFrame([("a", "y"), ("k", "y"), ("n", "y")], "peak string, gene string")
    got = {r.peak: r for r in correlate.correlate(pairs, X, Y, "peak", "gene").collect()}
    assert got["a"].r == pytest.approx(np.corrcoef(range(6), [s * s for s in range(6)])[0, 1]) and got["a"].n == 6
    assert got["k"].r is None and got["n"].r is None and got["n"].n == 1
    assert {r.peak: r for r in correlate.correlate(pairs, X, Y, "peak", "gene", "spearman").collect()}["a"].r == pytest.approx(1)
    k = {r.peak: r for r in correlate.correlate(pairs, X, Y, "peak", "gene", "kendall").collect()}["a"]
    assert k.r == pytest.approx(1) and k.p == pytest.approx(0.00485, abs=1e-4)


def test_known_pairs_are_not_computed_again(spark):
    X = spark.createDataFrame([("a", s, float(s)) for s in range(4)], "peak string, sample int, value double")
    Y = spark.createDataFrame([("y", s, float(s)) for s in range(4)], "gene string, sample int, value double")
    known = spark.createDataFrame([("b", "y", 9, 0.5, 0.1)], "peak string, gene string, n int, r double, p double")
    pairs = spark.createDataFrame([("a", "y"), ("b", "y")], "peak string, gene string")
    got = {r.peak: r.n for r in correlate.correlate_known(known, pairs, X, Y, "peak", "gene").collect()}
    assert got == {"a": 4, "b": 9}


def test_packed_statistics(spark):
    df = spark.createDataFrame([("p", "A,B", "0.5,0.7", "0.01"), ("q", "A", "0.1", "0.9")], "peak string, tfs string, r string, p string")
    got = {(r.peak, r.tf): r.p for r in correlate.unpack_statistics(df, "peak", "tfs", "r", "p").collect()}
    assert got == {("p", "A"): 0.01, ("p", "B"): 0.01, ("q", "A"): 0.9}
    bad = spark.createDataFrame([("p", "A", "0.5", "1.5")], "peak string, tfs string, r string, p string")
    with pytest.raises(Exception, match="outside 0 and 1"):
        correlate.unpack_statistics(bad, "peak", "tfs", "r", "p").collect()


def test_quantile_normalisation_averages_ties(spark):
    rows = [("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 4.0), ("a", 2, 2.0), ("b", 2, 4.0), ("c", 2, None)]
    got = {(r.peak, r.sample): r.value for r in matrix.quantile_normalise(spark.createDataFrame(rows, "peak string, sample int, value double")).collect()}
    assert got[("a", 1)] == got[("b", 1)] == pytest.approx((1.5 + 2.5) / 2) and got[("c", 1)] == 4.0 and got[("c", 2)] is None
    assert got[("a", 2)] == 1.5 and got[("b", 2)] == 2.5


def _links(spark, rows):
    return compare.standard_links(spark.createDataFrame(rows, "TF string, gene_key string, peak_ID string, link_weight double, fp_score double, tf_expr double, gene_expr double, active_link int"))


def test_comparison_is_antisymmetric_and_signs_have_policies(spark):
    a = _links(spark, [("t", "g", "p", 3.0, 1.0, 2.0, 8.0, 1), ("t", "h", "p", -1.0, 1.0, 2.0, 8.0, 0)])
    b = _links(spark, [("t", "g", "p", 1.0, 4.0, 2.0, 1.0, 0), ("t", "h", "p", 2.0, 1.0, 2.0, 8.0, 0)])
    d = lambda x, y: {r.gene_key: r for r in compare.compare(x, y, signs="prefer_case").collect()}
    one, two = d(a, b), d(b, a)
    assert all(one[k].delta_fp_score == -two[k].delta_fp_score for k in one)
    assert one["g"].edge_change == "gain" and two["g"].edge_change == "loss" and one["h"].edge_change == "inactive"
    assert one["h"].link_sign == "-" and two["h"].link_sign == "+"
    assert {r.gene_key for r in compare.compare(a, b, signs="drop").collect()} == {"g"}
    assert {r.gene_key: r.link_sign for r in compare.compare(a, b, signs="prefer_max_magnitude").collect()}["h"] == "+"
    with pytest.raises(Exception, match="signs differ"):
        compare.compare(a, b).collect()


def test_key_faults_name_repeats_and_gaps(spark):
    mk = lambda ks: spark.createDataFrame([("t", k, "p") for k in ks], "tf string, gene_key string, peak_id string")
    got = {r.gene_key: r.fault for r in compare.key_faults(mk(["a", "a", "b", "d"]), mk(["a", "c", "d"])).collect()}
    assert got == {"a": "repeated", "b": "only in first", "c": "only in second"}


def test_opposed_factor_drops_a_link(spark):
    rows = [("t", "g", "p", "+", 2.0, -2.0), ("t", "h", "p", "+", 2.0, 2.0), ("t", "i", "p", "+", 0.1, 0.0)]
    df = spark.createDataFrame(rows, "tf string, gene_key string, peak_id string, link_sign string, log2FC_gene_expr double, log2FC_tf_expr double")
    assert [r.gene_key for r in compare.filter_deltas(df, gene_log2fc=1, tf_log2fc=1).collect()] == ["h"]
    assert compare.filter_deltas(df).count() == 3


def test_counts_of_weights(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.001), ("c", 10.0)], "term_id string, weight double")
    got = {r.term_id: (r.count_bin, r.count_log) for r in topics.weight_counts(df, scale=50).collect()}
    assert got["a"] == (0, 0) and got["b"] == (1, 1) and got["c"][0] == 50


def test_links_without_scores_spread_evenly(spark):
    e = spark.createDataFrame([("d", "t", "g", "p")], "doc_id string, tf string, gene_key string, peak_id string")
    theta = spark.createDataFrame([("d", k, 0.25) for k in (1, 2, 3, 4)], "doc_id string, topic int, theta double")
    phi = spark.createDataFrame([(1, "GENE:zz", 1.0)], "topic int, term_id string, phi double")
    assert [r.prob for r in topics.link_topic_scores(e, theta, phi, top_k=9).collect()] == [0.25] * 4


def test_permutation_p_stays_within_bounds(spark):
    rows = [(1, f"g{i}", float(i % 5), float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "topic int, gene_key string, peak_score double, gene_score double")
    a, b = (sorted((r.gene_key, r.p_perm) for r in topics.empirical_fdr(df, rounds=10).collect()) for _ in range(2))
    assert a == b and all(1 / 401 <= p <= 1 for _, p in a)


def test_topics_merge_while_they_grow(spark):
    rows = [(1, g) for g in "abcd"] + [(2, g) for g in "bcde"] + [(3, g) for g in "e"] + [(4, "z")]
    assert topics.merge_overlapping(spark.createDataFrame(rows, "topic int, gene string"), 0.7) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_factorisations_are_distributions(spark):
    rows = [(f"d{i}", f"GENE:g{(i * j) % 7}", float(1 + (i + j) % 4)) for i in range(12) for j in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, term_id string, weight double").groupBy("doc_id", "term_id").agg(F.sum("weight").alias("weight")).withColumn("pseudo_count", F.col("weight").cast("int"))
    for m in (topics.fit_nmf(df, 3, runs=1, rounds=30), topics.fit_neural(df, 3, epochs=3, hidden=8, variant="embedded"), topics.fit_lda(df, 3, rounds=3)):
        assert all(abs(r.s - 1) < 1e-6 for r in m.theta.groupBy("doc_id").agg(F.sum("theta").alias("s")).collect())
        assert all(abs(r.s - 1) < 1e-6 for r in m.phi.groupBy("topic").agg(F.sum("phi").alias("s")).collect())


def test_alignment_finds_the_reverse_strand():
    rng = np.random.default_rng(1)
    m = motif.probabilities(rng.random((4, 8)))
    got = motif.best_alignment(m, motif.reverse_complement(m))
    assert got["cor"] == pytest.approx(1) and got["strand"] == "-" and got["overlap"] == 8 and got["ncor"] == pytest.approx(1)
    assert (motif.probabilities(np.zeros((4, 1))) == 0.25).all()


def test_linkage_and_silhouette():
    x = np.array([0, 1, 10, 11, 30])
    d = np.abs(x[:, None] - x[None, :]).astype(float)
    for how in ("average", "complete", "single", "ward"):
        own = motif.cut(motif.linkage(d.copy(), how), 5, 3)
        assert own.tolist() == [1, 1, 2, 2, 3]
    assert motif.best_k(d, motif.linkage(d.copy()))[0] in (2, 3)


def test_hubs_scale_to_one(spark):
    e = spark.createDataFrame([("1", "A", g) for g in "abc"] + [("1", "B", "a")], "topic string, tf string, gene_key string")
    got = {r.tf: r.hub for r in graph.hub_scores(e).collect()}
    assert got["A"] == pytest.approx(1) and 0 < got["B"] < 1


def test_bound_rules(spark):
    b = spark.createDataFrame([("p", 1, 1), ("p", 2, None), ("q", 1, 1), ("q", 2, 1)], "peak string, sample int, value int")
    assert {r.peak for r in matrix.often_bound(b, 1).collect()} == {"p", "q"}
    assert {r.peak for r in matrix.often_bound(b, 1, na_as_unbound=False).collect()} == {"q"}
    assert matrix.often_bound(b.limit(0)).count() == 0


def test_mixed_model_finds_the_slope(spark):
    rng = np.random.default_rng(0)
    rows = [("t", "g", "p", s, 2.0 * (s % 5) + (s // 5) + rng.normal(0, 0.1)) for s in range(20)]
    info = spark.createDataFrame([(s, float(s % 5), str(s // 5)) for s in range(20)], "sample int, x double, grp string")
    got = compare.multi_lmm(spark.createDataFrame(rows, "tf string, gene_key string, peak_id string, sample int, value double"), info, ["x"], "grp").collect()
    assert got[0].beta == pytest.approx(2, abs=0.1)


def test_ranks_of_small_and_large_comparisons_agree(spark, monkeypatch):
    from weftlink.operators import compare

    rows = [("t", f"g{i}", "p", c, float((i * 7) % 5) if i % 6 else None, 1.0, 1.0, 1.0, 1, "+") for i in range(40) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "tf string, gene_key string, peak_id string, condition string, link_score double, fp_score double, tf_expr double, gene_expr double, active int, link_sign string")
    specs = spark.createDataFrame([("b_vs_a", "b", "a"), ("a_vs_b", "a", "b")], "comparison_id string, case string, control string")
    run = lambda: sorted(compare.compare_many(df, specs).select("comparison_id", "gene_key", "rank_case", "rank_ctrl", "rank_shift").collect(), key=str)
    small = run()
    monkeypatch.setattr(compare, "RANK_ROWS", 3)
    assert run() == small and len(small) == 80 and any(r.rank_case is None for r in small)
