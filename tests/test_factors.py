"""Factorisations and communities against dense and serial forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.operators import graph, topics
from weftlink.operators.communities import communities, modularity
from weftlink.operators.factorise import EPS, factors, first_factors


def dense(v, w, h, method, rounds, theta=0.5):
    """The updates on full matrices: terms first, then documents."""
    k, losses = w.shape[1], []
    s = (1 - theta) * np.eye(k) + theta / k if method == "nsNMF" else np.eye(k)
    for _ in range(rounds):
        if method == "lee":
            h = h * (w.T @ v) / (w.T @ w @ h + EPS)
            w = w * (v @ h.T) / (w @ (h @ h.T) + EPS)
        else:
            a = w @ s
            h = h * (a.T @ (v / (a @ h + EPS))) / (a.sum(0)[:, None] + EPS)
            b = s @ h
            w = w * ((v / (w @ b + EPS)) @ b.T) / (b.sum(1) + EPS)
            if method == "nsNMF":
                w = w / (w.sum(0) + EPS)
        m = w @ s @ h
        losses.append(((v - m) ** 2).sum() / 2 if method == "lee" else (v * np.log((v + EPS) / (m + EPS)) - v + m).sum())
    return w, h, losses


@pytest.mark.parametrize("method", ["brunet", "lee", "nsNMF"])
def test_factors_equal_those_of_dense_matrices(spark, method):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 5, (11, 9)) * (rng.random((11, 9)) < 0.5) * 1.0
    v[0, 0], v[10, 8] = 3, 2
    keep_d, keep_t = v.sum(1) > 0, v.sum(0) > 0
    rows = [(f"d{i:02}", f"t{j}", float(v[i, j]) / 2) for i, j in zip(*np.nonzero(v)) for _ in range(2)] + [("d00", "t0", None), ("d99", "t0", -1.0), ("d98", "t1", 0.0)]
    df = spark.createDataFrame(rows, "doc_id string, term_id string, weight double").repartition(5)
    w, h, figures = factors(df, 3, method=method, rounds=6, every=1, tolerance=-1)
    d = {r.d: r.f for r in w.collect()}
    t = {r.t: r.f for r in h.collect()}
    ids, words = sorted(d), sorted(t)
    assert ids == [f"d{i:02}" for i in np.flatnonzero(keep_d)] and words == [f"t{j}" for j in np.flatnonzero(keep_t)]
    start = lambda names, name: {r[0]: r[1] for r in first_factors(spark.createDataFrame([(n,) for n in names], f"{name} string"), name, 3, float(v.max()), 1, 0).collect()}
    w0, h0 = start(ids, "d"), start(words, "t")
    want_w, want_h, losses = dense(v[keep_d][:, keep_t], np.array([w0[i] for i in ids]), np.array([h0[j] for j in words]).T, method, 6)
    assert np.allclose([d[i] for i in ids], want_w, rtol=1e-9, atol=1e-12) and np.allclose([t[j] for j in words], want_h.T, rtol=1e-9, atol=1e-12)
    assert np.allclose(figures["losses"], losses, rtol=1e-9)
    assert method == "nsNMF" or (np.diff(losses) <= 1e-9).all()


def test_the_best_start_wins_and_nothing_gives_nothing(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"d{i}", f"t{j}", float(rng.integers(1, 9))) for i in range(8) for j in range(6) if (i + j) % 3], "doc_id string, term_id string, weight double")
    each = [topics.fit_nmf(df, 2, runs=n, rounds=4).metrics for n in (1, 2)]
    assert each[1]["loss"] <= each[0]["loss"]
    m = topics.fit_nmf(df, 2, rounds=4)
    assert all(abs(r.s - 1) < 1e-9 for r in m.theta.groupBy("doc_id").agg(F.sum("theta").alias("s")).collect())
    assert all(abs(r.s - 1) < 1e-9 for r in m.phi.groupBy("topic").agg(F.sum("phi").alias("s")).collect())
    nothing = topics.fit_nmf(df.limit(0), 2)
    assert nothing.theta.count() == 0 and nothing.phi.count() == 0
    with pytest.raises(ValueError):
        topics.fit_nmf(df, 2, method="other")


def louvain(nodes_a, nodes_b, weights, n, seed=1):
    """Communities of a weighted graph by local moving and contraction."""
    rng, of = np.random.default_rng(seed), np.arange(n)
    a, b, w = nodes_a, nodes_b, weights.astype(float)
    while True:
        m = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
        total = w.sum()
        if not total:
            return of
        degree = np.bincount(a, w, m) + np.bincount(b, w, m)
        near: list[dict[int, float]] = [{} for _ in range(m)]
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            if i != j:
                near[i][j] = near[i].get(j, 0) + x
                near[j][i] = near[j].get(i, 0) + x
        own, inside, moved = np.arange(m), degree.copy(), False
        for _ in range(50):
            again = False
            for i in rng.permutation(m).tolist():
                to: dict[int, float] = {}
                for j, x in near[i].items():
                    to[own[j]] = to.get(own[j], 0) + x
                inside[own[i]] -= degree[i]
                gain = lambda c: to.get(c, 0.0) - inside[c] * degree[i] / (2 * total)  # noqa: B023, E731
                best = max(sorted({*to, own[i]}), key=lambda c: (gain(c), c == own[i]))  # noqa: B023
                if gain(best) <= gain(own[i]) + 1e-12:
                    best = own[i]
                again |= best != own[i]
                own[i] = best
                inside[best] += degree[i]
            moved |= again
            if not again:
                break
        if not moved:
            return of
        _, own = np.unique(own, return_inverse=True)
        of = own[of]
        keys = np.minimum(own[a], own[b]) * (own.max() + 1) + np.maximum(own[a], own[b])
        found, at = np.unique(keys, return_inverse=True)
        w = np.bincount(at, w)
        a, b = found // (own.max() + 1), found % (own.max() + 1)


def planted(seed, blocks, size, inside, outside):
    rng = np.random.default_rng(seed)
    own = np.repeat(np.arange(blocks), size)
    i, j = np.triu_indices(len(own), 1)
    keep = rng.random(len(i)) < np.where(own[i] == own[j], inside, outside)
    return i[keep], j[keep], rng.random(keep.sum()) + 0.5


def plain_modularity(a, b, w, own):
    total, inside = w.sum(), w[own[a] == own[b]].sum()
    ends = np.bincount(own[a], w, own.max() + 1) + np.bincount(own[b], w, own.max() + 1)
    return inside / total - ((ends / (2 * total)) ** 2).sum()


@pytest.mark.parametrize(("seed", "shape"), [(1, (6, 25, 0.4, 0.02)), (2, (10, 12, 0.5, 0.06))])
def test_modularity_is_near_that_of_serial_moves(spark, seed, shape):
    a, b, w = planted(seed, *shape)
    n = int(max(a.max(), b.max())) + 1
    serial = max(plain_modularity(a, b, w, louvain(a, b, w, n, s)) for s in (1, 2, 3))
    edges = spark.createDataFrame([(f"n{x:03}", f"n{y:03}", float(z)) for x, y, z in zip(a, b, w)], "a string, b string, weight double")
    got = {r.node: r.community for r in communities(edges).collect()}
    own = np.array([got.get(f"n{i:03}", 0) for i in range(n)])
    q = plain_modularity(a, b, w, own)
    assert q >= 0.98 * serial
    assert sorted(set(got.values())) == list(range(1, max(got.values()) + 1))
    ids = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w)], "i long, j long, w double")
    assert modularity(ids, spark.createDataFrame([(i, int(own[i])) for i in range(n)], "i long, c long")) == pytest.approx(q)
    if seed == 2:
        assert {r.node: r.community for r in communities(edges.repartition(5)).collect()} == got


def test_communities_of_edges(spark):
    rows = [("x", f"t{i}", f"g{j}", "p", 1.0) for i in range(3) for j in range(3)] + [("x", f"t{i}", f"g{j}", "q", 2.0) for i in range(3, 6) for j in range(3, 6)]
    rows += [("x", "t0", "g5", "p", 0.01), ("x", "t1", "g9", "p", -4.0), ("x", "t1", None, "p", 4.0), ("x", "t2", "g1", "p", None), ("x", "t0", "g0", "p", 1.0)]
    df = spark.createDataFrame(rows, "comparison_id string, tf string, gene_key string, peak_id string, delta_link_score double")
    got = graph.assign_communities(df).collect()
    assert len(got) == 19 and {r.topic for r in got} == {1, 2}
    assert {r.topic for r in got if r.tf < "t3" and r.topic_score == 1.0} == {1} and {r.topic for r in got if r.tf >= "t3"} == {2}
    assert graph.assign_communities(df.limit(0)).count() == 0
    assert graph.assign_communities(df, min_abs=1.5).count() == 9
