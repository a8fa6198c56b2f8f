"""The sampled topic model against a collapsed Gibbs sampler, and its parts against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.operators import topics, warp


def test_uniform_numbers_and_draws():
    key = warp.token_keys(np.array([5, -3], np.int64), np.array([3, 4]))
    assert len(set(key.tolist())) == 7
    u = warp.uniform(np.arange(20_000, dtype=np.uint64), 3)
    assert ((u >= 0) & (u < 1)).all() and abs(u.mean() - 0.5) < 0.01 and not np.allclose(u[:50], warp.uniform(np.arange(50, dtype=np.uint64), 4))
    counts = np.array([[0.0, 5.0, 1.0], [2.0, 0.0, 0.0]])
    row = np.repeat([0, 1], 10_000)
    got = warp.draw(counts, row, 0.5, u)
    for r in (0, 1):
        share = np.bincount(got[row == r], minlength=3) / 10_000
        assert np.allclose(share, (counts[r] + 0.5) / (counts[r] + 0.5).sum(), atol=0.02)


def corpus(rng, k=3, docs=40, words=24, tokens=60):
    phi = rng.dirichlet(np.full(words, 0.1), k)
    out = np.zeros((docs, words), int)
    for d in range(docs):
        out[d] = rng.multinomial(tokens, rng.dirichlet(np.full(k, 0.2)) @ phi)
    return out


def gibbs(x, k, alpha, beta, sweeps, rng):
    d, t = np.repeat(np.argwhere(x > 0), x[x > 0], axis=0).T
    z = rng.integers(0, k, len(d))
    cd, ct, c = np.zeros((x.shape[0], k)), np.zeros((x.shape[1], k)), np.bincount(z, minlength=k).astype(float)
    np.add.at(cd, (d, z), 1)
    np.add.at(ct, (t, z), 1)
    for _ in range(sweeps):
        for i in range(len(d)):
            for a in (cd[d[i]], ct[t[i]], c):
                a[z[i]] -= 1
            p = np.cumsum((cd[d[i]] + alpha) * (ct[t[i]] + beta) / (c + x.shape[1] * beta))
            z[i] = np.searchsorted(p, rng.random() * p[-1])
            for a in (cd[d[i]], ct[t[i]], c):
                a[z[i]] += 1
    theta = (cd + alpha) / (cd.sum(1, keepdims=True) + k * alpha)
    phi = ((ct + beta) / (c + x.shape[1] * beta)).T
    return float(np.exp(-(x * np.log(theta @ phi)).sum() / x.sum()))


def test_perplexity_is_that_of_a_gibbs_sampler(spark):
    rng = np.random.default_rng(3)
    x = corpus(rng)
    x = x[:, x.sum(0) > 0]
    rows = [(f"d{d}", f"GENE:{t}", int(x[d, t])) for d, t in np.argwhere(x > 0)] + [("d0", "none", 0), ("d1", "none", None)]
    df = spark.createDataFrame(rows, "doc_id string, term_id string, pseudo_count int")
    m = topics.fit_sampled_lda(df, 3, sweeps=30, alpha=0.5, beta=0.1)
    want = gibbs(x, 3, 0.5, 0.1, 60, rng)
    assert m.metrics["perplexity"] == pytest.approx(want, rel=0.05) and m.metrics["n_tokens"] == x.sum()
    assert all(abs(r.s - 1) < 1e-9 for r in m.theta.groupBy("doc_id").agg(F.sum("theta").alias("s")).collect())
    assert all(abs(r.s - 1) < 1e-9 for r in m.phi.groupBy("topic").agg(F.sum("phi").alias("s")).collect())


def test_one_seed_gives_one_result(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{d}", f"t{t}", int(rng.integers(1, 4))) for d in range(10) for t in range(8) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "doc_id string, term_id string, pseudo_count int")
    run = lambda table, seed: sorted(map(tuple, topics.fit_sampled_lda(table, 2, sweeps=3, seed=seed).theta.collect()))
    one = run(df, 1)
    assert run(df.repartition(6, "term_id"), 1) == one != run(df, 2)
    assert topics.fit_sampled_lda(df.limit(0), 2).theta.count() == 0


def test_cells_of_many_tokens_are_pieces_of_many_files(spark, monkeypatch):
    rows = [(f"d{d}", f"t{t}", 30 + (d * t) % 50) for d in range(4) for t in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, term_id string, pseudo_count int")
    run = lambda: sorted(map(tuple, topics.fit_sampled_lda(df, 2, sweeps=2).theta.collect()))
    whole, real, files = run(), warp.staged, []

    def seen(table, label, **options):
        out = real(table, label, **options)
        if label == "tokens":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(warp, "staged", seen)
    monkeypatch.setattr(warp, "PIECE", 7, raising=False)
    monkeypatch.setattr(warp, "FILE_TOKENS", 50, raising=False)
    # The same topics, from several files in the first and in every later phase.
    assert run() == whole and len(files) == 5 and min(files) >= 6
