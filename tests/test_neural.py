"""The neural topic model: gradients by differences, and training on executors as in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.operators import neural, topics


@pytest.mark.parametrize("variant", neural.VARIANTS)
def test_gradients_are_those_of_the_loss(variant):
    rng = np.random.default_rng(1)
    x, noise = rng.integers(0, 5, (6, 9)).astype(float), rng.normal(size=(6, 3))
    m = neural.Model(9, 3, variant, hidden=8, embedding=4, seed=2, gene=np.arange(9) < 5)
    for a in ("wm", "ws"):
        m.p[a] = rng.normal(0, 0.3, m.p[a].shape)
    g, _ = m.gradient(x, noise)
    at = 0
    for name, a in m.p.items():
        for i in rng.choice(a.size, min(6, a.size), replace=False):
            where, h = np.unravel_index(i, a.shape), 1e-6
            if name == "w1" and not m.mask[where]:
                assert g[at + i] == 0
                continue
            a[where] += h
            up = m.gradient(x, noise)[1]
            a[where] -= 2 * h
            down = m.gradient(x, noise)[1]
            a[where] += h
            assert g[at + i] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-5)
        at += a.size


def test_noise_is_normal_and_follows_the_key():
    key = np.arange(-5000, 5000, dtype=np.int64)
    z = neural.noise_of(key, 3, 2)
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs(np.corrcoef(z.T)[0, 1]) < 0.03
    assert (neural.noise_of(key[7:9], 3, 2) == z[7:9]).all() and not np.allclose(neural.noise_of(key, 4, 2), z)


def test_training_on_executors_is_training_in_memory(spark, monkeypatch):
    monkeypatch.setattr(neural, "BLOCK", 100)
    rng = np.random.default_rng(4)
    phi = rng.dirichlet(np.full(20, 0.2), 3)
    x = np.stack([rng.multinomial(50, rng.dirichlet(np.full(3, 0.3)) @ phi) for _ in range(30)])
    names = [f"{'GENE' if t < 12 else 'PEAK'}:{t:02}" for t in range(20)]
    rows = [(f"d{d:02}", names[t], int(x[d, t])) for d, t in np.argwhere(x > 0)] + [("d00", "GENE:zz", 0), ("d01", "GENE:zz", None)]
    df = spark.createDataFrame(rows, "doc_id string, term_id string, pseudo_count int").repartition(5)
    got = topics.fit_neural(df, 3, epochs=4, batch=10, hidden=8, rate=0.01, seed=3)
    keep = x.sum(0) > 0
    x, names = x[:, keep].astype(float), [n for n, k in zip(names, keep) if k]
    model = neural.Model(len(names), 3, "split", 8, 32, 3, np.array([n.startswith("GENE:") for n in names]))
    keys = spark.createDataFrame([(i, f"d{i:02}") for i in range(30)], "at int, doc_id string").withColumn("h", F.xxhash64(F.lit(3), F.col("doc_id")))
    turn = {(r.at, e): r[f"e{e}"] for r in keys.select("at", *[F.pmod(F.xxhash64("h", F.lit(e)), F.lit(3)).alias(f"e{e}") for e in range(4)]).collect() for e in range(4)}
    h = np.array([r.h for r in keys.orderBy("at").collect()], np.int64)

    def sums(m, epoch, batch):
        own = [i for i in range(30) if turn[i, epoch] == batch]
        return (*m.gradient(x[own], neural.noise_of(h[own], epoch, 3)), len(own))

    losses = neural.train(model, sums, 4, 3, 0.01)
    assert got.metrics["losses"] == pytest.approx(losses, rel=1e-6) and losses[-1] < losses[0]
    found = {(r.topic, r.term_id): r.phi for r in got.phi.collect()}
    assert all(found[k + 1, n] == pytest.approx(model.phi()[k, j], rel=1e-5) for k in range(3) for j, n in enumerate(names)) and len(found) == 3 * len(names)
    theta = {(r.doc_id, r.topic): r.theta for r in got.theta.collect()}
    assert all(theta[f"d{i:02}", k + 1] == pytest.approx(neural.softmax(model.mean(x))[i, k], rel=1e-5) for i in range(30) for k in range(3))


def test_large_models_are_refused_and_nothing_gives_nothing(spark, monkeypatch):
    df = spark.createDataFrame([("d", "GENE:a", 1), ("d", "GENE:b", 2)], "doc_id string, term_id string, pseudo_count int")
    assert topics.fit_neural(df.limit(0), 2, epochs=2, hidden=4).theta.count() == 0
    monkeypatch.setattr(neural, "MAX_PARAMETERS", 5)
    with pytest.raises(ValueError):
        topics.fit_neural(df, 2, hidden=4)
