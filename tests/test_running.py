"""Running sums against plain loops, and small chances against all sets there are."""

import itertools

import numpy as np
import pytest

from weftlink.operators import enrich, running


def plain_score(at, w, n):
    hit, top, low, held = 0.0, 0.0, 0.0, set(at)
    total = sum(w[i] for i in at)
    best = [0.0]
    miss = 0
    for i in range(n):
        if i in held:
            hit += w[i] / total
        else:
            miss += 1
        best.append(hit - miss / (n - len(at)))
    top, low = max(best), min(best)
    return top if top > -low else low


def test_scores():
    rng = np.random.default_rng(1)
    w = np.sort(rng.random(30))[::-1]
    at = running.random_sets(rng, 200, 6, 30)
    assert all(len(set(r)) == 6 for r in at) and np.allclose(np.bincount(at.ravel(), minlength=30) / 200, 0.2, atol=0.12)
    assert np.allclose(running.scores(at, w, 30), [plain_score(r.tolist(), w, 30) for r in at])
    assert running.scores(np.arange(30)[None], w, 30).tolist() == [0.0] and running.scores(at[:1], w * 0, 30).tolist() == [0.0]


def test_small_chances_equal_those_of_all_sets():
    n, m = 26, 4
    w = np.sort(np.random.default_rng(2).random(n))[::-1]
    every = running.scores(np.array(list(itertools.combinations(range(n), m))), w, n)
    targets = np.sort(every[every > 0])[[-1, -4, -30, -300, -3000]]
    got = np.median([running.tail_by_levels(np.random.default_rng(s), w, m, targets) for s in range(7)], axis=0)
    want = np.array([(every >= t).mean() for t in targets])
    assert want[0] < 1e-4 and (np.abs(np.log(got / want)) < np.log(2)).all()
    p, nes = running.chances(np.random.default_rng(3), w, m, np.array([targets[0], every.min(), 0.0]), 200)
    assert p[0] == pytest.approx((every >= targets[0]).sum() / (every >= 0).sum(), rel=1.5) and p[0] < 1 / 200
    assert p[1] == pytest.approx((every <= every.min()).sum() / (every < 0).sum(), rel=1.5) and p[2] == 1.0
    assert nes[0] == pytest.approx(targets[0] / every[every >= 0].mean(), rel=0.1)


def test_running_sums_of_topics(spark):
    rng = np.random.default_rng(5)
    ranks = [(t, f"g{i:03}", float(s)) for t in (1, 2) for i, s in enumerate(rng.normal(0, 1, 120))] + [(1, "g000", -9.0), (1, "g001", None), (3, "g001", 1.0)]
    top = [g for _, g in sorted(((-s, g) for t, g, s in ranks[:120]))[:8]]
    sets = [("top", g) for g in top] + [(f"s{k}", f"g{i:03}") for k in range(5) for i in rng.choice(120, 8, replace=False)] + [("tiny", "g003"), ("top", top[0]), ("other", "zzz")] + [("all", f"g{i:03}") for i in range(120)]
    df, pw = spark.createDataFrame(ranks, "topic int, gene string, score double"), spark.createDataFrame(sets, "set string, gene string")
    got = {(r.topic, r["set"]): r for r in enrich.running_sum(df, pw, min_size=2, max_size=50, rounds=300).collect()}
    assert set(got) == {(t, s) for t in (1, 2) for s in ("top", *(f"s{k}" for k in range(5)))}
    for t in (1, 2):
        order = sorted({g: s for u, g, s in ranks[:240] if u == t}.items(), key=lambda x: (-x[1], x[0]))
        place, w = {g: i for i, (g, _) in enumerate(order)}, np.array([abs(s) for _, s in order])
        for s in ("top", "s0", "s3"):
            assert got[t, s].es == pytest.approx(plain_score(sorted({place[g] for q, g in sets if q == s}), w, 120))
    assert got[1, "top"].p < 1e-5 and got[1, "top"].p_adj < 1e-4 and got[1, "top"].leading_edge == top and got[1, "top"].size == 8
    assert all(0 < r.p <= 1 and r.p <= r.p_adj for r in got.values())
    again = {(r.topic, r["set"]): r.p for r in enrich.running_sum(df.repartition(5), pw, min_size=2, max_size=50, rounds=300).collect()}
    assert again == {k: r.p for k, r in got.items()}
    assert enrich.running_sum(df.limit(0), pw).count() == 0
