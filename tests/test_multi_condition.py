"""Moderated tests and mixed models of many edges against one edge at a time in numpy."""

import math

import numpy as np
import pytest

from weftlink.functions import stats
from weftlink.operators import compare
from weftlink.operators.mixed import mixed_models

EDGE = "tf string, gene_key string, peak_id string, sample int, value double"


def tail_by_quadrature(t, df):
    """Two-sided p of t by a fine sum over the density."""
    x = np.linspace(0, abs(t), 200_001)
    f = (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * np.trapezoid(f, x)


def test_t_tails():
    t, df = np.array([0.0, 0.5, -2.0, 4.0, 1.0, np.nan, 3.0]), np.array([3.0, 1.0, 7.3, 12.0, 400.0, 2.0, np.nan])
    got = stats.t_tails(t, df)
    for i in range(5):
        assert got[i] == pytest.approx(tail_by_quadrature(t[i], df[i]), abs=1e-9)
        assert got[i] == pytest.approx(stats.t_two_sided(t[i], df[i]), abs=1e-12)
    assert np.isnan(got[5:]).all() and stats.t_tails(np.zeros(0), np.zeros(0)).size == 0


def study(seed, edges=40, samples=18, lack=0.1):
    rng = np.random.default_rng(seed)
    info = [(s, f"c{s % 3}", float(s % 6), float((s * s) % 7), f"d{s // 3}") for s in range(samples)]
    rows = []
    for e in range(edges):
        own, donor = rng.normal(3, 2) * (e % 4 > 0), rng.normal(0, 0.2 + e % 3, samples // 3)
        rows += [("t", f"g{e}", "p", s, None if rng.random() < lack else float(own + 0.3 * (e % 5) * (s % 6) + donor[s // 3] + rng.normal(0, 1 + e % 2))) for s in range(samples)]
    return rows, info


INFO = "sample int, condition string, x double, z double, donor string"


def prior(s2, df):
    s2, df = np.array(s2), np.array(df, float)
    x = np.maximum(s2, 1e-5 * np.median(s2))
    e = np.log(x) + np.array([np.log(d / 2) - stats.digamma(d / 2) for d in df])
    extra = e.var(ddof=1) - np.mean([stats.trigamma(d / 2) for d in df])
    if extra <= 0:
        return math.inf, x.mean()
    d0 = 2 * stats.trigamma_inverse(extra)
    return d0, math.exp(e.mean() + stats.digamma(d0 / 2) - math.log(d0 / 2))


def shrunk(s2, df, d0, s0, pooled):
    return (s0, pooled) if math.isinf(d0) else ((d0 * s0 + df * s2) / (d0 + df), min(d0 + df, pooled))


@pytest.mark.parametrize(("seed", "lack"), [(1, 0.0), (2, 0.2)])
def test_moderated_f_of_group_means(spark, seed, lack):
    rows, info = study(seed, lack=lack)
    rows += [("t", "gone", "p", 0, None)] + [("t", "flat", "p", s, 2.0) for s in range(18)] + [("t", "few", "p", s, float(s)) for s in range(3)]
    got = {r.gene_key: r for r in compare.multi_anova(spark.createDataFrame(rows, EDGE), spark.createDataFrame(info, INFO)).collect()}
    of, fits = {i[0]: i[1] for i in info}, {}
    for g in {r[1] for r in rows}:
        own = [(of[s], v) for _, h, _, s, v in rows if h == g and v is not None]
        means = {c: np.mean([v for d, v in own if d == c]) for c in {c for c, _ in own}}
        if means:
            fits[g] = (sum((v - means[c]) ** 2 for c, v in own), len(own) - len(means), sum(means[c] ** 2 for c, _ in own), means)
    some = [f for f in fits.values() if f[1] > 0]
    d0, s0 = prior([f[0] / f[1] for f in some], [f[1] for f in some])
    assert got.keys() == fits.keys() and "few" in got and "gone" not in got
    for g, (ss, df, smm, means) in fits.items():
        s2, total = shrunk(ss / df if df else 0.0, df, d0, s0, sum(f[1] for f in some))
        assert got[g].F == pytest.approx(smm / len(means) / s2, rel=1e-9) and got[g].df1 == len(means) and got[g].df2 == pytest.approx(total)
        assert got[g].p == pytest.approx(stats.f_upper(got[g].F, len(means), total), abs=1e-12)
        assert got[g].means == pytest.approx(means)


@pytest.mark.parametrize("others", [[], ["z"]])
def test_moderated_slope(spark, others):
    rows, info = study(3, lack=0.15)
    rows += [("t", "few", "p", s, float(s)) for s in range(2)] + [("t", "one-x", "p", s, float(s)) for s in (0, 6, 12)]
    got = {r.gene_key: r for r in compare.multi_trend(spark.createDataFrame(rows, EDGE), spark.createDataFrame(info, INFO), "x", others=others).collect()}
    of, fits = {i[0]: [1.0, i[2], *([i[3]] if others else [])] for i in info}, {}
    for g in {r[1] for r in rows}:
        own = [(of[s], v) for _, h, _, s, v in rows if h == g and v is not None]
        x, y = np.array([o[0] for o in own]), np.array([o[1] for o in own])
        if len(y) >= x.shape[1] and np.linalg.matrix_rank(x) == x.shape[1]:
            inv = np.linalg.inv(x.T @ x)
            beta = inv @ x.T @ y
            fits[g] = beta[1], inv[1, 1], ((y - x @ beta) ** 2).sum(), len(y) - x.shape[1]
    some = [f for f in fits.values() if f[3] > 0]
    d0, s0 = prior([f[2] / f[3] for f in some], [f[3] for f in some])
    for g, r in got.items():
        if g not in fits:
            assert r.slope is None and r.p is None
            continue
        slope, unscaled, rest, df = fits[g]
        s2, total = shrunk(rest / df if df else 0.0, df, d0, s0, sum(f[3] for f in some))
        assert r.slope == pytest.approx(slope, rel=1e-7, abs=1e-9) and r.se == pytest.approx(math.sqrt(unscaled * s2), rel=1e-7)
        assert r.df == pytest.approx(total) and r.p == pytest.approx(stats.t_two_sided(r.t, total), abs=1e-9)
    assert len(fits) >= 40 and {"few", "one-x"} <= got.keys()


def dense(y, x, groups, theta, reml):
    """Everything of one edge at a ratio of standard deviations, by full matrices."""
    same = np.array(groups)[:, None] == np.array(groups)[None]
    v = np.eye(len(y)) + theta**2 * same
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    return a, beta, r @ vi @ r, np.linalg.slogdet(v)[1] + (np.linalg.slogdet(a)[1] if reml else 0.0)


def fit_alone(y, x, groups, reml):
    m = len(y) - (x.shape[1] if reml else 0)
    f = lambda t: (lambda d: m * math.log(d[2]) + d[3])(dense(y, x, groups, t, reml))
    grid = [0.0, *np.logspace(-4, 4, 200)]
    k = int(np.argmin([f(t) for t in grid]))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    for _ in range(200):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if f(a) <= f(b) else (a, hi)
    theta = 0.0 if k == 0 and f(0.0) <= f((lo + hi) / 2) else (lo + hi) / 2
    a, beta, rest, _ = dense(y, x, groups, theta, reml)
    sigma = math.sqrt(rest / m)

    def deviance(t, s):
        d = dense(y, x, groups, abs(t), reml)
        return 2 * m * math.log(s) + d[2] / s**2 + d[3]

    def covariance(t, s):
        return s * s * np.linalg.inv(dense(y, x, groups, abs(t), reml)[0])

    h = 1e-4 * max(theta, 0.1), 1e-4 * sigma
    d = lambda i, j: deviance(theta + i * h[0], sigma + j * h[1])
    tt, ss = (d(1, 0) - 2 * d(0, 0) + d(-1, 0)) / h[0] ** 2, (d(0, 1) - 2 * d(0, 0) + d(0, -1)) / h[1] ** 2
    ts = (d(1, 1) - d(1, -1) - d(-1, 1) + d(-1, -1)) / (4 * h[0] * h[1])
    spread = 2 * np.linalg.pinv(np.array([[tt, ts], [ts, ss]]))
    c = covariance(theta, sigma)
    g = np.stack([np.diag(covariance(theta + h[0], sigma) - covariance(theta - h[0], sigma)) / (2 * h[0]), np.diag(covariance(theta, sigma + h[1]) - covariance(theta, sigma - h[1])) / (2 * h[1])], 1)
    df = 2 * np.diag(c) ** 2 / np.einsum("pi,ij,pj->p", g, spread, g)
    return beta, np.sqrt(np.diag(c)), df


@pytest.mark.parametrize(("effects", "reml", "shift"), [(["x"], True, 0.0), (["x", "z"], True, 1e6), (["x"], False, 0.0)])
def test_mixed_models_equal_those_of_single_edges(spark, effects, reml, shift):
    rows, info = study(5, edges=25, lack=0.1)
    rows = [(*r[:4], None if r[4] is None else r[4] + shift) for r in rows]
    info.append((18, "c0", None, 1.0, "d9"))
    rows += [("t", "g0", "p", 18, 5.0), ("t", "g0", "p", 99, 5.0)]
    rows += [("t", "few", "p", s, float(s)) for s in range(2)] + [("t", "one-group", "p", s, float(s * s)) for s in range(3)] + [("t", "singles", "p", 3 * s, float(s % 4)) for s in range(6)] + [("t", "none", "p", 1, None)]
    got = mixed_models(spark.createDataFrame(rows, EDGE), spark.createDataFrame(info, INFO), effects, "donor", compare.KEY, reml).collect()
    of = {i[0]: (i[4], [1.0, *[dict(x=i[2], z=i[3])[e] for e in effects]]) for i in info[:18]}
    assert len(got) == len(effects) * len({r[1] for r in rows})
    for r in got:
        if r.gene_key in ("few", "one-group", "singles", "none"):
            assert r.beta is None and r.p is None and r.p_adj is None
            continue
        own = [(of[s], v) for _, g, _, s, v in rows if g == r.gene_key and v is not None and s in of]
        y, x = np.array([v for _, v in own]), np.array([o[1] for o, _ in own])
        beta, se, df = fit_alone(y - shift, x, [o[0] for o, _ in own], reml)
        i = 1 + effects.index(r.effect)
        assert r.beta == pytest.approx(beta[i], rel=1e-6, abs=1e-6) and r.se == pytest.approx(se[i], rel=1e-6)
        assert r.df == pytest.approx(df[i], rel=2e-3)
        assert r.p == pytest.approx(stats.t_two_sided(r.beta / r.se, r.df), abs=1e-9)
    for e in effects:
        own = sorted((r for r in got if r.effect == e and r.p is not None), key=lambda r: r.p)
        adjusted, least = {}, 1.0
        for i in range(len(own) - 1, -1, -1):
            least = min(least, own[i].p * len(own) / (i + 1))
            adjusted[own[i].gene_key] = least
        assert {r.gene_key: r.p_adj for r in own} == pytest.approx(adjusted)
