"""Ranks, inversions and the coefficients made of them, against quadratic loops."""

import math
import time

import numpy as np
import pytest

from weftlink.operators import correlate


def plain_ranks(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def plain_kendall(a, b):
    n = len(a)
    s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i))
    ta, tb = ([list(v).count(x) for x in set(v)] for v in (a, b))
    pair = lambda t: sum(c * (c - 1) / 2 for c in t)
    n0 = n * (n - 1) / 2
    below = math.sqrt(n0 - pair(ta)) * math.sqrt(n0 - pair(tb))
    v = (n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in ta) - sum(c * (c - 1) * (2 * c + 5) for c in tb)) / 18
    v += sum(c * (c - 1) for c in ta) * sum(c * (c - 1) for c in tb) / (2 * n * (n - 1))
    if n > 2:
        v += sum(c * (c - 1) * (c - 2) for c in ta) * sum(c * (c - 1) * (c - 2) for c in tb) / (9 * n * (n - 1) * (n - 2))
    return (s / below if below else None), (s / math.sqrt(v) if v > 0 else None)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 33])
def test_ranks_and_inversions(n):
    rng = np.random.default_rng(n)
    x = np.vstack([rng.integers(0, 5, (20, n)), rng.permutation(n)[None], np.arange(n)[None], -np.arange(n)[None]]).astype(float)
    assert np.allclose(correlate.rank_rows(x), [plain_ranks(r) for r in x])
    assert correlate.inversions(x).tolist() == [sum(r[i] > r[j] for j in range(n) for i in range(j)) for r in x]


@pytest.mark.parametrize("n", [2, 3, 9, 40])
def test_kendall_of_ties(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 4, (30, n)).astype(float), rng.integers(0, 4, (30, n)).astype(float)
    a[:5], b[3:8] = rng.random((5, n)), rng.random((5, n))
    a[9] = 2.0
    tau, z = correlate.kendall_rows(a, b)
    for i in range(30):
        want = plain_kendall(a[i], b[i])
        assert tau[i] == pytest.approx(want[0]) if want[0] is not None else np.isnan(tau[i])
        assert z[i] == pytest.approx(want[1]) if want[1] is not None else np.isnan(z[i])


def test_ten_thousand_samples_a_pair():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4, 10_000))
    b = a + rng.normal(size=a.shape)
    start = time.time()
    tau, _ = correlate.kendall_rows(a, b)
    assert time.time() - start < 10
    # Of a normal pair, tau is 2 / pi times the arc sine of the correlation.
    assert np.allclose(tau, 2 / np.pi * np.arcsin(math.sqrt(0.5)), atol=0.02)


@pytest.mark.parametrize("method", ["spearman", "kendall", "pearson"])
def test_coefficients_of_missing_tied_and_gated_values(spark, method):
    rng = np.random.default_rng(3)
    samples = [f"s{i}" for i in range(12)]
    table = lambda keys, lack: [(k, s, None if rng.random() < lack else float(rng.integers(0, 6))) for k in keys for s in samples]
    X, Y = table("abcd", 0.3) + table("ef", 0), table("uvw", 0.2) + table("xy", 0)
    opened = [(k, s, int(rng.random() < 0.7)) for k in "abcdef" for s in samples]
    pairs = [(a, b) for a in "abcdef" for b in "uvwxy"]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} string, sample string, value double")
    flags = spark.createDataFrame(opened, "peak string, sample string, value int")
    for gate in (None, flags):
        got = {(r.peak, r.gene): r for r in correlate.correlate(spark.createDataFrame(pairs, "peak string, gene string"), df(X, "peak"), df(Y, "gene"), "peak", "gene", method, 4, x_open=gate).collect()}
        assert len(got) == len(pairs)
        x, y, o = ({(k, s): v for k, s, v in t} for t in (X, Y, opened))
        for a, b in pairs:
            at = [s for s in samples if x[a, s] is not None and y[b, s] is not None and (gate is None or o[a, s])]
            u, v = [x[a, s] for s in at], [y[b, s] for s in at]
            assert got[a, b].n == len(at)
            if len(at) < 4 or len(set(u)) < 2 or len(set(v)) < 2:
                assert got[a, b].r is None
            else:
                want = plain_kendall(u, v)[0] if method == "kendall" else np.corrcoef(*((plain_ranks(u), plain_ranks(v)) if method == "spearman" else (u, v)))[0, 1]
                assert got[a, b].r == pytest.approx(want, abs=1e-9)


def test_arrays_over_samples(spark):
    rows = [("a", 3, 1.0), ("a", 1, 5.0), ("a", 1, 2.0), ("b", 2, float("nan")), ("c", 9, 4.0), ("a", None, 8.0), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, sample int, value double")
    got = {r.k: r.v for r in correlate.pack(df, "k", [1, 2, 3]).collect()}
    assert got == {"a": [2.0, None, 1.0], "b": [None] * 3, "c": [None] * 3}
