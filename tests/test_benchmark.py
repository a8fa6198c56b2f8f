"""Predicted against random values, one comparison at a time in numpy."""

import hashlib
import math

import numpy as np
import pytest

from weftlink.operators import benchmark


def test_rank_sums_of_comparisons(spark):
    rng = np.random.default_rng(2)
    rows = [(c, f"{c}-{i}", int(x), None if i % 17 == 0 else round(float(rng.normal(x, 1)), 1)) for c, n in (("a", 120), ("b", 60), (None, 30)) for i, x in enumerate(rng.random(n) < 0.3)]
    rows += [("only-predicted", "p1", 1, 2.0), ("flat", "f1", 1, 1.0), ("flat", "f2", 0, 1.0), ("flat", "f3", 0, 1.0), ("a", "odd", None, 1.0)]
    got = {r.c: r for r in benchmark.versus_random(spark.createDataFrame(rows, "c string, id string, x int, v double"), "id", "v", "x", "c").collect()}
    for c in ("a", "b", None):
        own = [r for r in rows if r[0] == c and r[3] is not None and r[2] is not None]
        x = [r[3] for r in own if r[2] == 1]
        others = sorted((r for r in own if r[2] == 0), key=lambda r: (hashlib.md5(f"{r[1]}|1".encode()).hexdigest(), r[1], r[3]))
        y = [r[3] for r in others[: len(x)]]
        both = x + y
        rank = lambda v: sum(u < v for u in both) + (sum(u == v for u in both) + 1) / 2
        w = sum(map(rank, x)) - len(x) * (len(x) + 1) / 2
        n = len(both)
        spread = len(x) * len(y) / 12 * (n + 1 - sum(both.count(v) ** 3 - both.count(v) for v in set(both)) / (n * (n - 1)))
        off = w - len(x) * len(y) / 2
        p = math.erfc(abs(off - math.copysign(0.5, off)) / math.sqrt(2 * spread))
        assert (got[c].n, got[c].W) == (len(x), w) and got[c].p == pytest.approx(p)
        assert got[c].median_predicted == pytest.approx(np.median(x)) and got[c].median_random == pytest.approx(np.median(y))
    assert got["only-predicted"].W is None and got["only-predicted"].p is None and got["flat"].p is None and got["flat"].W == 0.5
