"""Components, agreement links and chains against plain loops, and groups that no single task could hold."""

import itertools

import numpy as np
import pytest

from weftlink.operators import intervals
from weftlink.operators.components import agreeing, components, spanning_links


def heads(nodes, links):
    top = {n: n for n in nodes}

    def head(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        p, q = head(a), head(b)
        top[max(p, q)] = min(p, q)
    return {n: head(n) for n in nodes}


def test_components_of_paths_hubs_and_nothing(spark):
    rng = np.random.default_rng(2)
    links = [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 150, (110, 2))]
    links += [(f"p{i:03}", f"p{i + 1:03}") for i in rng.permutation(80)] + [("hub", f"h{i}") for i in range(200)] + [("x", "x"), (None, "y")]
    got = dict(components(spark.createDataFrame(links, "a string, b string")).collect())
    links = [(a, b) for a, b in links if a is not None and a != b]
    assert got == heads({n for e in links for n in e}, links)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def agree(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("least", "block"), [(0.5, 1024), (0.8, 3), (1.0, 4), (0.01, 1024)])
def test_agreement_clusters(spark, least, block):
    rng = np.random.default_rng(int(least * 100))
    rows = []
    for g in ("g1", "g2", None):
        for i in range(60):
            v = [None if x == 3 else float(x) for x in rng.integers(0, 4, 6)]
            rows.append((g, f"{g}-{i:02}", v))
    rows += [("g1", f"g1-z{i}", rows[0][2]) for i in range(5)] + [("g1", "g1-neg", [-0.0] * 6), ("g1", "g1-pos", [0.0] * 6)]
    need = max(1, int(np.ceil(least * 6 - 1e-9)))
    want = {}
    for g in ("g1", "g2", None):
        own = {k: v for h, k, v in rows if h == g}
        want |= heads(own, [(a, b) for a, b in itertools.combinations(own, 2) if agree(own[a], own[b]) >= need])
    got = {r.k: r.cluster for r in agreeing(spark.createDataFrame(rows, "region string, k string, v array<double>"), "region", "k", "v", least, block).collect()}
    assert got == want


def test_agreement_of_nothing(spark):
    assert agreeing(spark.createDataFrame([], "region string, k string, v array<double>"), "region", "k", "v", 0.5).count() == 0


def test_a_spanning_forest_joins_what_agrees():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (200, 5))
    a, b = spanning_links(x, 4)
    want = heads(range(200), [(i, j) for i, j in itertools.combinations(range(200), 2) if (x[i] == x[j]).sum() >= 4])
    assert heads(range(200), list(zip(a.tolist(), b.tolist()))) == want and len(a) == 200 - len(set(want.values()))


def test_a_region_of_many_sites(spark):
    """A value that all sites of one region share in most places: every pair of blocks is a task's work of its own."""
    rng = np.random.default_rng(6)
    rows = [("r", i, [0.0, 0.0, 0.0, float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(rng.integers(0, 400, (6000, 3)))]
    got = agreeing(spark.createDataFrame(rows, "region string, k long, v array<double>"), "region", "k", "v", 0.8).toPandas()
    x = np.array([r[2] for r in rows])
    a, b = spanning_links(x, 5)
    want = heads(range(len(rows)), list(zip(a.tolist(), b.tolist())))
    assert dict(zip(got.k, got.cluster)) == want


def plain_chains(rows):
    out, now, seen = [], None, None
    for c, s, e in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if now is None or c != now[0] or s > seen:
            now, seen = [c, s, e, 0], e
            out.append(now)
        seen = max(seen, e)
        now[2], now[3] = seen, now[3] + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("parts", ["1", "9"])
def test_chains_across_sorted_parts(spark, parts):
    """Long intervals that reach over many parts, short ones that are all chains, repeats and a null group."""
    rng = np.random.default_rng(4)
    rows = [("a", int(s), int(s + w)) for s, w in zip(rng.integers(0, 40_000, 700), rng.integers(0, 60, 700))]
    rows += [("b", 10 * i, 10 * i + 3) for i in range(500)] + [("c", 0, 30_000)] + [("c", 50 * i, 50 * i + 5) for i in range(700)]
    rows += [("d", 5, 9)] * 300 + [(None, 1, 4), (None, 4, 6), (None, 9, 9)] + [("e", 10, 2), ("e", 3, 5)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame([*rows, ("a", None, 7)], "chrom string, start long, end long")
        got = sorted(((r.chrom, r.start, r.end, r.group_size) for r in intervals.merged(df, ["chrom"], "start", "end").collect()), key=str)
        each = intervals.merge_chains(df, ["chrom"], "start", "end").toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_chains(rows)
    assert len(each) == len(rows) + 1 and each.chain.isna().sum() == 1
    for _, own in each.dropna(subset=["chain"]).groupby("chrom", dropna=False):
        assert sorted(own.chain.unique()) == list(range(1, own.chain.nunique() + 1))
        assert (own.sort_values(["start", "end"]).chain.diff().dropna() >= 0).all()


def test_aligned_sites(spark):
    """Sites of a region that agree and lie near each other become one; null scores agree with null."""
    rng = np.random.default_rng(9)
    peaks = [(f"p{i:02}", f"r{i % 3}", "chr1", int(s), int(s) + 8) for i, s in enumerate(rng.integers(0, 300, 60))]
    scores = [(p[0], s, None if v == 0 else float(v)) for p in peaks for s, v in enumerate(rng.integers(0, 3, 5))]
    got = {r.peak: (r.region, r.merged_id, r.group_size) for r in intervals.align_sites(spark.createDataFrame(scores, "peak string, sample int, value double"), spark.createDataFrame(peaks, "peak string, region string, chrom string, start long, end long"), slop=10, least=0.6).collect()}
    values = {p[0]: [v for q, _, v in scores if q == p[0]] for p in peaks}
    want = {}
    for region in ("r0", "r1", "r2"):
        own = {p[0]: p for p in peaks if p[1] == region}
        cluster = heads(own, [(a, b) for a, b in itertools.combinations(own, 2) if agree(values[a], values[b]) >= 3])
        for c in set(cluster.values()):
            chain, seen = [], None
            for p in [*sorted((own[k] for k in own if cluster[k] == c), key=lambda p: (p[3] + p[4]) // 2), None]:
                mid = p and (p[3] + p[4]) // 2
                if chain and (p is None or mid - 10 > seen):
                    name = f"chr1:{min(q[3] for q in chain)}-{max(q[4] for q in chain)}"
                    want |= {q[0]: (region, name, len(chain)) for q in chain}
                    chain = []
                if p:
                    chain.append(p)
                    seen = mid + 10
    assert got == want
