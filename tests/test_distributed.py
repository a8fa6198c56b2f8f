"""Numbers, permutations and hub scores of groups that many tasks share, against the same in memory."""

import contextlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftlink.operators import graph, topics
from weftlink.operators.numbering import counts_at_least, numbered_within


@contextlib.contextmanager
def many_parts(spark, n=7):
    """Sorted parts are not merged again, so groups lie in several."""
    wanted = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbers_of_groups_over_parts(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(i)) for i in rng.permutation(2000)] + [(f"g{i % 5}", int(i)) for i in rng.permutation(60)] + [(None, 4), (None, 2)]
    with many_parts(spark):
        got = numbered_within(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"], "i").toPandas()
    assert got.columns.tolist() == ["g", "v", "i"] and len(got) == len(rows)
    for _, own in got.groupby("g", dropna=False):
        assert own.sort_values("v").i.tolist() == list(range(len(own)))


def test_counts_at_least_of_ties_zeros_and_negative_values(spark):
    rng = np.random.default_rng(5)
    null = [(g, float(x), int(n)) for g in ("a", None) for x, n in zip(np.round(rng.normal(0, 1, 300), 1) * (rng.random(300) > 0.3), rng.integers(1, 4, 300))]
    seen = [(g, float(x)) for g in ("a", None) for x in [0.0, -0.0, 9.0, -9.0, *np.round(rng.normal(0, 1, 60), 1)]]
    got = counts_at_least(spark.createDataFrame(null, "g string, x double, n long"), spark.createDataFrame(seen, "g string, x double"), ["g"]).collect()
    assert {(r.g, r.x): r.larger for r in got} == {(g, x + 0.0): sum(n for h, y, n in null if h == g and y >= x) for g, x in seen}


def test_permutations_equal_those_in_memory(spark):
    rng = np.random.default_rng(7)
    rows = [(f"d{i}", t, float(p), float(g)) for t, n in ((1, 150), (2, 40), (None, 3)) for i, (p, g) in enumerate(zip(rng.random(n) * (rng.random(n) > 0.5), rng.random(n)))]
    df = spark.createDataFrame(rows, "doc_id string, topic int, peak_score double, gene_score double")
    rounds, want = 20, {}
    for t in (1, 2, None):
        own = sorted((r for r in rows if r[1] == t), key=lambda r: (r[0], r[2], r[3]))
        n = len(own)
        p, g = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        grid = spark.range(n).crossJoin(spark.range(rounds).withColumnRenamed("id", "b")).withColumn("topic", F.lit(t).cast("int"))
        h = grid.select("b", "id", topics.permutation_hash(1, "topic", F.col("b"), F.col("id")).alias("h")).toPandas()
        larger = np.zeros(n, int)
        for _, turn in h.groupby("b"):
            null = p * g[turn.sort_values(["h", "id"]).id.to_numpy()]
            larger += (null[None, :] >= (p * g)[:, None]).sum(1)
        want |= {(r[0], t): (1 + k) / (1 + rounds * n) for r, k in zip(own, larger)}
    with many_parts(spark):
        got = topics.empirical_fdr(df, rounds=rounds)
        found = {(r.doc_id, r.topic): r.p_perm for r in got.collect()}
    assert got.columns == [*df.columns, "p_perm", "q_perm"]
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_rounds_in_several_stages_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(f"d{i}", 1, float(a), float(b)) for i, (a, b) in enumerate(rng.random((50, 2)))], "doc_id string, topic int, peak_score double, gene_score double")
    one = {r.doc_id: r.p_perm for r in topics.empirical_fdr(df, rounds=9).collect()}
    monkeypatch.setattr(topics, "PERMUTED_ROWS", 100)
    assert {r.doc_id: r.p_perm for r in topics.empirical_fdr(df, rounds=9).collect()} == one


def test_permutations_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, topic int, peak_score double, gene_score double")
    assert topics.empirical_fdr(df, rounds=3).count() == 0


def plain_hubs(edges):
    e = edges.dropna().drop_duplicates()
    tf, tfs = pd.factorize(e["tf"], sort=True)
    gene, _ = pd.factorize(e["gene_key"], sort=True)
    a = np.zeros((len(tfs), gene.max() + 1))
    a[tf, gene] = 1
    h = np.ones(len(tfs))
    for _ in range(3000):
        h = a @ (a.T @ h)
        h /= np.linalg.norm(h)
    return dict(zip(tfs, h / h.max()))


def test_hub_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(t, f"t{a}", f"g{b}") for t in (1, 2, 3) for a, b in zip(rng.integers(0, 12, 60), rng.integers(0, 20, 60))]
    rows += [(4, "alone", "g1"), (5, "x", "g1"), (5, "x", "g2"), (5, "y", "g2"), (None, "n", "g1"), (1, None, "g1"), (1, "t1", None)]
    got = graph.hub_scores(spark.createDataFrame([*rows, *rows[:9]], "topic int, tf string, gene_key string")).toPandas()
    for t in (1, 2, 3, 4, 5):
        want = plain_hubs(pd.DataFrame([r[1:] for r in rows if r[0] == t], columns=["tf", "gene_key"]))
        own = got[got.topic == t].set_index("tf").hub.to_dict()
        assert own.keys() == want.keys() and all(own[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert got[got.topic.isna()].hub.tolist() == [1.0]
    assert graph.hub_scores(spark.createDataFrame([], "topic int, tf string, gene_key string")).count() == 0
