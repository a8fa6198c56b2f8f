"""What goes through shuffles grows with the rows of a query, not with their pairs."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftlink.operators import benchmark, communities, compare, graph, intervals, links, topics


def shuffled(spark, df) -> int:
    """Rows that the stages of a run write for others."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)

    def total() -> int:
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, quantiles, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def spots(spark, n: int, width: int):
    """``n`` rows of ten intervals."""
    at = (F.col("id") % 10 * 7).alias("start")
    return spark.range(n).select("id", F.lit("c").alias("chrom"), at, (at + width).alias("end"))


@pytest.fixture()
def plain_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_window_priors_do_not_shuffle_pairs(spark, plain_joins):
    genes = spots(spark, 3000, 1).select("chrom", F.col("start").alias("tss"), F.concat(F.lit("G"), "id").alias("gene_key"))
    peaks = spark.range(50).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 90).alias("end"))
    df = links.window_priors(peaks, genes, 100)
    assert df.count() == 50 * 3000
    assert shuffled(spark, df) < 30_000


def test_prior_of_a_repeated_gene_comes_once(spark):
    peaks = spark.createDataFrame([("c", 10, 20), ("c", 12, 20)], "chrom string, start int, end int")
    genes = spark.createDataFrame([("c", 11, "a"), ("c", 15, "a"), ("c", 15, "b"), ("d", 15, "a")], "chrom string, tss int, gene_key string")
    got = sorted((r.start, r.gene_key) for r in links.window_priors(peaks, genes, 5).collect())
    assert got == [(10, "a"), (10, "b"), (12, "a"), (12, "b")]


def test_nearest_site_does_not_make_pairs(spark, plain_joins):
    a, b = (spots(spark, n, 0).select("id", "chrom", F.col("start").alias("pos")) for n in (2000, 1000))
    df = intervals.nearest(a, b, 50, ["id"])
    assert df.count() == 2000 and df.where("distance <> 0").count() == 0
    assert shuffled(spark, df) < 20_000


def test_nearest_equals_all_pairs(spark):
    a = [(i, "cd"[i % 2], (i * 37) % 500 - 20) for i in range(120)] + [(500, None, 3), (501, "c", None)]
    b = [(i, "cd"[i % 3 % 2], (i * 53) % 600) for i in range(90)] + [(900, "c", None), (901, None, 3)]
    for within in (0, 4, 30):
        got = intervals.nearest(spark.createDataFrame(a, "id int, chrom string, pos int"), spark.createDataFrame(b, "id int, chrom string, pos int"), within, ["id"], tie="r_id")
        want = set()
        for i, c, p in a:
            near = [(abs(q - p), j, q) for j, d, q in b if None not in (c, p, d, q) and c == d and abs(q - p) <= within]
            want |= {(i, c, p, j, c, q, d) for d, j, q in sorted(near)[:1]}
        assert got.columns == ["id", "chrom", "pos", "r_id", "r_chrom", "r_pos", "distance"]
        assert {tuple(r) for r in got.collect()} == want


def test_candidates_do_not_shuffle_pairs(spark, plain_joins):
    peaks = spots(spark, 1000, 5).withColumnRenamed("id", "region")
    priors = spots(spark, 1000, 9).select("chrom", "start", "end", F.concat(F.lit("G"), "id").alias("gene_key"))
    df = links.prior_candidates(peaks, priors)
    assert df.count() == sum(1 for i in range(10) for j in range(10) if i * 7 <= j * 7 + 9 and i * 7 + 5 >= j * 7) * 100 * 100
    assert shuffled(spark, df) < 20_000
    twice = links.prior_candidates(peaks.unionByName(peaks.where("region < 3").withColumn("end", F.col("end") + 1)), priors)
    assert twice.count() == df.count() and twice.distinct().count() == df.count()


def test_anchored_priors_do_not_shuffle_pairs(spark, plain_joins):
    a = spots(spark, 600, 20)
    loops = a.select(F.col("id").alias("loop_id"), F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("chrom").alias("chrom2"), (F.col("start") + 1000).alias("start2"), (F.col("end") + 1000).alias("end2"))
    genes = spots(spark, 500, 1).select("chrom", F.col("start").alias("tss"), F.concat(F.lit("G"), "id").alias("gene_key"))
    df = links.anchored_priors(loops, genes, 100, 300)
    assert df.count() == 600 * 500 and df.where("how = 'nearest'").count() == 0
    assert shuffled(spark, df) < 20_000


def test_overlaps_of_equal_intervals_are_all_there(spark, plain_joins, monkeypatch):
    a, b = spots(spark, 700, 5), spots(spark, 900, 9)
    meet = sum(1 for i in range(10) for j in range(10) if i * 7 < j * 7 + 9 and i * 7 + 5 > j * 7)
    for held in (intervals.HELD, 7):
        monkeypatch.setattr(intervals, "HELD", held)
        got = intervals.overlap_join(a, b, bin_size=10)
        assert got.columns == ["id", "chrom", "start", "end", "r_id", "r_chrom", "r_start", "r_end"]
        assert got.count() == got.distinct().count() == meet * 70 * 90
    odd = a.unionByName(spark.createDataFrame([(-1, None, 1, 2), (-2, "c", None, 2), (-3, "z", 1, 2), (-4, "c", 500, 600)], "id long, chrom string, start long, end long"))
    left = intervals.overlap_join(odd, b, bin_size=10, how="left")
    assert left.count() == meet * 70 * 90 + 4 and sorted(r.id for r in left.where("r_id is null").collect()) == [-4, -3, -2, -1]
    assert shuffled(spark, left) < 50_000


def test_truth_does_not_make_pairs(spark, plain_joins):
    a, b = spots(spark, 900, 6), spots(spark, 900, 9).where("start % 3 = 0")
    df = benchmark.truth_by_overlap(a, b)
    starts = [7 * j for j in range(10) if 7 * j % 3 == 0]
    want = {i: int(any(min(s + 6, q + 9) - max(s, q) >= 3 for q in starts)) for i in range(900) for s in [i % 10 * 7]}
    assert {r.id: r.truth for r in df.collect()} == want and not math.prod(want.values())
    assert shuffled(spark, df) < 20_000


def test_topics_of_links_are_ranked_within_their_rows(spark, plain_joins):
    n, k = 400, 6
    edges = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("t").alias("tf"), F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("gene_key"), F.col("id").alias("peak_id"))
    theta = spark.createDataFrame([("d", t, t / 21) for t in range(1, k + 1)], "doc_id string, topic int, theta double")
    genes = spark.createDataFrame([(t, f"g{g}", (t * g % 5 + 1) / 10) for t in range(1, k + 1) for g in range(4)], "topic int, term_id string, phi double")
    sites = spark.range(n).crossJoin(theta.select("topic")).select("topic", F.concat(F.lit("PEAK:"), "id").alias("term_id"), ((F.col("id") + F.col("topic")) % 7 / 10).alias("phi"))
    phi = genes.withColumn("term_id", F.concat(F.lit("GENE:"), "term_id")).unionByName(sites)
    scores = phi.withColumnRenamed("phi", "score")
    for df, rows in (
        (topics.edge_topics(edges, theta, genes, 2), 2 * n),
        (topics.link_topic_scores(edges, theta, phi, top_k=2), 2 * n),
        (topics.topic_links(edges, scores, scores.withColumn("in_topic", F.col("score") > 0.3)), k * n),
    ):
        assert df.count() == rows
        # A distinct of the links and a join by site, but no row a topic.
        assert shuffled(spark, df) < 3 * n
    best = {r.gene_key: r.topic for r in topics.edge_topics(edges, theta, genes, 1).collect()}
    assert best == {f"g{g}": min(range(1, k + 1), key=lambda t: (-t * (t * g % 5 + 1), t)) for g in range(4)}


def test_rounds_leave_no_numbered_links_behind(spark, monkeypatch):
    from urllib.parse import urlparse

    from weftlink.sources.staging import shared_dir

    kept = lambda: {p.name for p in Path(urlparse(shared_dir(spark)).path, "weftlink").glob("numbered-*")}
    df = spark.createDataFrame([(f"d{i}", 1, i % 7 / 7, i % 5 / 5) for i in range(30)], "doc_id string, topic int, peak_score double, gene_score double")
    monkeypatch.setattr(topics, "PERMUTED_ROWS", 60)
    before = kept()
    assert topics.empirical_fdr(df, rounds=4).where("p_perm > 0").count() == 30
    # The links' own numbers stay, those of two batches of rounds do not.
    assert len(kept() - before) <= 1


LINK = "tf string, gene_key string, peak_id int, condition int, link_score double, fp_score double, tf_expr double, gene_expr double, active int, link_sign string"


def test_conditions_of_a_key_meet_in_one_shuffle(spark, plain_joins, monkeypatch):
    n = 2000
    df = spark.range(4 * n).select(F.lit("t").alias("tf"), F.lit("g").alias("gene_key"), F.shiftright("id", 2).cast("int").alias("peak_id"), F.pmod("id", F.lit(4)).cast("int").alias("condition"))
    df = df.withColumns({m: F.pmod("peak_id", F.col("condition") + 5).cast("double") for m in compare.MEASURES}).withColumn("active", F.lit(1)).withColumn("link_sign", F.lit("+"))
    specs = spark.createDataFrame([(f"{i}", i, i - 1) for i in (1, 2, 3)], "comparison_id string, case int, control int")
    found = compare.compare_many(df, specs, ranks=False)
    assert found.count() == found.where("delta_link_score is not null").count() == 3 * n
    # A row a key is gathered, and neither cases nor controls are dealt again by comparison.
    assert shuffled(spark, found) <= 4 * n
    monkeypatch.setattr(compare, "RANK_ROWS", 3)
    # Ranks come to the rows that were kept.
    assert shuffled(spark, compare.compare_many(df, specs)) == 0


def test_gathered_controls_are_those_of_a_join(spark):
    rows = [(t, g, p, c, float((p * 7 + (c or 0)) % 5), 1.0, float(c or 0), 2.0, p % 2, "+-"[p % 2]) for t in ("a", None) for g in ("x", "y") for p in range(5) for c in (1, 2, 3, None) if (p + (c or 0)) % 4]
    rows += [("a", "x", 1, 1, 9.0, 1.0, 1.0, 2.0, 1, "-"), ("a", "x", 1, 1, 9.0, 1.0, 1.0, 2.0, 1, "-"), ("a", "x", None, 2, 9.0, 1.0, 1.0, 2.0, 1, None)]
    specs = [("2_1", 2, 1), ("1_2", 1, 2), ("3_9", 3, 9), ("1_1", 1, 1), ("3_", 3, None)]
    got = compare.compare_many(spark.createDataFrame(rows, LINK), spark.createDataFrame(specs, "comparison_id string, case int, control int"), signs="prefer_case")
    want = []
    for name, case, control in specs:
        for r in (r for r in rows if r[3] == case):
            met = [q[4] for q in rows if control is not None and q[3] == control and None not in r[:3] and q[:3] == r[:3]] or [None]
            want += [(name, *r[:3], r[4], x, None if x is None else r[4] - x) for x in met]
    seen = got.select("comparison_id", "tf", "gene_key", "peak_id", "link_score_case", "link_score_ctrl", "delta_link_score").collect()
    assert sorted(map(str, map(tuple, seen))) == sorted(map(str, want))


def test_topic_summary_reads_its_links_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = [("a;b", "t", "g", 1.0, 2.0), ("a", "t", "g", -0.5, 3.0), ("a", "t", None, 2.0, None), ("a", "u", "h", 0.1, 1.0), ("b", "u", "h", -1.0, 1.0), ("b", None, "h", 4.0, 1.0), ("b", "u", "h", None, 9.0)]

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "topics string, tf string, gene_key string, delta_link_score double, log2FC_tf_expr double")
    got = graph.topic_summary(df.mapInArrow(counted, df.schema)).collect()
    assert read.value == len(rows)
    seen = {(r.topic, r.tf): (r.n_links, r.n_genes, r.sum_delta, r.sum_abs_delta, r.log2fc_tf, r.topic_abs_delta, r.topic_links, r.topic_rank, r.tf_rank) for r in got}
    assert seen == {
        ("a", "t"): (3, 1, 2.5, 3.5, 3.0, 3.5, 3, 2, 1),
        ("b", None): (1, 1, 4.0, 4.0, 1.0, 6.0, 3, 1, 1),
        ("b", "t"): (1, 1, 1.0, 1.0, 2.0, 6.0, 3, 1, 2),
        ("b", "u"): (1, 1, -1.0, 1.0, 1.0, 6.0, 3, 1, 3),
    }


def test_rounds_of_a_small_graph_are_one_job_each(spark):
    sc = spark.sparkContext
    rows = spark.range(300).select((F.col("id") % 6).cast("string").alias("a"), (F.col("id") % 25 + 100).cast("string").alias("b"), (F.col("id") % 7 + 1.0).alias("weight"))
    jobs = {}
    for rounds in (1, 7):
        sc.setJobGroup(f"rounds-{rounds}", "")
        communities.communities(rows, rounds=rounds, levels=1, settle=-1.0)
        jobs[rounds] = len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 <= jobs[7] - jobs[1] <= 6 + 8


def test_communities_of_one_part_equal_those_of_many(spark, monkeypatch):
    rows = spark.range(900).select((F.col("id") % 60).cast("string").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(9)) + F.floor(F.col("id") % 60 / 10) * 9 + 100).cast("string").alias("b"), (F.col("id") % 7 + 1.0).alias("weight"))
    one = {r.node: r.community for r in communities.communities(rows, rounds=8).collect()}
    monkeypatch.setattr(communities, "FILE_ROWS", 0)
    assert len(set(one.values())) > 1 and one == {r.node: r.community for r in communities.communities(rows, rounds=8).collect()}


def test_deltas_of_sums_equal_those_of_links(spark, plain_joins, monkeypatch):
    rows = [(f"t{i % 3}", None if i % 29 == 0 else f"g{i % 5}", i % 7, 2000 + i // 105, None if i % 31 == 0 else float(i % 17 - 8)) for i in range(400)]
    parts = spark.createDataFrame(rows, "tf string, gene_key string, peak_id long, condition int, part double").repartition(3)
    specs = spark.createDataFrame([("a", 2001, 2000), ("b", 2003, 2001), ("c", 2000, 1990), ("d", 2003, None), ("e", 2001, 2000)], "comparison_id string, case int, control int")
    known = compare.standard_links(parts.groupBy(*compare.KEY, "condition").agg((F.sum("part") / 10).alias("link_score")))
    cols = ["comparison_id", *compare.KEY, F.round("delta_link_score", 9)]
    want = sorted(tuple(r) for r in compare.compare_many(known, specs, signs="prefer_case", ranks=False).where("delta_link_score is not null").select(cols).collect())
    made = lambda: compare.score_deltas(parts, specs, lambda total: total / 10)
    assert len(want) > 100 and sorted(tuple(r) for r in made().select(cols).collect()) == want
    # At most a row a key from each part, whatever the number of conditions.
    assert shuffled(spark, made()) <= 3 * 3 * 5 * 7 + 400
    monkeypatch.setattr(compare, "SUM_COMPARISONS", 4)
    assert sorted(tuple(r) for r in made().select(cols).collect()) == want
    assert compare.score_deltas(parts, specs.limit(0), lambda total: total).count() == 0


def test_rounds_of_permuted_links_shuffle_no_links(spark, plain_joins, monkeypatch):
    n, rounds = 3000, 20
    edges = spark.range(n).select(F.concat(F.lit("d"), F.col("id") % 50).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("tf"), F.concat(F.lit("g"), F.col("id") % 4).alias("gene_key"), (F.col("id") % 60).alias("peak_id"))
    terms = spark.range(60).select(F.concat(F.lit("PEAK:"), "id").alias("term_id"), (F.col("id") * 7 % 11 / 11).alias("score")).unionByName(spark.range(3).select(F.concat(F.lit("GENE:g"), "id").alias("term_id"), (F.col("id") / 3).alias("score")))
    scores = terms.crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("topic"))).withColumn("score", F.col("score") / F.col("topic"))
    made = lambda: topics.topic_links(edges, scores, scores.withColumn("in_topic", F.lit(True)), "link_score_efdr", rounds=rounds)
    later = type("Later", (), {"write": property(lambda self: made().write)})()
    links = edges.distinct().count()
    assert shuffled(spark, later) < 10 * n < 2 * links * rounds
    one = made()
    # The same as when all rows are permuted one by one, and as when a group is many ranges of hashes.
    rows = one.drop("p_perm", "q_perm", "link_pass")
    want = sorted((r.topic, r.gene_key, r.peak_id, r.doc_id, r.tf, r.p_perm, r.q_perm) for r in topics.empirical_fdr(rows, rounds=rounds).collect())
    for at_once in (topics.PERMUTED_ROWS, 400):
        monkeypatch.setattr(topics, "PERMUTED_ROWS", at_once)
        assert sorted((r.topic, r.gene_key, r.peak_id, r.doc_id, r.tf, r.p_perm, r.q_perm) for r in made().collect()) == want
    assert len(want) == 2 * links and len({w[5] for w in want}) > 10


def joined_rows(spark, df) -> int:
    """Rows that the joins of a run give, and the rows of its result."""
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    found, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    metrics = [m for i in range(nodes.size()) if nodes.apply(i).name() == "SortMergeJoin" for m in [nodes.apply(i).metrics()]]
    ids = [m.apply(k).accumulatorId() for m in metrics for k in range(m.size()) if m.apply(k).name() == "number of output rows"]
    return sum(int(found.apply(i).replace(",", "")) for i in ids if found.contains(i))


def test_pairs_of_different_intervals_are_not_joined_one_by_one(spark, plain_joins):
    a = spark.range(600).select("id", F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 900).alias("end"))
    df = intervals.overlap_join(a, a, bin_size=2000)
    assert df.count() == 600 * 600
    assert 0 < joined_rows(spark, df) < 600 * 600 / 20
    genes = a.select("chrom", F.col("start").alias("tss"), F.concat(F.lit("G"), "id").alias("gene_key"))
    priors = links.window_priors(a, genes, 1000)
    assert priors.count() == 600 * 600 and 0 < joined_rows(spark, priors) < 600 * 600 / 20
    assert priors.where("start = 7").select("prior_id").distinct().collect() == [("WIN_c:7-907",)]


def test_overlaps_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HELD", 3)
    a = [(i, "cd"[i % 2], (i * 37) % 90 - 20, (i * 37) % 90 - 20 + i % 12) for i in range(80)] + [(900, None, 3, 9), (901, "c", None, 9), (902, "c", 3, None)]
    b = [(i, "cd"[i % 3 % 2], (i * 53) % 100 - 30, (i * 53) % 100 - 30 + i % 25) for i in range(70)]
    shape = "id int, chrom string, start int, end int"
    for closed in (False, True):
        got = intervals.overlap_join(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), closed=closed, bin_size=8)
        meet = lambda x, y: x[2] <= y[3] and x[3] >= y[2] if closed else x[2] < y[3] and x[3] > y[2]  # noqa: B023, E731
        want = sorted((*x, *y) for x in a[:80] for y in b if x[1] == y[1] and meet(x, y))
        assert sorted(tuple(r) for r in got.collect()) == want
