"""Sharding, centroid clustering and code compression against plain brute force, on odd rows too."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, shard string, slot long, part int, size string, extra map<string,int>"
VECTORS = "vec_id long, embedding array<double>, label int, id long, cluster int, x string"


def odd_documents(spark, copies=300):
    rng = np.random.default_rng(3)
    rows = [(int(i), "wé " * int(rng.integers(0, 60)), "a", 1, 1, "s", {"k": 1}) for i in rng.permutation(400)]
    rows += [(7, "same text", None, None, None, None, None)] * copies
    rows += [(None, None, None, None, None, None, None), (None, "", "b", 2, 2, "t", None), (401, "long " * 40_000, None, 0, 0, "", None), (402, None, None, 0, 0, "", None)]
    return spark.createDataFrame(rows, DOCS).repartition(7)


@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards_are_contiguous_and_balanced(spark, n):
    from weftlink.llm.sharding import balanced_shards, text_bytes

    docs = odd_documents(spark)
    got = balanced_shards(docs, text_bytes(F.col("text")), ["doc_id"], n)
    assert got.columns == ["doc_id", "text", "part", "size", "extra", "shard", "slot"]
    p = got.toPandas()
    weight = p.text.map(lambda t: len((t or "").encode()) + 8)
    assert len(p) == docs.count()
    assert sorted(map(str, zip(p.doc_id, p.text))) == sorted(map(str, docs.select("doc_id", "text").toPandas().itertuples(index=False, name=None)))
    for s, own in p.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and 0 <= s < n
        assert abs(weight[own.index].sum() - weight.sum() / n) <= weight.max()
    # In order of shard and slot, ids rise (null ids first), and each row lies where its middle does.
    order = p.assign(w=weight).sort_values(["shard", "slot"])
    ids = order.doc_id.fillna(-1).to_numpy()
    assert (np.diff(ids) >= 0).all()
    upto = order.w.cumsum()
    assert (order.shard.to_numpy() == ((2 * upto - order.w) * n // (2 * weight.sum())).to_numpy()).all()


def test_shards_of_little_or_nothing(spark):
    from weftlink.llm.sharding import balanced_shards, text_bytes

    docs = odd_documents(spark)
    assert balanced_shards(docs.limit(0), text_bytes(F.col("text")), ["doc_id"]).count() == 0
    few = balanced_shards(docs.where("doc_id in (3, 4)"), text_bytes(F.col("text")), ["doc_id"], 24).toPandas()
    assert len(few) == 2 and few.shard.between(0, 23).all() and set(few.slot) <= {0, 1}
    with pytest.raises(ValueError):
        balanced_shards(docs, text_bytes(F.col("text")), ["doc_id"], 0)


def test_cuts_within_and_between_partitions(spark):
    """A cut on the border of two sorted partitions, and several cuts in one."""
    from weftlink.llm.sharding import PLACE_BITS, shard_starts

    sizes = {0: [10, 10], 1: [5, 5, 5, 5], 2: [1000], 3: [20]}
    rows = [((p << PLACE_BITS) + i, s) for p, own in sizes.items() for i, s in enumerate(own)]
    for n in (1, 2, 3, 53, 106):
        got = {r["part"]: r["starts"] for r in shard_starts(spark.createDataFrame(rows, "pos long, size long"), n).collect()}
        total, before, number, first = sum(s for _, s in rows), 0, 0, {}
        for pos, s in sorted(rows):
            want = (2 * before + s) * n // (2 * total)
            first.setdefault(want, number)
            mine = [x for x in got[pos >> PLACE_BITS] if x["pos"] <= pos][-1]
            assert mine["shard"] == want
            assert (pos & ((1 << PLACE_BITS) - 1)) - mine["drop"] == number - first[want]
            before, number = before + s, number + 1


def test_shards_as_files(spark, tmp_path):
    from weftlink.llm.sharding import write_shards

    docs = odd_documents(spark).drop("extra").where("doc_id is null or doc_id <> 401")
    back = write_shards(docs, str(tmp_path / "shards"), n=4)
    assert back.count() == docs.count() and sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
    assert sorted(x.name for x in (tmp_path / "shards").iterdir() if x.is_dir()) == [f"shard={i}" for i in range(4)]


def test_shard_query(spark, tmp_path):
    from weftlink.llm.queries import QUERIES

    odd_documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    p = QUERIES["op11_byte_shards"](spark, str(tmp_path)).toPandas()
    want = odd_documents(spark).select("doc_id", "text").toPandas()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(zip(p.doc_id.fillna(-1), p["size"], p.text_crc32)) == sorted((-1 if d != d else d, len((t or "").encode()) + 8, crc(t)) for d, t in zip(want.doc_id, want.text))
    assert set(p.law) == {"bytes"} and p.grown_shard.isna().all()


def vectors(spark, dims=64, n=500):
    """Near groups, ties, repeats, a hot copy and everything that takes no part."""
    rng = np.random.default_rng(8)
    heads = rng.normal(0, 0.3, (20, dims))
    rows = [(i, (heads[i % 20] + rng.normal(0, 0.05, dims)).astype(np.float32).astype(float).tolist(), i % 4 if i % 9 else None, 5, 6, "x") for i in range(n)]
    rows += [(1000 + i, rows[3][1], 1, 0, 0, None) for i in range(n // 2)] + [(7, rows[8][1], 2, 0, 0, None), (None, rows[9][1], 3, 0, 0, None), (2000, [0.0] * dims, None, 0, 0, None)]
    odd = [None, [], [1.0], [None] * dims, [float("nan")] + [0.0] * (dims - 1), [float("inf")] + [0.0] * (dims - 1), [0.5] * (dims + 1)]
    rows += [(3000 + i, v, 1, 0, 0, None) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def kept(df, dims, scale):
    p = df.toPandas()
    fine = p.embedding.map(lambda v: v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v))
    p = p[fine].reset_index(drop=True)
    p["x"] = p.embedding.map(lambda v: tuple(int(np.floor(scale * c)) for c in v))
    return p


def plain_nearest(x, words):
    d = ((x[:, None] - words[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def plain_update(x, words, near):
    out = words.copy()
    for c in set(near.tolist()):
        own = x[near == c]
        out[c] = [int(s) // len(own) for s in own.sum(0)]
    return out


def test_partial_distances_find_the_nearest_of_ties():
    from weftlink.llm.centroids import in_slices

    rng = np.random.default_rng(1)
    for d, k in ((1, 1), (8, 5), (11, 40), (64, 16)):
        x, c = rng.integers(-3, 4, (700, d)), rng.integers(-3, 4, (k, d))
        got = in_slices(x, c, rng.permutation(d))
        for a, b in zip(got, plain_nearest(x, c)):
            assert (a == b).all()


def test_centroid_clusters(spark):
    from weftlink.llm.centroids import centroid_clusters

    df = vectors(spark)
    p = kept(df, 64, 64)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(range(len(p)), key=lambda i: (p.vec_id[i] != p.vec_id[i], sha(f"1:{int(p.vec_id[i])}") if p.vec_id[i] == p.vec_id[i] else "", p.x[i]))
    x = np.array(p.x.tolist())
    words = x[order[:16]]
    for _ in range(3):
        words = plain_update(x, words, plain_nearest(x, words)[0])
    near, dist = plain_nearest(x, words)
    want = sorted((-1 if v != v else int(v), int(c), int(d), int(dist[near == c].sum()), int(dist.sum()), sha(",".join(map(str, words[c])))) for v, c, d in zip(p.vec_id, near, dist))
    got = centroid_clusters(df).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_few_or_no_vectors_to_cluster(spark):
    from weftlink.llm.centroids import centroid_clusters

    df = vectors(spark)
    assert centroid_clusters(df.limit(0)).count() == 0 and centroid_clusters(df.where("vec_id >= 3000")).count() == 0
    got = centroid_clusters(df.where("vec_id in (1000, 1001, 1002)")).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 3
    wide = spark.createDataFrame([(1, [1e9] * 64, 1, 1, 1, "")], VECTORS)
    with pytest.raises(ValueError, match="64 bits"):
        centroid_clusters(wide)


def plain_codes(p, parts, k, rounds):
    x = np.array(p.x.tolist())
    w = x.shape[1] // parts
    order = sorted(range(len(p)), key=lambda i: (p.vec_id[i] != p.vec_id[i], p.vec_id[i] if p.vec_id[i] == p.vec_id[i] else 0, p.x[i]))[:k]
    codes, error, books = [], 0, []
    for j in range(parts):
        part = x[:, j * w : (j + 1) * w]
        words = part[order]
        for _ in range(rounds):
            words = plain_update(part, words, plain_nearest(part, words)[0])
        near, d = plain_nearest(part, words)
        codes.append(near)
        error = error + d
        books.append(words)
    return np.stack(codes, 1), error, hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]))).encode()).hexdigest()


@pytest.mark.parametrize(("dims", "parts", "k", "rounds"), [(64, 16, 64, 2), (12, 3, 7, 6), (16, 16, 64, 0)])
def test_vector_codes(spark, dims, parts, k, rounds):
    from weftlink.llm.code_compression import vector_codes

    df = vectors(spark, dims)
    p = kept(df, dims, 256)
    code, error, digest = plain_codes(p, parts, k, rounds)
    label = p.label.map(lambda v: -1 if v is None or v != v else int(v)).to_numpy()
    want = sorted((-1 if v != v else int(v), bytes(c.astype(np.uint8)).hex(), int(e), int(error[label == own].sum()), digest) for v, c, e, own in zip(p.vec_id, code, error, label))
    got = vector_codes(df, parts, k, rounds).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_bounds_spare_most_groups():
    """Later rounds scan a part of the distances and still find every nearest entry and every tie."""
    from weftlink.llm.code_compression import grouped, moved, reassign

    rng = np.random.default_rng(4)
    heads = rng.integers(-400, 400, (64, 4))
    x = heads[rng.integers(0, 64, 3000)] + rng.integers(-12, 13, (3000, 4))
    words = heads + rng.integers(-30, 31, heads.shape)
    group = grouped(words)
    now, lower = np.zeros(len(x), np.intp), np.full((len(x), group.max() + 1), -np.inf, np.float32)
    now, _, lower, full = reassign(x, words, group, now, lower)
    for turn in range(4):
        new = plain_update(x, words, now)
        now, dist, lower, made = reassign(x, new, group, now, moved(lower, words, new, group))
        want = plain_nearest(x, new)
        assert (now == want[0]).all() and (dist == want[1]).all()
        words = new
    assert made < full / 4


def test_no_vectors_to_code(spark):
    from weftlink.llm.code_compression import vector_codes

    df = vectors(spark)
    assert vector_codes(df.limit(0)).count() == 0 and vector_codes(df.where("vec_id in (3000, 3001, 3002)")).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes(spark.createDataFrame([(1, [1e9] * 64, 1, 1, 1, "")], VECTORS))
    with pytest.raises(ValueError):
        vector_codes(df, k=257)
