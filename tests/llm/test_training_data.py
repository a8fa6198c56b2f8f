"""Operators of the training-data package against brute force, round trips and odd rows."""

import collections
import itertools
import json
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "dor fen gal hix jum pel qua ros tin wes".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Odd rows: null, empty, repeated, long, ties, copies and near copies."""
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, int(rng.integers(5, 200))) + "\n" + prose(rng, 30), "en" if i % 3 else "de", f"s{i % 4}", 0) for i in range(60)]
    words = prose(rng, 120).split(" ")
    near = lambda k: " ".join(words[:k] + ["changed"] + words[k + 1 :])
    rows += [(100, " ".join(words), "en", "s1", 1), (101, near(60), "en", "s1", 1), (102, near(20), "en", None, 1), (103, " ".join(words), "en", "s2", 1), (104, " ".join(words), "en", "s2", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "  \n ", "en", "s1", 0), (203, "12 34", None, "s1", 0), (204, prose(rng, 9000), "en", "s3", 0), (None, "lone", "en", "s1", 0)]
    rows += [(1, rows[1][1], "en", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("bin", F.lit(0))


def test_staging_uses_the_folder_of_the_session(spark):
    from weftlink.llm.common import shared_dir, staged

    assert staged(spark.range(3), "x").inputFiles()[0].startswith(shared_dir(spark))


def test_components(spark):
    from weftlink.llm.common import connected_components

    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    top = {}

    def head(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = head(a), head(b)
            top[max(p, q)] = min(p, q)
    assert got == {n: head(n) for n in top}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_takes_what_its_targets_say(spark, corpus):
    from weftlink.llm.mixing import apply_mix, mix

    got = mix(corpus).toPandas()
    assert len(got) == corpus.count()
    per = got.assign(taken=got["size"] * got.copies).groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert per.target.sum() == pytest.approx(per["size"].sum())
    assert (per.target <= 3 * per["size"] + 1e-9).all() and got.copies.max() <= 3
    assert ((per.taken - per.target).abs() <= per.most).all()
    again = mix(corpus).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert got.sort_values(key)[key].fillna(-1).values.tolist() == again.sort_values(key)[key].fillna(-1).values.tolist()
    out = apply_mix(corpus)
    assert out.columns == corpus.columns
    assert mix(corpus.limit(0)).count() == 0


def test_mix_of_rows_without_an_id(spark):
    from weftlink.llm.mixing import apply_mix, mix

    rng = np.random.default_rng(41)
    rows = [(None if i < 400 else 7 if i < 700 else i, prose(rng, int(rng.integers(1, 40))) if i % 9 else "twice over", "x", "a" if i < 400 else "b" if i < 700 else "c", i) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("nth", F.lit(1)).withColumn("copies", F.lit("clash")).withColumn("own__x", F.lit(2))
    got = mix(df).toPandas()
    per = got.assign(taken=got["size"] * got.copies).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert len(got) == 1000 and ((per.taken - per.target).abs() <= per.most).all() and (got.copies <= 3).all()
    out = apply_mix(df)
    kept = out.toPandas()
    assert out.columns == df.columns and kept.text.map(lambda t: len(t.split())).sum() == per.taken.sum()
    again = apply_mix(df.repartition(7)).toPandas()
    assert sorted(kept.astype(str).values.tolist()) == sorted(again.astype(str).values.tolist())


def test_budgets_nest(spark, corpus):
    from weftlink.llm.mixing import mix

    a, b = (mix(corpus, share=s, cap=1.0).select("doc_id", "source", F.col("copies").alias(f"c{i}")) for i, s in enumerate((0.3, 0.6)))
    joined = a.join(b, a.doc_id.eqNullSafe(b.doc_id) & a.source.eqNullSafe(b.source))
    assert joined.where("c0 > c1").count() == 0


def test_bit_packing_round_trip():
    from weftlink.llm.token_store import bits_needed, pack, unpack

    assert [bits_needed(n) for n in (2, 256, 257, 50257, 65537)] == [1, 8, 9, 16, 17]
    rng = np.random.default_rng(0)
    for bits in (1, 7, 8, 13, 16, 17, 24, 32):
        ids = rng.integers(0, 1 << bits, 5000, dtype=np.uint64).astype(np.uint32)
        data = pack(ids, bits)
        assert len(data) == -(-5000 * bits // 8) and (unpack(data, 5000, bits) == ids).all()


@pytest.mark.parametrize("vocab", [50_257, 100_000])
def test_token_files_round_trip(spark, corpus, vocab):
    import public_tokenizers
    from tokenizers import Tokenizer

    from weftlink.llm.token_store import ShardReader, read_tokens, write_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest, root = write_tokens(corpus, path, vocab)
    got = read_tokens(manifest, root).toPandas().sort_values("start")
    t = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text or "") for r in corpus.collect()]
    want = sorted((-1 if i is None else i, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for (i, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False), strict=True))
    assert sorted(zip(got["id"].fillna(-1).astype(int), got.n_tokens, got.ids_crc32, strict=True)) == want
    assert got["id"].fillna(-1).is_monotonic_increasing and (got.start.to_numpy() == np.cumsum(got.n_tokens) - got.n_tokens).all()
    first = manifest.orderBy("part", "seq").first()
    r = ShardReader(root, first.shard)
    whole = r.ids(0, r.n_ids)
    assert (np.concatenate([r.document(i) for i in range(r.n_docs)]) == whole).all() and (r.ids(3, 5) == whole[3:5]).all()
    empty, root = write_tokens(corpus.limit(0), path)
    assert read_tokens(empty, root).count() == 0


def test_encoder_equals_the_library_on_odd_texts():
    import public_tokenizers

    from weftlink.llm.token_store import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for x in ("", " ", "a  b", "x \n y", "x\n\ny z", "it's, we'll ", "don't've", "ça où! Ünï-cödé", "漢字 ٣٤ ½ ² x", " ,", "tab\tz a", "<|endoftext|> z", "é x y", "1a a1 a,b", "end\n", "\nstart a"):
        assert e.encode(x).tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_encoder_takes_many_lines_without_blanks():
    import public_tokenizers

    from weftlink.llm.token_store import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pool = [*WORDS, "漢字", "a1", "x,", "12", "ça"]
    lines = "\n".join(pool[i * 7 % len(pool)] for i in range(5000))
    for x in (lines, "start " + lines + " end", lines + "\n", lines + "\n\n" + lines, lines + "\n\tz\n" + lines):
        assert e.encode(x).tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_language_id_on_held_out_documents(spark):
    from weftlink.llm.language_id import fit, held_out, identify, keep_known

    rng = np.random.default_rng(1)
    kinds = {"aa": "the and ing tion with was".split(), "bb": "der und sch ung nicht ein".split()}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 2)) for _ in range(60)), k, "s", 0) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", "s", 0), (901, "12 !?", "bb", "s", 0), (902, "", None, "s", 0), (903, "der " * 30000, None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = fit(df)
    got = identify(df, p).join(df.select("doc_id", "lang", held_out(F.col("doc_id")).alias("h")), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got if r.h and r.doc_id < 900)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id >= 900}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0) and odd[903][0] == "bb" and all(0 <= r.score <= 1 for r in got)
    assert keep_known(df, p).count() == len(rows) - 3 and identify(df.limit(0), p).count() == 0
    assert identify(df, fit(df.where("lang is null"))).where("lang_pred <> 'und'").count() == 0


def gram_code(gram):
    """The 32-bit number that stands for a gram, by which ties between grams go."""
    n = (ord(gram[0]) + 1) * 0x9E3779B1 % (1 << 32)
    for c, salt, factor in zip(gram[1:], (0x55555555, 0x33333333), (0x85EBCA6B, 0xC2B2AE35), strict=False):
        n = ((n ^ salt) * factor + ord(c)) % (1 << 32)
    return n


def gram_table(text):
    """Counts of the 1- to 3-grams of a text, one string at a time."""
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = s.split()
    s = " " + " ".join(words) + " " if words else ""
    grams = collections.Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    return collections.Counter({g: k for g, k in grams.items() if g.strip() and not (len(g) == 3 and g[1] == " ")})


def ranked_grams(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], gram_code(x[0])))[:size]]


def language_truth(profiles, text, size):
    """(language, score) by out-of-place distances, one gram at a time."""
    grams = ranked_grams(gram_table(text), size)
    if not grams or not profiles:
        return "und", 0.0
    sums = {name: sum(abs(i - ranks[g]) if g in ranks else size for i, g in enumerate(grams)) for name, ranks in profiles.items()}
    best = min(sorted(sums), key=lambda k: sums[k])
    return best, 1 - sums[best] / (size * len(grams))


def profile_truth(rows, size):
    """Profiles of (id, text, lang) rows that are not held out."""
    sums = {}
    for i, text, lang in rows:
        if lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            sums.setdefault(lang, collections.Counter()).update(gram_table(text))
    return {k: {g: n for n, g in enumerate(ranked_grams(v, size))} for k, v in sums.items()}


@pytest.mark.parametrize("size", [400, 12])
def test_language_id_against_counters(spark, corpus, size):
    from weftlink.llm.language_id import fit, identify

    more = [(300, "été où ça Œuvre", "fr", "s", 0), (301, "été où ça Œuvre", "fr", "s", 0), (301, "été où ça Œuvre", "fr", "s", 0), (302, "ab ba", "xx", "s", 0), (303, "ab ba", "yy", "s", 0), (304, "ab", None, "s", 0)]
    more += [(305, "İstanbul ΑΣ ß 漢字 a1b", "zz", "s", 0), (306, "don't — x_y", "zz", "s", 0), (307, None, "zz", "s", 0)]
    df = corpus.select(*SCHEMA_COLS).union(spark.createDataFrame(more, SCHEMA)).withColumn("id", F.lit("clash")).withColumn("score", F.lit(-1.0)).withColumn("code", F.lit(0))
    rows = df.collect()
    profiles = profile_truth([(r.doc_id, r.text, r.lang) for r in rows], size)
    want = [(r.doc_id is None, r.doc_id or 0, *language_truth(profiles, r.text, size)) for r in rows]
    got = [(r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in identify(df, fit(df, size=size)).collect()]
    key = lambda r: (*r[:3], round(r[3], 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and {"xx", "und", "fr"} <= {r[2] for r in got}


def vectors(rng, n, d=16):
    return rng.normal(size=(n, d))


def test_additive_search_recall_and_exact_scores(spark):
    from weftlink.llm.aq_search import search

    x = vectors(np.random.default_rng(3), 1500)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0, 2.0]), (7, x[7].tolist())]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=20).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(part.id))
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, s[part.id]) and part.score.is_monotonic_decreasing
    assert set(got.query_id) == set(range(0, 1500, 20)) and hit / (75 * 20) >= 0.9
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert search(few, F.col("id") % 20 == 0).count() == 4
    assert search(few.limit(0), F.col("id") % 20 == 0).count() == 0


def test_additive_search_recall_in_a_table_far_larger_than_the_shortlist(spark):
    from weftlink.llm.aq_search import search

    x = vectors(np.random.default_rng(61), 20_000, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<double>")
    got = search(df, F.col("id") % 500 == 0, k=20).toPandas().groupby("query_id").id.apply(set)
    hit = 0
    for q in range(0, len(x), 500):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & got[q])
    assert hit / (20 * len(got)) >= 0.95 and len(got) == 40


def test_additive_search_among_many_copies_takes_the_smallest_ids(spark):
    from weftlink.llm.aq_search import search

    rng = np.random.default_rng(14)
    x = np.concatenate([np.repeat(3 * vectors(rng, 1), 900, 0), np.repeat(2 * vectors(rng, 1), 300, 0), vectors(rng, 500)])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = search(df, F.col("id") % 20 == 0, k=20).toPandas()
    same, hit = np.unique(x, axis=0, return_inverse=True)[1].ravel(), 0
    for q in range(0, len(x), 20):
        part = got[got.query_id == q].sort_values("rank")
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        hit += len(set(want) & set(part.id))
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, s[part.id])
        if (same == same[q]).sum() > 20:
            assert part.id.tolist() == want.tolist()
    assert got.query_id.nunique() == 85 and hit / (85 * 20) >= 0.95


def test_search_in_many_blocks_with_ties_and_clashing_columns(spark, monkeypatch):
    from weftlink.llm import aq_search as a

    rng = np.random.default_rng(51)
    x = np.round(vectors(rng, 700, 8) * 2) / 2  # many equal scores
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (40, (x[40] + 9).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("qb", F.lit(0)).withColumn("score", F.lit(0.0))
    one = sorted(map(tuple, a.search(df, F.col("id") % 20 == 0, k=10).collect()))
    monkeypatch.setattr(a, "ROW_BLOCK", 40)
    monkeypatch.setattr(a, "MERGE", 3)
    many = sorted(map(tuple, a.search(df, F.col("id") % 20 == 0, k=10).collect()))
    # Row 700 repeats id 40: it is a query and a candidate of its own.
    full, ids = np.vstack([x, x[40] + 9]), np.array([*range(700), 40])
    lists = {}
    for r in many:
        lists.setdefault((r[0], r[4]), []).append((r[1], r[2], r[3]))
    hit, at_40 = 0, sorted(key for key in lists if key[0] == 40)
    assert len(at_40) == 2
    for q in [*range(0, 700, 20), 700]:
        s = full @ full[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:10]
        rows = [lists[k] for k in lists if k[0] == ids[q]]
        hit += max(len(set(ids[want]) & {i for _, i, _ in r}) for r in rows)
        assert any(sorted(r)[0][2] == s[want[0]] for r in rows)
    assert hit / 360 >= 0.95 and len(one) == len(many) == 360 and {r[0] for r in many} == set(range(0, 700, 20))
    assert all(p[:2] == q[:2] and abs(p[3] - q[3]) < 1e-9 for p, q in zip(sorted(one, key=lambda r: (r[0], r[4], r[1])), sorted(many, key=lambda r: (r[0], r[4], r[1])), strict=True) if p[2] == q[2])


def test_search_among_vectors_of_several_lengths(spark):
    from weftlink.llm.aq_search import search

    rng = np.random.default_rng(52)
    sets = [vectors(rng, 600, 16), vectors(rng, 500, 8), vectors(rng, 30, 4), vectors(rng, 1, 2)]
    rows = [v.tolist() for part in sets for v in part]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    got = search(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=20).toPandas()
    hit = total = 0
    for q in range(0, len(rows), 20):
        part = got[got.query_id == q].sort_values("rank")
        s = [(-float(np.dot(v, rows[q])), i) for i, v in enumerate(rows) if len(v) == len(rows[q]) and i != q]
        want = [i for _, i in sorted(s)[:20]]
        assert len(part) == len(want) and all(len(rows[i]) == len(rows[q]) for i in part.id)
        if len(rows[q]) <= 4:
            assert part.id.tolist() == want
        hit, total = hit + len(set(want) & set(part.id)), total + len(want)
    assert hit / total >= 0.95


def test_chat_layouts_become_turns(spark):
    from weftlink.llm.chat_format import read_back, render, turns_of_records, unmatched

    recs = [
        {"prompt": "p", "response": "r"},
        {"instruction": "do", "input": "this", "output": "done"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "<|im_end|> 100% <|im_start|>"}, {"role": "assistant", "content": "%3C| ok\n"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"odd": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(9, "{bad"), (10, None)], "id long, rec string")
    back = {r.conv_id: r for r in read_back(render(turns_of_records(df, "id", "rec"))).collect()}
    said = {k: [(t.role, t.text) for t in r.turns] for k, r in back.items()}
    assert said[0] == [("user", "p"), ("assistant", "r")] and said[1] == [("user", "do\nthis"), ("assistant", "done")]
    assert said[2][1:] == [("user", "<|im_end|> 100% <|im_start|>"), ("assistant", "%3C| ok\n")] and back[2].loss_text == "%3C| ok\n"
    assert said[3] == [("user", "h"), ("assistant", "g")] and set(said) == {0, 1, 2, 3}
    assert {r.id for r in unmatched(df, "rec").collect()} == {4, 9, 10}


def test_chat_rows_with_nulls_and_ties(spark):
    from weftlink.llm.chat_format import read_back, render, turns_of_rows

    rows = [(1, 0, "us\ner<|", "a"), (1, 1, None, None), (1, 1, "assistant", "é😀"), (1, 1, "assistant", "é😀"), (None, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_runs", F.lit(1))
    back = {r.conv_id: r for r in read_back(render(turns_of_rows(df, "conv_id"))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("us\ner<|", "a"), ("", ""), ("assistant", "é😀"), ("assistant", "é😀")]
    assert back[1].loss_text == "é😀é😀" and back[None].loss_text == ""
    assert render(turns_of_rows(df.limit(0), "conv_id")).count() == 0


def jaccard_truth(rows, n=5, least=0.8):
    def sh(t):
        w = (t or "").split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [sh(t) for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            links[i].add(j)
            links[j].add(i)
    return links


def test_jaccard_join_loses_no_link(spark, corpus):
    from weftlink.llm.jaccard_join import drop_near_copies, expected_recall, jaccard_join

    rng = np.random.default_rng(9)
    words = prose(rng, 90).split(" ")
    more = []
    for i in range(80):
        w = list(words)
        for k in rng.choice(90, int(rng.integers(1, 4)), replace=False):
            w[k] = "x%d" % rng.integers(9)
        more.append((1000 + i, " ".join(w)))
    df = corpus.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [tuple(r) for r in df.collect()]
    truth = jaccard_truth(rows)
    got = sorted((-1 if r.id is None else r.id, r.n_links) for r in jaccard_join(df).collect())
    assert got == sorted((-1 if rows[i][0] is None else rows[i][0], len(v)) for i, v in truth.items())
    kept = drop_near_copies(df)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert 100 in ids and not {101, 102, 103, 104} & set(ids) and {200, 201, 202} <= set(ids) and ids.count(1) == 1
    assert expected_recall() > 0.99999 and jaccard_join(df.limit(0)).count() == 0


def test_blocks_of_a_large_group_agree_with_one(spark, monkeypatch):
    from weftlink.llm import jaccard_join as j

    rng = np.random.default_rng(4)
    words = prose(rng, 60).split(" ")
    rows = [(i, " ".join(words[:i] + ["new"] + words[i + 1 :])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(tuple(r) for r in j.jaccard_join(df).collect())
    monkeypatch.setattr(j, "BLOCK_SHINGLES", 400)
    assert sorted(tuple(r) for r in j.jaccard_join(df).collect()) == one
    assert sum(r[2] for r in one) == sum(map(len, jaccard_truth(rows).values()))


def test_near_copies_are_found_among_many_texts_that_share_a_passage(spark):
    from weftlink.llm.jaccard_join import jaccard_join

    rng = np.random.default_rng(12)
    passage = prose(rng, 120)
    rows = [(i, passage + " " + prose(rng, 100)) for i in range(400)]
    for i in range(0, 400, 20):
        words = rows[i][1].split(" ")
        words[int(rng.integers(130, 210))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    # Ids are dealt anew, so copies do not stand next to each other by id.
    rows = [(int(k), t) for k, (_, t) in zip(rng.permutation(len(rows)), rows, strict=True)]
    truth = jaccard_truth(rows)
    got = sorted((r.id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((rows[i][0], len(v)) for i, v in truth.items()) and sum(n for _, n in got) >= 40


def test_a_template_forms_no_group_and_hot_nodes_lose_no_link(spark, monkeypatch):
    from weftlink.llm import jaccard_join as j

    rng = np.random.default_rng(23)
    template = prose(rng, 150).split(" ")
    rows = [(i, " ".join(template + prose(rng, 45).split(" "))) for i in range(600)]
    # Some texts of the template have one near copy each, at unlike distances from the threshold.
    for i in range(0, 600, 6):
        w = rows[i][1].split(" ")
        for at in rng.choice(np.arange(151, 194), int(rng.integers(1, 6)), replace=False):
            w[at] = "x%d" % rng.integers(99)
        rows.append((5000 + i, " ".join(w)))
    rows = [(int(k), t) for k, (_, t) in zip(rng.permutation(len(rows)), rows, strict=True)]
    monkeypatch.setattr(j, "NODE_BLOCK", 200)  # nodes of many blocks
    truth = jaccard_truth(rows)
    assert max(map(len, truth.values())) <= 3 and sum(map(len, truth.values())) >= 100
    got = {r.id: r for r in j.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, links in truth.items():
        ids = {rows[i][0]} | {rows[k][0] for k in links}
        assert got[rows[i][0]].n_links == len(links)
        assert links or got[rows[i][0]].group_id == rows[i][0]
        assert got[rows[i][0]].group_id == min(got[k].group_id for k in ids)


def test_documents_that_share_an_id_but_not_the_text(spark):
    from weftlink.llm.jaccard_join import drop_near_copies, jaccard_join

    rng = np.random.default_rng(31)
    a, b = prose(rng, 80).split(" "), prose(rng, 80)
    rows = [(1, " ".join(a)), (1, b), (2, " ".join(a[:40] + ["new"] + a[41:])), (None, " ".join(a[:20] + ["new"] + a[21:])), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(1)).withColumn("tkey", F.lit(1)).withColumn("family", F.lit("x"))
    got = sorted((r.id is None, r.id or 0, r.n_links, r.kept) for r in jaccard_join(df).collect())
    # One changed word leaves 71 of 81 shingles common, two leave 66 of 86.
    assert got == [(False, 1, 0, True), (False, 1, 2, False), (False, 2, 1, False), (False, 3, 0, True), (True, 0, 0, True), (True, 0, 1, True)]
    assert sorted(str(r.text)[:20] for r in drop_near_copies(df).collect()) == sorted(str(t)[:20] for t in (b, rows[3][1], None, ""))


def brute_pack(packed, capacity, max_sources):
    for _, part in packed.groupby(["shard", "bin"]):
        assert part.n_words.sum() <= capacity and part.source.nunique(dropna=False) <= max(max_sources, 1)


def test_packing_keeps_its_rules(spark, corpus):
    from weftlink.llm.common import text_key, word_count
    from weftlink.llm.packing import BestFit, pack, pack_shard

    sized = corpus.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.when(F.length("text") > 0, text_key(F.col("text"))).alias("cluster"))
    got = pack(sized, "doc_id", "words", "source", "cluster", 300, 2).toPandas()
    brute_pack(got, 300, 2)
    want = sized.toPandas().groupby("doc_id", dropna=False).words.sum()
    assert got.groupby("doc_id", dropna=False).n_words.sum().to_dict().items() >= {k: v for k, v in want.to_dict().items() if k == k}.items()
    copies = got[got.doc_id.isin([100, 103, 104])]
    assert len(copies.groupby(["shard", "bin"])) == len(copies)
    assert pack(sized.limit(0), "doc_id", "words", "source", "cluster").count() == 0
    # The tightest compatible bin, found by looking at all of them.
    rng = np.random.default_rng(8)
    sizes, sources, clusters = rng.integers(1, 60, 400).tolist(), rng.integers(0, 5, 400).tolist(), [None if c > 20 else bytes([c]) for c in rng.integers(0, 60, 400)]
    made = sorted(pack_shard(sizes, sources, clusters, 100, 3), key=lambda m: (-m[3], clusters[m[0]] or b"", 1 << list(dict.fromkeys(sources)).index(sources[m[0]]), m[0]))
    left, held, have = {}, {}, {}
    for i, _, b, n in made:
        ok = [k for k in left if left[k] >= n and clusters[i] not in held[k] - {None} and len(have[k] | {sources[i]}) <= 3]
        tight = min((left[k] for k in ok), default=None)
        assert (b not in left) == (tight is None) and (tight is None or left[b] == tight)
        left[b], held[b], have[b] = left.get(b, 100) - n, held.get(b, set()) | {clusters[i]}, have.get(b, set()) | {sources[i]}
    assert BestFit(10, 1).successor(0) == -1


@pytest.mark.parametrize("rule", ["start", "end", "most", "share"])
def test_token_counts_add_up(spark, corpus, rule):
    import public_tokenizers

    from weftlink.llm.token_attribution import attribute, vocabulary

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    more = spark.createDataFrame([(700, "é😀 naïve\n\n\nünï\n", "x", "s", 0)], SCHEMA)
    df = corpus.select(*SCHEMA_COLS).union(more).where("doc_id is not null and doc_id <> 1")
    got = attribute(df, path, rule).toPandas().groupby("doc_id").agg(n=("n_tokens", "sum"), c=("n_chars", "sum"))
    enc, _ = vocabulary(path)
    for r in df.collect():
        assert got.n[r.doc_id] == pytest.approx(len(enc.encode_ordinary(r.text or ""))) and got.c[r.doc_id] == len(r.text or "")
    assert attribute(df.limit(0), path).count() == 0


SCHEMA_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def token_truth(text, enc, rule):
    """(section, characters, tokens, crossing) of every line, one token at a time."""
    if not text:
        return [(0, 0, 0.0, 0)]
    lines = [x for x in text.split("\n")]
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    own = [k for k, line in enumerate(lines) for _ in line]  # of each character
    of_byte = [i for i, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")]
    out, at = [[k, len(line), 0.0, 0] for k, line in enumerate(lines)], 0
    for t in enc.encode_ordinary(text):
        n = len(enc.decode_single_token_bytes(t))
        chars = range(of_byte[at], of_byte[at + n - 1] + 1)
        at += n
        held = collections.Counter(own[i] for i in chars)
        first, last = own[chars[0]], own[chars[-1]]
        out[first][3] += first != last
        if rule == "share":
            for k, m in held.items():
                out[k][2] += m / len(chars)
        else:
            out[{"start": first, "end": last, "most": min(held, key=lambda k: (-held[k], k))}[rule]][2] += 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("rule", ["start", "end", "most", "share"])
def test_token_counts_against_single_tokens(spark, corpus, rule):
    import public_tokenizers

    from weftlink.llm.token_attribution import attribute, vocabulary

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    more = [(700, "é😀 naïve\n\n\nünï\n", "x", "s", 0), (701, "\n\n \n\t\n", "x", "s", 0), (702, "漢\n字\r\n a", "x", "s", 0), (703, "a\n\n\n\n\n\nb", "x", "s", 0), (None, None, "x", "s", 0), (None, "z\ny", "x", "s", 0), (703, "a\n\n\n\n\n\nb", "x", "s", 0)]
    df = corpus.select(*SCHEMA_COLS).union(spark.createDataFrame(more, SCHEMA)).withColumn("section", F.lit(7)).withColumn("id", F.lit("clash"))
    enc, _ = vocabulary(path)
    want = [(r.doc_id is None, r.doc_id or 0, *x) for r in df.collect() for x in token_truth(r.text, enc, rule)]
    got = [(r.doc_id is None, r.doc_id or 0, r.section, r.n_chars, r.n_tokens, r.n_crossing) for r in attribute(df, path, rule).collect()]
    key = lambda r: (*r[:4], round(r[4], 6), r[5])
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r[5] for r in got) > 0


def test_crossing_tokens_follow_their_rule():
    from weftlink.llm.token_attribution import allot

    s, e, edges = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert allot(s, e, edges, "start")[0].tolist() == [2, 1] and allot(s, e, edges, "end")[0].tolist() == [1, 2]
    assert allot(s, e, edges, "most")[0].tolist() == [1, 2] and allot(s, e, edges, "share")[0].tolist() == pytest.approx([1 + 1 / 3, 1 + 2 / 3])
    assert allot(s, e, edges, "share")[1].tolist() == [1, 0]


def test_projection_forest_against_all_pairs(spark):
    from weftlink.llm.rp_dedup import near_duplicates

    rng = np.random.default_rng(6)
    base = vectors(rng, 150, 24)
    x = np.concatenate([base, base[:60] + rng.normal(0, 0.12, (60, 24)), base[0] + rng.normal(0, 0.2, (300, 24)), np.repeat(base[3:4], 5, 0)])
    label = [int(k) for k in rng.integers(0, 3, len(x))]
    # Ids may repeat, with the same vector or another one.
    x, label = np.concatenate([x, x[2:3], base[7:8], x[5:6]]), [*label, label[2], 1, label[5]]
    ids = [*range(len(x) - 3), 2, 2, 40]
    rows = [(i, v.tolist(), k) for i, v, k in zip(ids, x, label, strict=True)]
    odd = [(9000, None, 1), (9001, [0.0] * 24, 1), (9002, [float("inf")] * 24, 1), (9003, base[0].tolist(), None), (9004, [1.0], 1), (9005, [None] * 24, 1), (9006, [], 1), (None, base[0].tolist(), label[0]), (None, base[0].tolist(), label[0]), (None, None, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(0)).withColumn("v", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("copies", F.lit(9))
    got = near_duplicates(df, leaf=64).collect()
    assert len(got) == len(rows) + len(odd)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(s, False)
    by_id = lambda pairs: {i: sorted(n for k, n in pairs if k == i) for i, _ in pairs}
    true, found = by_id([(i, int(n)) for i, n in zip(ids, s.sum(1), strict=True)]), by_id([(r.id, r.n_links) for r in got if r.id is not None and r.id < 9000])
    assert all(m <= n for i in true for m, n in zip(found[i], true[i], strict=True)) and sum(map(sum, found.values())) >= 0.97 * s.sum() > 0
    assert all(r.n_links == 0 and r.kept and r.component_id == r.id for r in got if r.id is None or r.id >= 9000)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_large_cells_are_split_level_by_level(spark, monkeypatch):
    from weftlink.llm import rp_dedup as r

    rng = np.random.default_rng(16)
    x = np.concatenate([(base := vectors(rng, 80, 24)), *[base + rng.normal(0, 0.05, base.shape) for _ in range(4)], np.repeat(base[:1], 300, 0)])
    rows = [(i, v.astype(np.float32).tolist(), "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.93
    monkeypatch.setattr(r, "CELL_ROWS", 60)
    got = {t.id: t for t in r.near_duplicates(df, leaf=40).collect()}
    found, true = sum(t.n_links for t in got.values()), int(s.sum()) - len(x)
    assert len(got) == len(x) and all(got[i].n_links <= s[i].sum() - 1 for i in range(len(x))) and found >= 0.97 * true
    assert all(got[i].component_id == 0 and got[i].n_links >= 300 for i in range(400, 700))
    # Vectors whose projections cannot be told apart are dealt by a hash, and every one keeps a cell.
    same = spark.createDataFrame([("a", 2, 0, 1, i, [1.0, 2.0]) for i in range(500)], "label string, d int, tree int, node long, id long, v array<float>")
    cells = r.split_again(same, 0.08)
    assert cells.select("id").distinct().count() == 500 and cells.groupBy("node").count().where("count > 60").count() == 0


def test_large_groups_of_near_copies_keep_their_links(spark):
    from weftlink.llm.rp_dedup import near_duplicates

    rng = np.random.default_rng(21)
    centre = rng.normal(size=24)
    tight, loose = centre + rng.normal(0, 0.15, (2500, 24)), -centre + rng.normal(0, 0.3, (1500, 24))
    x = np.concatenate([vectors(rng, 500, 24), tight, loose, np.repeat(tight[:1], 4, 0)])
    x = x[rng.permutation(len(x))]
    label = rng.integers(0, 4, len(x)) // 3  # three quarters hold one label
    rows = [(i, v.tolist(), str(label[i])) for i, v in enumerate(x)]
    got = {r.id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    assert all(got[i].n_links <= s[i].sum() for i in range(len(x)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.999 * s.sum() > 1_000_000


@pytest.mark.parametrize("scale", [1, 100])
def test_dense_groups_of_many_sizes_keep_their_links(spark, monkeypatch, scale):
    """With constants scaled down, cells are split level by level and large leaves are compared block by block."""
    from weftlink.llm import rp_dedup as r

    if scale > 1:
        for name in ("FIT_ROWS", "CELL_ROWS", "UPPER_ROWS"):
            monkeypatch.setattr(r, name, max(getattr(r, name) // scale, 400 if name == "CELL_ROWS" else 40))
        monkeypatch.setattr(r, "BLOCK", 300)
        monkeypatch.setattr(r, "COMMON", 3)
    else:
        monkeypatch.setattr(r, "UPPER_ROWS", 1000)
    rng = np.random.default_rng(23)
    groups = [c + rng.normal(0, 0.2, (n, 24)) for n, c in zip((150, 400, 900, 1800), rng.normal(size=(4, 24)), strict=True)]
    x = np.concatenate([vectors(rng, 3000, 24), *groups])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    got = {t.id: t for t in r.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), leaf=128).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T >= 0.93
    np.fill_diagonal(s, False)
    assert len(got) == len(x) and all(got[i].n_links <= s[i].sum() for i in range(len(x)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * s.sum() > 1_000_000


def test_a_pair_counts_once_over_leaves_that_compare_it():
    from weftlink.llm import rp_dedup as r

    v = np.eye(4)[[0, 0, 0, 0]] + 0.01 * np.eye(4)
    # Leaf 2 compares rows 0 and 1 only with 0 (its core); leaf 4 holds all, row 3 as no core.
    keys = [[3, 5], [2, 5], [2, 5], [4]]
    part = pd.DataFrame({"id": range(4), "v": list(v), "copies": 1, "leaves": keys, "leaf": 4, "key": [5, 5, 5, 4], "block": 0, "x": 0, "y": 0})
    got = r.leaf_links(part, 0.9)
    counts = got[got.n.notna()].set_index("a").n.to_dict()
    # 0-1 and 0-2 count in leaf 2; 1-2, and 3 with each, count here.
    assert counts == {0: 1, 1: 2, 2: 2, 3: 3}


def line_truth(rows, least):
    """Longest previous match of every start, by comparing all pairs of starts."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, zkey(r[1])))
    seqs = [[(p, line) for p, line in enumerate(t.split("\n")) if any(c not in " \t\n\x0b\x0c\r" for c in line)] for _, t in docs]
    starts = [(d, k) for d, s in enumerate(seqs) for k in range(len(s))]
    gone = {d: set() for d in range(len(docs))}
    for a, (d, k) in enumerate(starts):
        for e, m in starts[:a]:
            n = 0
            while k + n < len(seqs[d]) and m + n < len(seqs[e]) and seqs[d][k + n][1] == seqs[e][m + n][1]:
                n += 1
            if sum(len(line.split()) for _, line in seqs[d][k : k + n]) >= least:
                gone[d] |= set(range(seqs[d][k][0], seqs[d][k + n - 1][0] + 1))
    return {docs[d]: g for d, g in gone.items()}


def zkey(text):
    import hashlib

    return hashlib.md5(("t" + text).encode()).digest()


@pytest.mark.parametrize("least", [1, 6, 20])
def test_line_dedup_deletes_exactly_later_copies(spark, least):
    from weftlink.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(least)
    pool = [" ".join(rng.choice(WORDS, int(rng.integers(1, 9)))) for _ in range(12)] + ["", " "]
    rows = [(int(i), "\n".join(rng.choice(pool, int(rng.integers(1, 14))))) for i in range(40)] + [(None, pool[0]), (50, None), (51, ""), (3, "\n".join(pool[:9])), (52, "\n".join(pool[:9])), (52, "\n".join(pool[:9]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(0)).withColumn("gone", F.lit("x"))
    truth = line_truth(rows, least)
    worded = lambda lines: [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    seen = set()
    for r in dedup_lines(df, min_words=least).collect():
        texts = [t for i, t in rows if i == r.doc_id]
        if len(set(texts)) > 1:
            continue
        t, g = texts[0], truth.get((r.doc_id, texts[0]), set())
        seen.add(r.doc_id)
        if t is None or not g:
            assert r.text == t and r.n_deleted == 0
        else:
            assert worded(r.text.split("\n")) == worded(line for p, line in enumerate(t.split("\n")) if p not in g)
            assert r.text == "" or r.text.count("\n") + 1 == r.n_lines - r.n_deleted
    assert len(seen) > 40
    assert dedup_lines(df.limit(0)).count() == 0


def mix_truth(rows):
    """Copies of (id, text, source) rows: each source's rows in order of their hash, as far as its budget goes."""
    import hashlib

    size = lambda t: len([w for w in re.split("[\\x20\\x09-\\x0D]+", t or "") if w])
    nth, marked = collections.Counter(), []
    for i, text, source in rows:
        nth[i, text, source] += 1
        tkey = hashlib.md5((b"t" + text.encode()) if text is not None else b"").hexdigest()
        name = f"{'' if i is None else i}|{tkey}|{nth[i, text, source]}"
        marked.append((source, int(hashlib.md5(name.encode()).hexdigest()[:15], 16), size(text), (i, text, source)))
    sizes = collections.Counter()
    for source, _, n, _ in marked:
        sizes[source] += n
    names = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    weight = {k: (5, 2, 1)[j % 3] for j, k in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if weight[k] * level >= 3 * sizes[k]]
        if not full:
            target |= {k: weight[k] * level for k in open_}
            break
        target |= {k: 3.0 * sizes[k] for k in full}
        left -= sum(target[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    out = []
    for source in names:
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, upto = target[source] - whole * sizes[source], 0
        for _, _, n, row in sorted((m for m in marked if m[0] == source), key=lambda m: m[1]):
            more = rest > 1e-9 and upto < rest and (upto + n < rest or upto + n - rest < rest - upto)
            upto += n
            out += [row] * (whole + more)
    return out


def fit_truth(rows, capacity=4096, most=8):
    """(id, words, bin) of pieces put one by one into the tightest compatible of all bins."""
    sizes = [len((t or "").split()) for _, t, _ in rows]
    order, sources, out, bins = [], {}, [], []
    for i, (_, text, source) in enumerate(rows):
        sources.setdefault(source, len(sources))
        full, rest = divmod(sizes[i], capacity)
        out += [(rows[i][0], capacity, f"full{i}.{k}") for k in range(full)]
        if rest or not full:
            order.append((-rest, zkey(text) if text else b"", sources[source], i))
    for at, (minus, cluster, source, i) in enumerate(sorted(order)):
        fits = [b for b in bins if b["left"] >= -minus and (not cluster or cluster not in b["held"]) and len(b["sources"] | {source}) <= most]
        b = min(fits, key=lambda b: (b["left"], -b["at"]), default=None)
        if b is None:
            b = {"left": capacity, "held": set(), "sources": set(), "name": f"bin{len(bins)}"}
            bins.append(b)
        b["left"] += minus
        b["held"].add(cluster)
        b["sources"].add(source)
        b["at"] = at
        out.append((rows[i][0], -minus, b["name"]))
    return out


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(77)
    shared = prose(rng, 60)
    docs = [(300 + i, prose(rng, int(rng.integers(30, 90))) + "\n" + shared + "\n" + prose(rng, 20), "en", f"s{i % 5}", 0) for i in range(12)]
    docs += [(400, "Привет мир как дела", None, "s1", 0), (401, "漢字だけのテキスト", None, "s2", 0)]
    corpus.select(*SCHEMA_COLS).union(spark.createDataFrame(docs, SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    profiles = profile_truth([r[:3] for r in rows], 400)
    known = [(i, t, s) for i, t, _, s in rows for lang, score in [language_truth(profiles, t, 400)] if lang != "und" and score >= 0.2]
    assert not {200, 201, 202, 203, 400, 401} & {i for i, _, _ in known}
    gone, unique = line_truth([r[:2] for r in known], 20), []
    for i, t, s in known:
        left = [x for p, x in enumerate(t.split("\n")) if p not in gone.get((i, t), ())]
        if any(x.strip(" \t\n\x0b\x0c\r") for x in left):
            unique.append((i, "\n".join(left) if gone.get((i, t)) else t, s))
    links, top = jaccard_truth([r[:2] for r in unique]), list(range(len(unique)))
    rank = lambda k: (unique[k][0] is not None, unique[k][0] or 0, zkey(unique[k][1]))
    same = collections.defaultdict(set)
    for k, r in enumerate(unique):
        same[r[1]].add(k)
    changed = True
    while changed:
        changed = False
        for k in range(len(unique)):
            best = min((top[j] for j in links[k] | same[unique[k][1]] | {k}), key=rank)
            changed, top[k] = changed or rank(best) < rank(top[k]), min(best, top[k], key=rank)
    unlike = list({(unique[k][0], unique[k][1]): unique[k] for k in range(len(unique)) if rank(top[k]) == rank(k)}.values())
    mixed = mix_truth(unlike)
    want = fit_truth(sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0)))
    got = [(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.n_words), f"{r.shard}.{r.bin}") for r in corpus_pipeline.run(spark, str(tmp_path)).toPandas().itertuples()]

    def bins(rows):
        held = collections.defaultdict(list)
        for i, n, b in rows:
            held[b].append((i is None, i or 0, n))
        return sorted(map(sorted, held.values()))

    assert bins(got) == bins(want) and len(got) > 40


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    corpus.select(*SCHEMA_COLS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
        if name == "language ID":
            assert not {200, 201, 202, 203} & set(ids) and {100, 204} <= set(ids)
        if name == "line dedup":
            assert not {103, 104} & set(ids) and {100, 101, 102} <= set(ids)
        if name == "n-gram Jaccard join":
            assert 100 in ids and not {101, 102} & set(ids) and len(ids) == len(set(ids))
            base = pd.Series({r.doc_id: len((r.text or "").split()) for r in docs.collect()})
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert got.n_words.sum() == sum(len((r.text or "").split()) for r in docs.collect()) and got.n_words.max() <= 4096
    for _, part in got.groupby(["shard", "bin"]):
        assert part.n_words.sum() <= 4096 and part.doc_id.is_unique
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, run.fillna(-1).astype(str).values)) == sorted(map(tuple, got.fillna(-1).astype(str).values)) and len(base)
