"""Texts that are one very long run of white space, or nearly so, and texts of a million words."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def path():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_long_runs_are_cut_where_the_rule_cuts():
    from weftlink.llm.token_attribution import encode, single_word, vocabulary

    enc, _ = vocabulary(path())
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["a", "word", "1", "!", "é", " " * rng.choice([1, 2, 999, 1000, 1001, 3000]), "\n" * rng.choice([1, 1000, 1500]), "\t  \x85" * rng.choice([1, 250, 400]), "\x1c", "​"]) for _ in range(rng.randint(1, 9)))
        assert encode(text, enc, single_word(path())) == enc.encode_ordinary(text)


def test_three_million_spaces_line_feeds_and_tabs(spark):
    from weftlink.llm.token_attribution import attribute

    n = 3_000_000
    rows = [(1, "a" + " " * n + "b"), (2, "\n" * 200_000 + "x"), (3, "\t" * n), (4, " " * n), (5, ("\r\n" * 50_000) + "end"), (6, "word " * 1_000_000)]
    got = attribute(spark.createDataFrame(rows, "doc_id long, text string"), path()).groupBy("doc_id").agg({"n_chars": "sum", "n_tokens": "sum", "section": "count"}).collect()
    found = {r["doc_id"]: r for r in got}
    for i, text in rows:
        assert found[i]["sum(n_chars)"] == len(text) and 0 < found[i]["sum(n_tokens)"] <= len(text)
        assert found[i]["count(section)"] == text.count("\n") + (not text.endswith("\n"))
    # Of a run, the last space goes with the word after it.
    alone = attribute(spark.createDataFrame([(1, " " * (n - 1))], "doc_id long, text string"), path()).collect()[0]
    assert found[1]["sum(n_tokens)"] == alone.n_tokens + 2
