"""Token counts of fields and sections, by the character offsets of tokens.

Each document is encoded once, as a whole. Its tokens' character spans and its sections' spans are
both sorted, so joining them is a merge. A token that crosses a section's edge is allotted by the
named rule:

* ``start``: to the section of its first character (the default; counts stay whole),
* ``end``: to the section of its last character,
* ``most``: to the section with most of its characters, ties to the earlier one,
* ``share``: to every section by its share of the token's characters.

Under each rule the counts of a document's sections add up to its tokens, as sections tile the text.

Defined cases: a null or empty text has no section and no tokens, and gives one row with section 0;
very long texts are encoded whole, and so are white-space runs of any length: the rule always cuts
before a run and before its last character, so a long run is merged as the one word that it is, without
the rule's search; repeated rows give repeated results; an empty table gives an
empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cutting rule of the byte-level vocabulary.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most", "share")
#: White space as the cutting rule knows it, in runs so long that its search, which steps back from the end, is spared.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

_loaded: dict[str, tuple] = {}
_words: dict = {}


def vocabulary(path: str):
    """(encoding, bytes of each id), once a worker process and file."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        made = [tiktoken.Encoding(name, pat_str=rule, mergeable_ranks=ranks, special_tokens={}) for name, rule in (("offsets", WORD_RULE), ("word", "(?s:.+)"))]
        _loaded[path], _words[path] = (made[0], sizes), made[1]
    return _loaded[path]


def single_word(path: str):
    """The encoding that takes what it is given as one word."""
    vocabulary(path)
    return _words[path]


def encode(text: str, encoding, word) -> list[int]:
    """Ids of a whole text; long white-space runs but for their last character, if a word follows, are words."""
    ids, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()]) + word.encode_ordinary(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def token_spans(text: str, encoding, sizes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
    """First character and one past the last character of every token; a character that several
    tokens share lies in the span of each."""
    ids = np.array(encode(text, encoding, word), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80)  # of each byte: characters begun
    return at[starts] - 1, at[ends - 1]


def line_edges(text: str) -> np.ndarray:
    """Edges of a text's lines, each with its line feed; they tile the text."""
    edges, at = [0], text.find("\n")
    while 0 <= at:
        edges.append(at + 1)
        at = text.find("\n", at + 1)
    if edges[-1] != len(text):
        edges.append(len(text))
    return np.array(edges, np.int64)


def allot(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of the sections between consecutive ``edges``; sections are not empty."""
    n = len(edges) - 1
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=n).astype(float), crossing
    whole = first == last
    counts = np.bincount(first[whole], minlength=n).astype(float)
    for s, e, a, b in zip(starts[~whole], ends[~whole], first[~whole], last[~whole], strict=True):
        part = np.minimum(edges[a + 1 : b + 2], e) - np.maximum(edges[a : b + 1], s)
        if rule == "most":
            counts[a + int(np.argmax(part))] += 1
        else:
            counts[a : b + 1] += part / (e - s)
    return counts, crossing


def attribute(
    df: DataFrame, vocabulary_file: str, rule: str = "start", key: str = "doc_id", text: str = "text", sections: Callable[[str], np.ndarray] = line_edges
) -> DataFrame:
    """(key, section, n_chars, n_tokens, n_crossing) of every section of every text: ``sections`` gives
    the edges that tile a text; ``n_crossing`` counts tokens that begin here and end in a later section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = *vocabulary(vocabulary_file), single_word(vocabulary_file)
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, body in enumerate(batch["text"].array):
                if not body:
                    parts = np.zeros(1, int), np.zeros(1), np.zeros(1), np.zeros(1)
                else:
                    edges = sections(body)
                    tokens, crossing = allot(*token_spans(body, *loaded), edges, rule)
                    parts = np.arange(len(edges) - 1), np.diff(edges), tokens, crossing
                for have, more in zip(rows, (np.full(len(parts[0]), i), *parts), strict=True):
                    have.append(more)
            if rows[0]:
                at, section, chars, tokens, crossing = map(np.concatenate, rows)
                yield pd.DataFrame({"id": batch["id"].array.take(at), "section": section, "n_chars": chars.astype(int), "n_tokens": tokens, "n_crossing": crossing.astype(int)})

    kind = df.schema[key].dataType.simpleString()
    made = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(count, f"id {kind}, section int, n_chars long, n_tokens double, n_crossing long")
    return made.withColumnRenamed("id", key)
