"""Language ID by rank-order n-gram profiles and out-of-place distance.

A text's letters are lower-cased, everything else becomes one blank, and its 1- to 3-grams are
counted over the whole text. Its most frequent grams, in order, are compared with each language's
ordered profile: a gram adds the difference of its two ranks, or the profile's length where the
profile lacks it. The nearest profile wins.

Profiles are fitted on at most about ``TRAIN_DOCS`` labelled documents a language, chosen by hash
of id, each with its whole text; prediction reads the text alone.

Defined cases: a null text, or one without letters, is ``und`` with score 0; ties between grams go
to the smaller gram code, ties between languages to the smaller name; repeated rows give repeated
results; without labelled rows everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import small_side, staged

#: Grams in a profile; labelled documents a language to fit on; languages at most.
PROFILE, TRAIN_DOCS, MAX_LANGUAGES = 400, 1000, 500
UNKNOWN = "und"
#: A text whose nearest profile lies farther than this score is in no known language.
MIN_SCORE = 0.2

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once a worker process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the 1- to 3-grams of a text. A code hashes its gram's code points to 32 bits.

    A gram holds at least one letter; a blank stands for any run of other characters.
    """
    empty = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if not text:
        return empty
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return empty
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank after each word
    keep[0] = True
    c = np.where(is_letter, points, np.uint32(32))[keep]
    real = c != 32
    with np.errstate(over="ignore"):
        one = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x55555555)) * np.uint32(0x85EBCA6B) + c[1:]
        three = (two[:-1] ^ np.uint32(0x33333333)) * np.uint32(0xC2B2AE35) + c[2:]
    # "a blank, letters" and the like count; grams of which the middle is blank join words and do not.
    codes = np.concatenate([one[real], two[real[:-1] | real[1:]], three[real[1:-1]]])
    return np.unique(codes, return_counts=True)


def top_grams(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most frequent codes, most frequent first, ties to the smaller code (codes are sorted)."""
    if len(codes) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Ordered profiles of all languages, for distances to all at once."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.names, self.size = sorted(ranked), size
        self.codes = np.unique(np.array([c for v in ranked.values() for c in v], np.uint32)) if ranked else np.zeros(0, np.uint32)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, np.array(ranked[name], np.uint32)), j] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 minus the distance's share of the largest possible one."""
        grams = top_grams(*gram_counts(text), self.size)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, grams)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != grams)] = len(self.codes)
        ranks = self.ranks[at]
        places = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None]))
        sums = places.sum(0)
        best = int(np.argmin(sums))
        return self.names[best], float(1 - sums[best] / (self.size * len(grams)))


def held_out(key: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, per_language: int = TRAIN_DOCS) -> Profiles:
    """Profiles from a hash sample of the labelled documents that are not held out; about ``per_language``
    documents of each language, all of them where there are fewer."""
    rows = df.where(F.col(lang).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs", like=df)
    n = counted.count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; profiles are made for at most {MAX_LANGUAGES}")
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") < per_language
    sample = rows.join(small_side(counted, n), "lang").where(draw)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                found = [gram_counts(t) for t in part["text"]]
                codes = np.concatenate([c for c, _ in found])
                counts = np.concatenate([k for _, k in found])
                own, where = np.unique(codes, return_inverse=True)
                yield pd.DataFrame({"lang": name, "code": own.astype(np.int64), "n": np.bincount(where, counts, len(own)).astype(np.int64)})

    # Few batches a task, each a sum already; then one sum a gram over all tasks.
    grams = sample.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), 1, size)
    # Only grams that can reach a profile are gathered: in each of 64 shares of the codes, the top ones.
    part = grams.groupBy("lang", F.pmod("code", F.lit(64)).alias("share")).agg(best.alias("top"))
    top = part.select("lang", F.explode("top").alias("g")).groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("g")), 1, size).alias("top"))
    return Profiles({r.lang: [g.code for g in r.top] for r in top.collect()}, size)


def identify(df: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(predict, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", key)


def keep_known(df: DataFrame, profiles: Profiles, text: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``df`` whose language is known, columns unchanged: ``und`` goes, and so does a text that is near no
    profile (score below ``least``)."""

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        found = (profiles.predict(t) for t in texts)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in found], dtype=bool)

    return df.where(known(F.col(text)))
