"""Approximate nearest neighbours by additive quantisation.

A vector is stored as a sum of one full-dimensional codeword from each of M codebooks. Codebooks
are fitted on residuals of a bounded hash sample (``FIT_ROWS``); every vector is encoded by beam
search, which keeps the best ``BEAM`` partial sums from codebook to codebook. With the codes go
the norms of the vector and of its sum. A query makes one table of inner products with all
codewords; a candidate's score is the sum of its M entries, scaled by the stored norms for inner
product, or expanded with them for distance. The best ``RERANK`` of each query are scored again
exactly, on the original vectors in double precision.

Equal vectors are one class, as query and as candidate: it is encoded, shortlisted and scored once, under
its smallest id, and then gives its smallest ids, so copies never crowd each other out of a shortlist.

Queries and candidates meet block by block (a stated query set against all rows). Blocks have
bounded size, so no task and no broadcast grows with the table.

Vectors meet only vectors of their own length. Each length of more than ``RERANK`` classes has codebooks of
its own; below that a shortlist would hold all classes, and every query is scored exactly with all of them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without
a vec_id take no part; rows that repeat a vec_id are queries and candidates of their own (``query_row``
tells their lists apart); ties go to the smaller vec_id; fewer candidates than asked are all
returned; an empty table gives an empty result; other columns are ignored; more than ``LENGTHS`` lengths
that need codebooks are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.llm.common import forget, numbered, small_side, staged

#: Vectors to fit codebooks on, codebooks, codewords in each, partial sums kept while encoding.
FIT_ROWS, CODEBOOKS, CODEWORDS, BEAM = 8192, 32, 256, 4
#: Shortlist of a query that is scored exactly; queries and candidates in a block, at most; lists merged at once.
RERANK, QUERY_BLOCK, ROW_BLOCK, MERGE = 200, 4096, 65536, 32
FIT_ROUNDS = 8
#: Lengths of vectors, at most, that codebooks are fitted for one by one.
LENGTHS = 64


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>, d, p, q, row) of the rows that take part: length, 128 bits that stand for the vector,
    and a number that follows the ids."""
    # Adding 0 leaves no negative zero, so equal vectors are equal in every bit.
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    return numbered(rows.select("id", "v", F.size("v").alias("d"), F.xxhash64("v").alias("p"), F.xxhash64(F.lit("second"), "v").alias("q")), ["id", "p", "q"], "row")


class Quantiser:
    """Codebooks of an additive quantiser."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # M, K, d
        self.norms = (self.books.astype(np.float64) ** 2).sum(2).astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, m: int = CODEBOOKS, k: int = CODEWORDS, rounds: int = FIT_ROUNDS, seed: int = 7) -> Quantiser:
        """Each codebook by k-means on what the codebooks before it leave over."""
        rng = np.random.default_rng(seed)
        rest, books = x.astype(np.float32), []
        k = min(k, len(x))
        for _ in range(m):
            words = rest[rng.choice(len(rest), k, replace=False)].copy()
            for _ in range(rounds):
                near = np.argmax(rest @ words.T - (words**2).sum(1) / 2, axis=1)
                n = np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                sums = np.add.reduceat(np.vstack([rest[order], np.zeros((1, rest.shape[1]), np.float32)]), np.minimum(np.cumsum(n) - n, len(rest)), axis=0)
                words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
            books.append(words)
            rest = rest - words[np.argmax(rest @ words.T - (words**2).sum(1) / 2, axis=1)]
        return cls(np.stack(books))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, M) by beam search: of all extensions of the kept partial sums, the nearest ones are kept."""
        x = x.astype(np.float32)
        n, (m, k, _) = len(x), self.books.shape
        rest = x[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for j in range(m):
            width = rest.shape[1]
            # |rest - word|^2 for every kept sum and word
            d = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(n * width, -1) @ self.books[j].T).reshape(n, width, k) + self.norms[j]
            flat = d.reshape(n, width * k)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            if j == m - 1:
                best = best[np.arange(n), np.argmin(np.take_along_axis(flat, best, 1), 1)][:, None]
            parent, word = best // k, best % k
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - self.books[j][word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0, :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.books.shape[0]), codes].sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products (n, M, K) of queries with all codewords."""
        return np.einsum("qd,mkd->qmk", q.astype(np.float32), self.books, optimize=True)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def fit_sample(vectors: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hash of id and vector."""
    got = vectors.select("v", F.xxhash64("id", "p", F.lit("fit")).alias("h")).orderBy("h", "v").limit(rows).select("v").toPandas()
    return matrix(got["v"])


def encoded(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(id, copies, codes, scale, norm2): codes with the stored norms."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.iloc[at : at + 2048]
                x = matrix(batch["v"])
                codes = quantiser.encode(x)
                got = quantiser.decode(codes).astype(np.float64)
                norm2 = (got**2).sum(1)
                scale = np.sqrt((x**2).sum(1) / np.maximum(norm2, 1e-30))
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "copies": batch["copies"].to_numpy(), "codes": [c.tobytes() for c in codes], "scale": scale, "norm2": norm2})

    return vectors.select("id", "v", "copies").mapInPandas(encode, "id long, copies long, codes binary, scale double, norm2 double")


def shortlist(queries: DataFrame, codes: DataFrame, quantiser: Quantiser, rerank: int, n_queries: int, n_rows: int, metric: str = "ip") -> DataFrame:
    """(query_id, id): each query's best ``rerank`` by table scores, ties to the smaller id, over all classes;
    its own is left out where it holds no copy."""
    # Blocks are large where there are many queries, as every block of them reads all codes, and small where few.
    cores = 2 * queries.sparkSession.sparkContext.defaultParallelism
    q_blocks, r_blocks = max(-(-n_queries // QUERY_BLOCK), min(cores, -(-n_queries // 256))), -(-n_rows // ROW_BLOCK)
    m = quantiser.books.shape[0]
    left = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))
    right = codes.withColumn("rb", F.pmod(F.xxhash64("id", F.lit("row")), F.lit(r_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def scan(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("id")
            lone = r["copies"].to_numpy() == 1
            ids, scale, norm2 = r["id"].to_numpy(), r["scale"].to_numpy(np.float32), r["norm2"].to_numpy(np.float32)
            c = np.frombuffer(b"".join(r["codes"]), np.uint8).reshape(-1, m).astype(np.intp)
            columns = [np.ascontiguousarray(c[:, j]) for j in range(m)]
            tables = quantiser.tables(matrix(q["v"]))
            for qid, t in zip(q["id"], tables, strict=True):
                score = t[0].take(columns[0])
                for j in range(1, m):
                    score += t[j].take(columns[j])
                score = score * scale if metric == "ip" else 2 * score - norm2
                score[(ids == qid) & lone] = -np.inf
                k = min(rerank, len(ids))
                least = np.partition(score, len(ids) - k)[len(ids) - k]
                best = np.nonzero(score > least)[0]
                best = np.concatenate([best, np.nonzero(score == least)[0][: k - len(best)]])
                best = best[np.isfinite(score[best])]
                out.append((qid, int(r["rb"].iat[0]), -score[best].astype(np.float64), ids[best]))
        return pd.DataFrame(out, columns=["query_id", "rb", "minus", "ids"])

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(scan, "query_id long, rb int, minus array<double>, ids array<long>")
    lists = found.select("query_id", "rb", F.zip_with("minus", "ids", lambda s, i: F.struct(s.alias("minus"), i.alias("id"))).alias("best"))
    # One list a query and block; some lists of a query meet at a time, and its best are taken, round by round.
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, rerank).alias("best")
    while r_blocks > MERGE:
        r_blocks = -(-r_blocks // MERGE)
        lists = lists.groupBy("query_id", F.floor(F.col("rb") / MERGE).cast("int").alias("rb")).agg(best)
    return lists.groupBy("query_id").agg(best).select("query_id", F.explode("best.id").alias("id"))


def candidates(vectors: DataFrame, classes: DataFrame, queries: DataFrame, rerank: int, fit_rows: int) -> DataFrame:
    """(query_id, id): the classes that are scored exactly for each query class, length by length."""
    sizes = staged(queries.groupBy("d").agg(F.count(F.lit(1)).alias("n_queries")).join(classes.groupBy("d").agg(F.count(F.lit(1)).alias("n_rows")), "d"), "lengths")
    few = sizes.where(F.col("n_rows") <= rerank).select("d")
    right = classes.join(small_side(few, few.count()), "d").select("d", "id")
    near = queries.select("d", F.col("id").alias("query_id")).join(right, "d").select("query_id", "id")
    large = sizes.where(F.col("n_rows") > rerank).orderBy("d").limit(LENGTHS + 1).collect()
    if len(large) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths that need codebooks")
    for d, n_queries, n_rows in large:
        mine = F.col("d") == d
        quantiser = Quantiser.fit(fit_sample(vectors.where(mine), fit_rows))
        codes = staged(encoded(classes.where(mine), quantiser), "codes")
        near = near.unionByName(staged(shortlist(queries.where(mine), codes, quantiser, rerank, n_queries, n_rows), "shortlist", like=classes))
        forget(codes)
    return near


def search(
    df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", rerank: int = RERANK, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(query_id, rank, id, score, query_row) of each query's ``k`` nearest rows by inner product. ``is_query``
    is a condition on the key, given as a column named ``id``."""
    vectors = staged(clean_vectors(df, key, vector), "vectors", like=df)
    own = vectors.groupBy("d", "p", "q").agg(F.min(F.struct("row", "v")).alias("m"), F.count(F.lit(1)).alias("copies"))
    classes = staged(own.select(F.col("m.row").alias("id"), "m.v", "d", "p", "q", "copies"), "classes", like=vectors)
    asked = vectors.where(is_query).select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "p", "q")
    asked = staged(asked.join(classes.select(F.col("id").alias("own"), "p", "q"), ["p", "q"]).select("query_id", "query_row", "own"), "queries", like=vectors)
    queries = staged(classes.join(asked.select(F.col("own").alias("id")).distinct(), "id", "left_semi").select("id", "v", "d"), "query-classes", like=classes)
    near = candidates(vectors, classes, queries, rerank, fit_rows)
    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = near.join(classes.select("id", "v"), "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = pairs.select(F.col("query_id").alias("own"), F.col("id").alias("class"), exact.alias("score"))
    # One more than asked of everything, as one of a query's rows may be itself.
    place = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "class"))
    best = scored.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    nth = F.row_number().over(Window.partitionBy("p", "q").orderBy("row"))
    first = vectors.select("id", "row", "p", "q").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    held = first.join(classes.select(F.col("id").alias("class"), "p", "q"), ["p", "q"]).select("class", "id", "row")
    lists = best.join(held, "class").groupBy("own").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "row", "id"))), 1, k + 1).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["row"] != F.col("query_row")), 1, k)
    out = asked.join(lists, "own").select("query_id", "query_row", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.id", (-F.col("b.minus")).alias("score"), "query_row")
