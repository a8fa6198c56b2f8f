"""A logistic-normal topic model trained on executors: they keep the documents and pass on summed gradients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.operators.numbering import numbered_within, small
from weftlink.operators.warp import uniform
from weftlink.sources.staging import staged

VARIANTS = ("plain", "embedded", "split")
#: Numbers of a model, at most: the driver holds them, and so does every executor.
MAX_PARAMETERS = 50_000_000
#: Numbers of a gradient that are summed as one row; documents that are made dense at once.
BLOCK, DENSE = 1 << 16, 64


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    """Parameters by name, in one order, with the sums of their gradients over some documents."""

    def __init__(self, terms: int, k: int, variant: str = "split", hidden: int = 128, embedding: int = 32, seed: int = 1, gene: np.ndarray | None = None):
        if variant not in VARIANTS:
            raise ValueError(f"variant is one of {VARIANTS}")
        rng, self.k, self.variant = np.random.default_rng(seed), k, variant
        self.mask = np.ones((terms, hidden))
        if variant == "split":
            # Genes enter through one half of the first layer, everything else through the other.
            self.mask[gene, hidden // 2 :] = 0
            self.mask[~gene, : hidden // 2] = 0
        self.p = {"w1": rng.normal(0, 1 / np.sqrt(terms), (terms, hidden)) * self.mask, "b1": np.zeros(hidden), "wm": rng.normal(0, 0.1, (hidden, k)), "bm": np.zeros(k), "ws": rng.normal(0, 0.01, (hidden, k)), "bs": np.zeros(k)}
        self.p |= {"tv": rng.normal(0, 0.3, (k, embedding)), "wv": rng.normal(0, 0.3, (terms, embedding))} if variant == "embedded" else {"beta": rng.normal(0, 0.1, (k, terms))}

    def size(self) -> int:
        return sum(a.size for a in self.p.values())

    def phi(self) -> np.ndarray:
        return softmax(self.p["tv"] @ self.p["wv"].T if self.variant == "embedded" else self.p["beta"])

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.log1p(x) @ self.p["w1"] + self.p["b1"], 0) @ self.p["wm"] + self.p["bm"]

    def gradient(self, x: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, float]:
        """(gradient in one row, loss), both summed over the documents ``x``: the negative log likelihood of the counts under
        the reconstruction, and the distance of the encoder from a standard normal."""
        p, e = self.p, np.log1p(x)
        h0 = e @ p["w1"] + p["b1"]
        h = np.maximum(h0, 0)
        mu, raw = h @ p["wm"] + p["bm"], h @ p["ws"] + p["bs"]
        ls = np.clip(raw, -8, 8)
        sd, ph = np.exp(ls / 2), self.phi()
        th = softmax(mu + noise * sd)
        rec = th @ ph + 1e-12
        loss = -(x * np.log(rec)).sum() + 0.5 * (np.exp(ls) + mu * mu - 1 - ls).sum()
        g_rec = -x / rec
        g_th, g_ph = g_rec @ ph.T, th.T @ g_rec
        g_z = th * (g_th - (g_th * th).sum(1, keepdims=True))
        g_lo = ph * (g_ph - (g_ph * ph).sum(1, keepdims=True))
        g_mu, g_ls = g_z + mu, (g_z * noise * sd / 2 + (np.exp(ls) - 1) / 2) * (np.abs(raw) < 8)
        g_h = (g_mu @ p["wm"].T + g_ls @ p["ws"].T) * (h0 > 0)
        g = {"w1": e.T @ g_h * self.mask, "b1": g_h.sum(0), "wm": h.T @ g_mu, "bm": g_mu.sum(0), "ws": h.T @ g_ls, "bs": g_ls.sum(0)}
        g |= {"tv": g_lo @ p["wv"], "wv": g_lo.T @ p["tv"]} if self.variant == "embedded" else {"beta": g_lo}
        return np.concatenate([g[n].ravel() for n in p]), float(loss)


def noise_of(key: np.ndarray, epoch: int, k: int) -> np.ndarray:
    """A normal number for each document and topic, from the document's key and the epoch."""
    u = np.stack([uniform(key.view(np.uint64), (epoch * k + j) * 2 + side) for j in range(k) for side in (0, 1)], 1).reshape(len(key), k, 2)
    return np.sqrt(-2 * np.log1p(-u[:, :, 0])) * np.cos(2 * np.pi * u[:, :, 1])


def train(model: Model, sums: Callable[[Model, int, int], tuple[np.ndarray, float, int]], epochs: int, batches: int, rate: float) -> list[float]:
    """Adam on the mean gradient of each batch; ``sums(model, epoch, batch)`` gives (gradient, loss, documents). The mean
    loss of every epoch."""
    m1, m2, step, losses = np.zeros(model.size()), np.zeros(model.size()), 0, []
    for epoch in range(epochs):
        whole, seen = 0.0, 0
        for batch in range(batches):
            g, loss, n = sums(model, epoch, batch)
            if not n:
                continue
            whole, seen, step, g = whole + loss, seen + n, step + 1, g / n
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            at = 0
            for name, a in model.p.items():
                model.p[name] = a - move[at : at + a.size].reshape(a.shape)
                at += a.size
        losses.append(whole / max(seen, 1))
    return losses


def dense(b: pa.RecordBatch, terms: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Some documents at a time as rows of counts."""
    for at in range(0, len(b), DENSE):
        part = b.slice(at, DENSE)
        n = part.column("i").value_lengths().to_numpy(zero_copy_only=False)
        x = np.zeros((len(part), terms))
        x[np.repeat(np.arange(len(part)), n), part.column("i").flatten().to_numpy(zero_copy_only=False)] = part.column("x").flatten().to_numpy(zero_copy_only=False)
        yield slice(at, at + len(part)), x


def batch_sums(docs: DataFrame, terms: int, batches: int) -> Callable[[Model, int, int], tuple[np.ndarray, float, int]]:
    """Sums of a batch's gradients: every task adds its own documents, blocks of the sums are added on executors, and one
    gradient comes back. A document's batch follows from its key and the epoch."""
    spark = docs.sparkSession

    def sums(model: Model, epoch: int, batch: int) -> tuple[np.ndarray, float, int]:
        held = spark.sparkContext.broadcast(model)

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total, loss, n = held.value, None, 0.0, 0
            for b in parts:
                noise = noise_of(b.column("h").to_numpy(zero_copy_only=False).astype(np.int64), epoch, m.k)
                for at, x in dense(b, terms):
                    g, own = m.gradient(x, noise[at])
                    total, loss, n = g if total is None else total + g, loss + own, n + len(x)
            if n:
                blocks = [total[at : at + BLOCK] for at in range(0, len(total), BLOCK)]
                first = [i == 0 for i in range(len(blocks))]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "g": pa.array([x.tobytes() for x in blocks]), "loss": [loss * f for f in first], "n": pa.array([n * f for f in first], pa.int64())})

        def together(p: pd.DataFrame) -> pd.DataFrame:
            g = sum(np.frombuffer(x, float) for x in p["g"])
            return pd.DataFrame({"block": [p["block"].iat[0]], "g": [g.tobytes()], "loss": [p["loss"].sum()], "n": [p["n"].sum()]})

        shape = "block int, g binary, loss double, n long"
        mine = docs.where(F.pmod(F.xxhash64("h", F.lit(epoch)), F.lit(batches)) == batch)
        got = sorted(mine.mapInArrow(add, shape).groupBy("block").applyInPandas(together, shape).collect())
        held.destroy()
        return (np.concatenate([np.frombuffer(bytes(r.g), float) for r in got]) if got else np.zeros(0)), sum(r.loss for r in got), sum(r.n for r in got)

    return sums


def fit_documents(doc_term: DataFrame, k: int, variant: str, epochs: int, batch: int, hidden: int, rate: float, seed: int, count: str, embedding: int) -> tuple[DataFrame, DataFrame, dict]:
    """(theta, phi, figures): theta from the encoder's mean, phi from the decoder. Only the model, whose size is the number of
    terms times that of a layer and is checked, is on the driver."""
    cells = staged(doc_term.where(F.col(count) > 0).groupBy("doc_id", "term_id").agg(F.sum(F.col(count).cast("double")).alias("x")), "cells")
    terms = staged(numbered_within(cells.select("term_id").distinct().withColumn("all", F.lit(1)), ["all"], ["term_id"], "i").select("term_id", F.col("i").cast("int").alias("i")), "terms")
    n_terms = terms.count()
    size = n_terms * (hidden + max(k, embedding))
    if size > MAX_PARAMETERS:
        raise ValueError(f"a model of about {size} numbers; {MAX_PARAMETERS} at most")
    rows = cells.join(small(terms, n_terms), "term_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    docs = staged(rows.select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), F.col("c.i").alias("i"), F.col("c.x").alias("x")), "documents")
    n_docs = docs.count()
    gene = np.zeros(n_terms, bool)
    if variant == "split":
        gene[[r.i for r in terms.where(F.col("term_id").startswith("GENE:")).select("i").collect()]] = True
        if not gene.any() and not terms.where(F.col("term_id").startswith("PEAK:")).limit(1).count():
            gene[:] = True
    model = Model(max(n_terms, 1), k, variant, hidden, embedding, seed, gene if n_terms else np.ones(1, bool))
    batches = max(1, -(-n_docs // batch))
    losses = train(model, batch_sums(docs, n_terms, batches), epochs if n_docs else 0, batches, rate)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shares(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        phi = m.phi()
        for b in parts:
            theta, nll = np.zeros((len(b), m.k)), np.zeros(len(b))
            for at, x in dense(b, n_terms):
                theta[at] = softmax(m.mean(x))
                nll[at] = -(x * np.log(theta[at] @ phi + 1e-12)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(theta.tolist(), pa.list_(pa.float64())), pa.array(nll)], ["doc_id", "f", "nll"])

    done = staged(docs.mapInArrow(shares, f"doc_id {kind}, f array<double>, nll double"), "theta")
    nll, tokens = done.agg(F.sum("nll")).first()[0], cells.agg(F.sum("x")).first()[0]
    theta = done.select("doc_id", F.posexplode("f").alias("at", "theta")).select("doc_id", (F.col("at") + 1).cast("int").alias("topic"), "theta")
    columns = docs.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(model.phi().T[:n_terms])], "i int, f array<double>")
    phi = columns.join(terms, "i").select("term_id", F.posexplode("f").alias("at", "phi")).select((F.col("at") + 1).cast("int").alias("topic"), "term_id", "phi")
    figures = {"k": k, "n_tokens": float(tokens or 0), "loglik": -float(nll or 0), "perplexity": float(np.exp(nll / tokens)) if tokens else None, "losses": losses}
    return theta, phi, figures
