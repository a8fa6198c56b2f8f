"""Mixed models of many edges from sums: a random intercept a group, solved for a block of edges at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.scalars import finite
from weftlink.functions.stats import benjamini_hochberg, t_tails

#: Numbers of a block of edges that are held in memory at once.
CELLS = 1 << 21
#: Ratios of the two standard deviations between which the best is sought first.
GRID = np.concatenate([[0.0], np.logspace(-4, 5, 91)])


class Block:
    """Edges with their sums: ``n`` (edges, groups) sizes, 0 where an edge lacks a group, ``s`` group sums of the
    design, ``sy`` of the response, and whole sums of products."""

    def __init__(self, n, s, sy, xx, xy, yy, reml):
        self.n, self.s, self.sy, self.xx, self.xy, self.yy, self.reml = n, s, sy, xx, xy, yy, reml
        self.p = xx.shape[1]
        self.m = n.sum(1) - (self.p if reml else 0)

    def at(self, rho: np.ndarray) -> tuple[np.ndarray, ...]:
        """Inverse of the scaled information, coefficients, residual sum and profile deviance at a ratio of variances."""
        w = rho[:, None] / (1 + rho[:, None] * self.n)
        a = self.xx - np.einsum("eg,egi,egj->eij", w, self.s, self.s)
        b = self.xy - np.einsum("eg,egi,eg->ei", w, self.s, self.sy)
        inverse = np.linalg.inv(a)
        beta = np.einsum("eij,ej->ei", inverse, b)
        rest = self.yy - (w * self.sy**2).sum(1) - (b * beta).sum(1)
        rest = np.maximum(rest, 1e-14 * np.maximum(self.yy, 1e-300))
        deviance = self.m * np.log(rest) + np.log1p(rho[:, None] * self.n).sum(1) + (np.linalg.slogdet(a)[1] if self.reml else 0.0)
        return inverse, beta, rest, deviance

    def slopes(self, rho: np.ndarray, inverse: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and second derivatives by the ratio: of the logarithms in the deviance, and of the residual sum; and
        the first one of the information."""
        grown = 1 + rho[:, None] * self.n
        w1, w2 = (self.n > 0) / grown**2, -2 * self.n / grown**3
        r = self.sy - np.einsum("egi,ei->eg", self.s, beta)
        a1 = -np.einsum("eg,egi,egj->eij", w1, self.s, self.s)
        a2 = -np.einsum("eg,egi,egj->eij", w2, self.s, self.s)
        q = np.einsum("eg,eg,egi->ei", w1, r, self.s)
        l1, l2 = (self.n / grown).sum(1), -((self.n / grown) ** 2).sum(1)
        if self.reml:
            turned = inverse @ a1
            l1 = l1 + np.einsum("eii->e", turned)
            l2 = l2 + np.einsum("eii->e", inverse @ a2) - np.einsum("eij,eji->e", turned, turned)
        r1 = -(w1 * r**2).sum(1)
        r2 = -(w2 * r**2).sum(1) - 2 * np.einsum("ei,eij,ej->e", q, inverse, q)
        return l1, l2, r1, r2, a1

    def solve(self) -> np.ndarray:
        """The ratio of variances with the least deviance, not below 0."""
        f = lambda theta: self.at(theta**2)[3]
        grid = np.stack([f(np.full(len(self.n), t)) for t in GRID], 1)
        k = grid.argmin(1)
        lo, hi = GRID[np.maximum(k - 1, 0)], GRID[np.minimum(k + 1, len(GRID) - 1)]
        gold = (np.sqrt(5) - 1) / 2
        x, y = hi - gold * (hi - lo), lo + gold * (hi - lo)
        fx, fy = f(x), f(y)
        for _ in range(50):
            left = fx <= fy
            lo, hi = np.where(left, lo, x), np.where(left, y, hi)
            x, y, fx, fy = np.where(left, hi - gold * (hi - lo), y), np.where(left, x, lo + gold * (hi - lo)), np.where(left, np.nan, fy), np.where(left, fx, np.nan)
            new = f(np.where(left, x, y))
            fx, fy = np.where(left, new, fx), np.where(left, fy, new)
        theta = (lo + hi) / 2
        rho = np.where(grid[:, 0] <= f(theta), 0.0, theta**2)
        # The deviance is flat around its least value; a few steps on its slope find it to the last digits.
        for _ in range(4):
            inverse, beta, rest, _ = self.at(rho)
            l1, l2, r1, r2, _ = self.slopes(rho, inverse, beta)
            slope, bend = l1 + self.m * r1 / rest, l2 + self.m * (r2 / rest - (r1 / rest) ** 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = rho - slope / bend
            near = (rho > 0) & (bend > 0) & (np.abs(step - rho) < 0.01 * rho)
            rho = np.where(near, step, rho)
        return rho

    def fit(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients, standard errors, degrees of freedom by Satterthwaite's rule)."""
        rho = self.solve()
        inverse, beta, rest, _ = self.at(rho)
        l1, l2, r1, r2, a1 = self.slopes(rho, inverse, beta)
        theta, s2 = np.sqrt(rho), rest / self.m
        s = np.sqrt(s2)
        diagonal = np.einsum("eii->ei", inverse)
        variance = s2[:, None] * diagonal
        # Curvature of the deviance in theta and sigma, and slopes of each variance in both.
        tt = 2 * (l1 + r1 / s2) + 4 * rho * (l2 + r2 / s2)
        ts, ss = -4 * theta * r1 / s**3, 4 * self.m / s2
        bend = np.stack([np.stack([tt, ts], 1), np.stack([ts, ss], 1)], 1)
        spread = 2 * np.linalg.pinv(bend, hermitian=True)
        along = np.stack([-2 * (theta * s2)[:, None] * np.einsum("eij,ejk,eki->ei", inverse, a1, inverse), 2 * s[:, None] * diagonal], 2)
        df = 2 * variance**2 / np.einsum("epi,eij,epj->ep", along, spread, along)
        return beta, np.sqrt(variance), df


def mixed_models(values: DataFrame, info: DataFrame, effects: Sequence[str], group: str, key: Sequence[str], reml: bool = True) -> DataFrame:
    """(key, effect, beta, se, t, df, p, p_adj) of a model with fixed effects and a random intercept a group.

    ``values`` is (key, sample, value), ``info`` has (sample, group, effects); samples where any of these is
    missing do not count for an edge. Only sums by edge and group are made; fits come from them for many edges at
    once, by restricted likelihood (or plain, with ``reml=False``). Degrees of freedom follow Satterthwaite; p is adjusted
    within an effect. Edges that cannot be fitted have nulls: fewer than three samples, no more samples than
    coefficients, effects that depend on each other, fewer than two groups, or groups of one sample each only.
    """
    key, k = list(key), len(effects)
    names = [f"x{i}" for i in range(k)]
    known = info.select("sample", F.col(group).cast("string").alias("group__"), *[finite(c).alias(n) for c, n in zip(effects, names, strict=True)])
    rows = values.select(*key, "sample", finite("value").alias("y")).join(known, "sample", "left")
    whole = F.col("y").isNotNull() & F.col("group__").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    rows = rows.withColumn("group__", F.when(whole, F.col("group__")))
    # Means and centred products, so that large means cost no digits.
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    size = F.count(F.lit(1)).cast("double")
    sums = [size.alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names], F.avg("y").alias("m_y"), (F.var_pop("y") * size).alias("yy")]
    sums += [(F.covar_pop(names[i], names[j]) * size).alias(f"xx{i}_{j}") for i, j in pairs] + [(F.covar_pop(n, "y") * size).alias(f"xy{i}") for i, n in enumerate(names)]
    by_group = rows.groupBy(*key, "group__").agg(*sums)
    listed = ["n", *[f"m_{n}" for n in names], "m_y"]
    inside = ["yy", *[f"xx{i}_{j}" for i, j in pairs], *[f"xy{i}" for i in range(k)]]
    there = F.col("group__").isNotNull()
    groups = F.array_sort(F.collect_list(F.when(there, F.struct("group__", *listed)))).alias("g")
    edge = by_group.groupBy(*key).agg(groups, *[F.coalesce(F.sum(F.when(there, F.col(c))), F.lit(0.0)).alias(c) for c in inside])
    edge = edge.select(*key, *[F.col(f"g.{c}").alias(c) for c in listed], *inside)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*key).schema.fields) + ", effect string, beta double, se double, t double, df double, p double"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Edges with about as many groups stand together.
            batch = batch.iloc[np.argsort(batch["n"].map(len).to_numpy(), kind="stable")]
            at = 0
            while at < len(batch):
                step = max(1, CELLS // (max(1, len(batch["n"].iloc[min(at + 256, len(batch) - 1)])) * (k + 2) ** 2))
                yield solved(batch.iloc[at : at + step])
                at += step

    def solved(b: pd.DataFrame) -> pd.DataFrame:
        e, width = len(b), max(1, int(b["n"].map(len).max()))

        def padded(c: str) -> np.ndarray:
            out = np.zeros((e, width))
            for i, v in enumerate(b[c]):
                out[i, : len(v)] = v
            return out

        n, my = padded("n"), padded("m_y")
        mx = np.stack([padded(f"m_{c}") for c in names], 2) if k else np.zeros((e, width, 0))
        total = n.sum(1)
        safe = np.maximum(total, 1)
        cx = (mx - (n[:, :, None] * mx).sum(1, keepdims=True) / safe[:, None, None]) * (n > 0)[:, :, None]
        cy = (my - ((n * my).sum(1) / safe)[:, None]) * (n > 0)
        xx = np.zeros((e, k + 1, k + 1))
        xx[:, 0, 0] = total
        for i, j in pairs:
            xx[:, i + 1, j + 1] = xx[:, j + 1, i + 1] = b[f"xx{i}_{j}"].to_numpy() + (n * cx[:, :, i] * cx[:, :, j]).sum(1)
        xy = np.zeros((e, k + 1))
        for i in range(k):
            xy[:, i + 1] = b[f"xy{i}"].to_numpy() + (n * cx[:, :, i] * cy).sum(1)
        yy = b["yy"].to_numpy() + (n * cy**2).sum(1)
        s = n[:, :, None] * np.concatenate([np.ones((e, width, 1)), cx], 2)
        scale = np.sqrt(np.maximum(np.einsum("eii->ei", xx), 1e-300))
        least = np.linalg.eigvalsh(xx / scale[:, :, None] / scale[:, None, :])[:, 0]
        held = (n > 0).sum(1)
        ok = (total >= 3) & (total > k + 1) & (held >= 2) & (held < total) & (least > 1e-9) & (yy > 0)
        beta, se, df = (np.full((e, k + 1), np.nan) for _ in range(3))
        if ok.any():
            beta[ok], se[ok], df[ok] = Block(n[ok], s[ok], (n * cy)[ok], xx[ok], xy[ok], yy[ok], reml).fit()
        t = beta / se
        p = t_tails(t.ravel(), df.ravel()).reshape(t.shape)
        out = b[key].loc[b.index.repeat(k)].reset_index(drop=True)
        out["effect"] = np.tile(np.array(list(effects), object), e)
        for name, v in (("beta", beta), ("se", se), ("t", t), ("df", df), ("p", p)):
            out[name] = pd.Series(v[:, 1:].ravel()).astype(object).where(np.isfinite(v[:, 1:].ravel()), None)
        return out

    return benjamini_hochberg(edge.mapInPandas(fit, shape), "p", "p_adj", ("effect",))
