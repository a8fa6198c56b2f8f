"""Correlation of pairs of rows over shared samples: one kernel for all callers.

Each matrix is packed once to one array a key, aligned to the sorted list of samples; pairs then
join two arrays instead of two rows a sample, and every coefficient is an array expression in the
JVM. Nothing is shuffled but pairs and packed rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from weftlink.functions.scalars import finite, split_list
from weftlink.functions.stats import benjamini_hochberg, correlation_p, normal_two_sided

#: Samples that an array may span; the list of samples is gathered, so its size is checked.
MAX_SAMPLES = 100_000
#: Values of pairs whose inversions are counted at once.
MERGE_CELLS = 1 << 21


def sample_names(*tables: DataFrame) -> list:
    """Sorted sample names of all tables, at most ``MAX_SAMPLES``."""
    names = None
    for t in tables:
        s = t.select("sample").distinct()
        names = s if names is None else names.union(s)
    found = [r.sample for r in names.distinct().limit(MAX_SAMPLES + 1).collect()]
    if len(found) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    return sorted(x for x in found if x is not None)


def numbered_samples(table: DataFrame, samples: Sequence) -> DataFrame:
    """(sample, i__): places of the samples; their number is checked where they are gathered."""
    rows = [(i, s) for i, s in enumerate(samples)]
    kind = table.schema["sample"].dataType.simpleString()
    return F.broadcast(table.sparkSession.createDataFrame(rows, f"i__ int, sample {kind}"))


def pack(long: DataFrame, key: str, samples: Sequence, value: Column | str = "value") -> DataFrame:
    """(key, v): one array a key over the samples; the smallest value where a key repeats in a sample."""
    v, n = finite(value), len(samples)
    cells = long.select(key, "sample", v.alias("v__")).where("sample is not null").join(numbered_samples(long, samples), "sample", "left")
    cells = cells.groupBy(key, "i__").agg(F.min("v__").alias("v__"))
    held = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("i__").isNotNull(), F.struct("i__", "v__")))).alias("c__"))
    every = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    absent = F.transform(F.array_except(every, F.col("c__.i__")), lambda i: F.struct(i.alias("i__"), F.lit(None).cast("double").alias("v__")))
    whole = F.when(F.size("c__") == n, F.col("c__")).otherwise(F.array_sort(F.concat("c__", absent)))
    return held.select(key, F.transform(whole, lambda x: x["v__"]).alias("v"))


def _both(x: str, y: str, gate: str | None) -> Column:
    """Array of struct(a, b): the pairs that count."""
    pairs = F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    if gate is not None:
        pairs = F.zip_with(pairs, gate, lambda p, g: F.struct(F.when(g, p["a"]).alias("a"), p["b"].alias("b")))
    return F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def rank_rows(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1 within each row."""
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, 1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    # Runs of equal values over all rows, one after the other; every row begins a run.
    run = np.cumsum(new.ravel()) - 1
    first = np.flatnonzero(new.ravel())
    size = np.diff(np.append(first, x.size))
    mean = first % x.shape[1] + (size + 1) / 2
    out = np.empty(x.shape)
    np.put_along_axis(out, order, mean[run].reshape(x.shape), 1)
    return out


def by_length(*columns: pd.Series) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, matrices) of the arrays of each length; null and empty arrays are left out."""
    size = columns[0].map(lambda v: 0 if v is None else len(v)).to_numpy()
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        yield at, [np.stack(c.iloc[at].to_numpy()).astype(float) for c in columns]


@F.pandas_udf(ArrayType(DoubleType()))
def average_ranks(v: pd.Series) -> pd.Series:
    """Average ranks of arrays without nulls; null for null."""
    out = np.full(len(v), None, object)
    for at, (x,) in by_length(v):
        for i, row in zip(at, rank_rows(x), strict=True):
            out[i] = row
    return pd.Series(out)


def inversions(x: np.ndarray) -> np.ndarray:
    """How many pairs of each row stand in falling order: merges of sorted halves, all rows at once."""
    m, n = x.shape
    levels = max(0, n - 1).bit_length()
    # Ranks within a row keep blocks apart by whole numbers; what fills a row up stands last and is largest.
    _, flat = np.unique(x, return_inverse=True)
    top = int(flat.max(initial=0)) + 2
    full = np.full((m, 1 << levels), top - 1, np.int64)
    full[:, :n] = flat.reshape(m, n)
    count = np.zeros(m, np.int64)
    for level in range(levels):
        width = 1 << level
        blocks = full.reshape(-1, 2, width)
        shift = np.arange(len(blocks), dtype=np.int64)[:, None] * top
        left, right = (blocks[:, 0] + shift).ravel(), blocks[:, 1] + shift
        upto = np.searchsorted(left, right.ravel(), "right").reshape(right.shape) - np.arange(len(blocks))[:, None] * width
        count += (width - upto).sum(1).reshape(m, -1).sum(1)
        full = np.sort(blocks.reshape(len(blocks), -1), axis=1)
    return count


def tie_sizes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, size) of every run of equal values in rows that are sorted."""
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] != x[:, :-1]
    first = np.flatnonzero(new.ravel())
    return first // x.shape[1], np.diff(np.append(first, x.size)).astype(float)


def kendall_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tau-b, tie-corrected normal score) of each pair of rows, in O(n log n) comparisons a pair and level of merging."""
    m, n = a.shape
    order = np.lexsort((b, a), axis=1)
    a, b = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1)
    # Sorted by a, then b: pairs that are tied in a never fall.
    falling = inversions(b)
    over = lambda runs, f: np.bincount(runs[0], f(runs[1]), m)
    ra, rb = tie_sizes(a), tie_sizes(np.sort(b, axis=1))
    both = np.ones((m, n), bool)
    both[:, 1:] = (a[:, 1:] != a[:, :-1]) | (b[:, 1:] != b[:, :-1])
    first = np.flatnonzero(both.ravel())
    rab = first // n, np.diff(np.append(first, m * n)).astype(float)
    pair = lambda t: t * (t - 1) / 2
    total, ta, tb, tab = n * (n - 1) / 2, over(ra, pair), over(rb, pair), over(rab, pair)
    s = total - ta - tb + tab - 2 * falling
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = s / (np.sqrt(total - ta) * np.sqrt(total - tb))
        v = (n * (n - 1) * (2 * n + 5) - over(ra, lambda t: t * (t - 1) * (2 * t + 5)) - over(rb, lambda t: t * (t - 1) * (2 * t + 5))) / 18
        v += 4 * ta * tb / (2 * n * (n - 1))
        if n > 2:
            three = lambda t: t * (t - 1) * (t - 2)
            v += over(ra, three) * over(rb, three) / (9 * n * (n - 1) * (n - 2))
        z = s / np.sqrt(v)
    blank = lambda x: np.where(np.isfinite(x), x, np.nan)
    return blank(tau), blank(z)


@F.pandas_udf(StructType([StructField("tau", DoubleType()), StructField("z", DoubleType())]))
def kendall(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """tau-b and its normal score of two arrays of one length without nulls."""
    out = pd.DataFrame({"tau": np.full(len(a), np.nan), "z": np.full(len(a), np.nan)})
    for at, (x, y) in by_length(a, b):
        if x.shape[1] > 1:
            # So many cells at once, that no batch of long arrays is copied as a whole.
            step = max(1, MERGE_CELLS // x.shape[1])
            for lo in range(0, len(at), step):
                out.iloc[at[lo : lo + step], 0], out.iloc[at[lo : lo + step], 1] = kendall_rows(x[lo : lo + step], y[lo : lo + step])
    return out.astype(object).where(out.notna(), None)


def _pearson(pairs: Column) -> Column:
    """By centred sums; null where a side is constant."""
    n = F.size(pairs)
    mean = lambda k: F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p[k]), n)
    start = F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy"), mean("a").alias("ma"), mean("b").alias("mb"))
    step = lambda s, p: F.struct(
        (s["xx"] + (p["a"] - s["ma"]) * (p["a"] - s["ma"])).alias("xx"),
        (s["yy"] + (p["b"] - s["mb"]) * (p["b"] - s["mb"])).alias("yy"),
        (s["xy"] + (p["a"] - s["ma"]) * (p["b"] - s["mb"])).alias("xy"),
        s["ma"].alias("ma"),
        s["mb"].alias("mb"),
    )
    return F.aggregate(pairs, start, step, lambda s: F.try_divide(s["xy"], F.sqrt(s["xx"]) * F.sqrt(s["yy"])))


def _ranked_keys(packed: DataFrame, name: str) -> DataFrame:
    """A packed table with the ranks of each key that has every sample, made once a key."""
    whole = F.forall("v", lambda v: v.isNotNull())
    return packed.withColumn(f"{name}r__", average_ranks(F.when(whole, F.col("v")))).withColumnRenamed("v", f"{name}__")


def correlate(
    pairs: DataFrame,
    x: DataFrame,
    y: DataFrame,
    x_key: str,
    y_key: str,
    method: str = "pearson",
    min_n: int = 3,
    samples: Sequence | None = None,
    x_open: DataFrame | None = None,
    y_open: DataFrame | None = None,
) -> DataFrame:
    """(x_key, y_key, n, r, p) of the distinct pairs: places where both have finite values count, and
    with ``x_open`` / ``y_open`` (key, sample, value > 0) only places that both open. Null r and p
    below ``min_n`` places or where a side is constant."""
    samples = list(samples) if samples is not None else sample_names(x, y)
    rows = pairs.select(x_key, y_key).distinct()
    packed = lambda table, key, name: pack(table, key, samples).withColumnRenamed("v", f"{name}__")
    if method == "spearman":
        packed = lambda table, key, name: _ranked_keys(pack(table, key, samples), name)
    rows = rows.join(packed(x, x_key, "x"), x_key).join(packed(y, y_key, "y"), y_key)
    gate = None
    if x_open is not None or y_open is not None:
        gate = F.array_repeat(F.lit(True), len(samples))
        for name, key, flags in (("go__", x_key, x_open), ("hi__", y_key, y_open)):
            if flags is not None:
                rows = rows.join(pack(flags, key, samples).withColumnRenamed("v", name), key, "left")
                gate = F.zip_with(gate, F.coalesce(name, F.transform("x__", lambda _: F.lit(0.0))), lambda g, f: g & F.coalesce(f > 0, F.lit(False)))
        rows = rows.withColumn("gate__", gate)
        gate = "gate__"
    rows = rows.withColumn("p__", _both("x__", "y__", gate))
    n = F.size("p__")
    side = lambda name: F.transform("p__", lambda p: p[name])
    if method == "kendall":
        out = rows.select(x_key, y_key, n.alias("n"), kendall(F.when(n >= min_n, side("a")), F.when(n >= min_n, side("b"))).alias("k"))
        return out.select(x_key, y_key, "n", F.col("k.tau").alias("r"), normal_two_sided(F.col("k.z")).alias("p"))
    if method == "spearman":
        # Where a pair shares all samples, the ranks are those of its keys; else they are those within the pair.
        rows = rows.withColumn("n__", n)
        n = F.col("n__")
        part = n < len(samples)
        ranked = lambda key, name: F.when(part, average_ranks(F.when(part & (n >= min_n), side(name)))).otherwise(F.col(key))
        rows = rows.withColumn("p__", F.when(n >= min_n, F.zip_with(ranked("xr__", "a"), ranked("yr__", "b"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    out = rows.select(x_key, y_key, n.alias("n"), F.when(n >= min_n, _pearson(F.col("p__"))).alias("r"))
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def correlate_known(known: DataFrame | None, pairs: DataFrame, *args, **options) -> DataFrame:
    """Pairs that ``known`` (same columns as the result) holds are not computed again."""
    keys = list(args[2:4]) if len(args) >= 4 else [options["x_key"], options["y_key"]]
    if known is None:
        return correlate(pairs, *args, **options)
    fresh = pairs.select(keys).distinct().join(known.select(keys).distinct(), keys, "left_anti")
    return correlate(fresh, *args, **options).unionByName(known.join(pairs.select(keys).distinct(), keys, "left_semi"))


def passing(df: DataFrame, r_min: float = 0.3, q_max: float = 0.05, absolute: bool = False, r: str = "r", q: str = "p_adj") -> DataFrame:
    """Rows with r above (or |r| at least) a bound and a smaller adjusted p."""
    strong = F.abs(F.col(r)) >= r_min if absolute else F.col(r) > r_min
    return df.where(strong & (F.col(q) < q_max))


def tf_footprint_pairs(annotation: DataFrame, mode: str = "canonical", tfs: DataFrame | None = None, tf_subset: Sequence[str] | None = None) -> DataFrame:
    """(peak, tf): a peak's annotated factors, or every peak with every factor of a broadcast list."""
    if mode == "canonical":
        rows = annotation.select("peak", F.explode(split_list("tfs")).alias("tf"))
    else:
        few = tfs.select("tf").distinct()
        if few.limit(20_001).count() > 20_000:
            raise ValueError("too many factors to pair with every peak")
        rows = annotation.select("peak").distinct().crossJoin(F.broadcast(few))
    return rows.where(F.col("tf").isin(list(tf_subset))) if tf_subset else rows.distinct()


def correlate_tfs_to_footprints(
    annotation: DataFrame, fp_score: DataFrame, rna: DataFrame, method: str = "pearson", mode: str = "canonical", tfs: DataFrame | None = None, min_n: int = 5, family: Sequence[str] = (), **options
) -> DataFrame:
    """(peak, tf, n, r, p, p_adj): each test once, adjusted over all of them or within ``family``."""
    found = correlate(tf_footprint_pairs(annotation, mode, tfs), fp_score, rna.withColumnRenamed("gene", "tf"), "peak", "tf", method, min_n, **options)
    return benjamini_hochberg(found, "p", "p_adj", family)


def correlate_regions_to_genes(candidates: DataFrame, atac_score: DataFrame, rna: DataFrame, method: str = "pearson", known: DataFrame | None = None) -> DataFrame:
    """(region, gene, n, r, p, p_adj) of candidate pairs."""
    found = correlate_known(known, candidates.select("region", "gene"), atac_score, rna, "region", "gene", method)
    return benjamini_hochberg(found, "p", "p_adj")


def correlate_footprints_to_genes(
    links: DataFrame, fp_score: DataFrame, rna: DataFrame, method: str = "pearson", dedupe_tests: bool = False, min_n: int = 3
) -> DataFrame:
    """Tests of (peak, gene) joined back to annotated rows (peak, gene, tf, motif): adjusted over those
    rows, so a test counts once an annotation; with ``dedupe_tests`` once."""
    found = correlate(links.select("peak", "gene"), fp_score, rna, "peak", "gene", method, min_n)
    if dedupe_tests:
        return links.join(benjamini_hochberg(found, "p", "p_adj"), ["peak", "gene"])
    return benjamini_hochberg(links.join(found, ["peak", "gene"]), "p", "p_adj")


def add_tf_gene_correlation(links: DataFrame, rna: DataFrame, method: str = "pearson") -> DataFrame:
    """Adds n, r and adjusted p of factor and gene expression: each (tf, gene) is tested once."""
    tf = rna.select(F.col("gene").alias("tf"), "sample", "value")
    found = benjamini_hochberg(correlate(links.select("tf", "gene"), tf, rna, "tf", "gene", method), "p", "p_adj")
    named = found.select("tf", "gene", F.col("n").alias("n_rna_tf"), F.col("r").alias("r_rna_tf"), F.col("p").alias("p_rna_tf"), F.col("p_adj").alias("p_adj_rna_tf"))
    return links.join(named, ["tf", "gene"], "left")


def one_to_all(vector: DataFrame, matrix: DataFrame, key: str = "peak", method: str = "pearson", min_n: int = 5) -> DataFrame:
    """(key, n, r, p, p_adj) of one row (sample, value) against every row of a matrix."""
    x = vector.select(F.lit("one").alias("one"), "sample", "value")
    pairs = matrix.select(key).distinct().withColumn("one", F.lit("one"))
    return benjamini_hochberg(correlate(pairs, matrix, x, key, "one", method, min_n), "p", "p_adj").drop("one")


def unpack_statistics(df: DataFrame, key: str, names: str, r: str, p: str) -> DataFrame:
    """One row a (key, tf) from packed strings; single values serve all names; the first row of each stays.
    Raw p outside 0..1 are an error."""
    parts = [F.split(F.col(c), r"\s*,\s*") for c in (names, r, p)]
    n = F.size(parts[0])
    at = lambda a: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(a, i), F.when(F.size(a) == 1, F.get(a, F.lit(0)))))
    rows = df.select(key, F.posexplode(F.arrays_zip(parts[0].alias("tf"), at(parts[1]).alias("r"), at(parts[2]).alias("p"))).alias("i", "x"))
    rows = rows.select(key, "i", F.col("x.tf").alias("tf"), F.col("x.r").try_cast("double").alias("r"), F.col("x.p").try_cast("double").alias("p"))
    checked = F.when((F.col("p") < 0) | (F.col("p") > 1), F.raise_error(F.lit("a raw p lies outside 0 and 1")).cast("double")).otherwise(F.col("p"))
    one = rows.withColumn("p", checked).groupBy(key, "tf").agg(F.min(F.struct("i", "r", "p")).alias("b"))
    return benjamini_hochberg(one.select(key, "tf", "b.r", "b.p"), "p", "p_adj")


def pack_statistics(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """The reverse: one row a key with packed names, r and p, by name."""
    rows = F.array_sort(F.collect_list(F.struct("tf", "r", "p")))
    text = lambda x: F.coalesce(F.bround(x, digits).cast("string"), F.lit("NA"))
    packed = df.groupBy(key).agg(rows.alias("s"))
    join = lambda f: F.array_join(F.transform("s", f), ",")
    return packed.select(key, join(lambda x: x["tf"]).alias("tfs"), join(lambda x: text(x["r"])).alias("r"), join(lambda x: text(x["p"])).alias("p"))
