"""Measurement matrices in long form (key, sample, value): conditions, flags, gates, normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.scalars import finite, split_list
from weftlink.functions.stats import value_counts


@dataclass(frozen=True)
class OmicsSet:
    """Lazy tables of one study. Derived tables replace each other; nothing is computed before it is read."""

    fp_score: DataFrame
    fp_bound: DataFrame
    fp_annotation: DataFrame
    rna: DataFrame
    samples: DataFrame
    atac_score: DataFrame | None = None
    atac_overlap: DataFrame | None = None
    tf_list: DataFrame | None = None
    motif_db: DataFrame | None = None
    derived: dict[str, DataFrame] = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> OmicsSet:
        own = {k: v for k, v in tables.items() if k in self.__dataclass_fields__}
        return replace(self, **own, derived={**self.derived, **{k: v for k, v in tables.items() if k not in own}})

    def restricted(self) -> OmicsSet:
        """Only samples that scores, flags and expression share, and regions that are annotated."""
        shared = self.samples.select("sample").distinct()
        for t in (self.fp_score, self.fp_bound, self.rna):
            shared = shared.join(t.select("sample").distinct(), "sample", "left_semi")
        cut = lambda t: t.join(shared, "sample", "left_semi")
        out = {"fp_score": cut(self.fp_score), "fp_bound": cut(self.fp_bound), "rna": cut(self.rna), "samples": cut(self.samples)}
        regions = self.fp_annotation.select("region").distinct()
        for name in ("atac_score", "atac_overlap"):
            if (t := getattr(self, name)) is not None:
                out[name] = cut(t).join(regions, "region", "left_semi")
        return replace(self, **out)


def to_long(wide: DataFrame, key: Sequence[str], samples: Sequence[str] | None = None) -> DataFrame:
    """One row a key and sample."""
    names = list(samples or [c for c in wide.columns if c not in key])
    return wide.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(list(key), names, "sample", "value")


def to_wide(long: DataFrame, key: Sequence[str], samples: Sequence[str], fill: float | None = None) -> DataFrame:
    """One column a sample, in the given order; the list is given so that no pass finds it."""
    out = long.groupBy(*key).pivot("sample", list(samples)).agg(F.first("value", ignorenulls=True))
    return out.na.fill(fill, subset=list(samples)) if fill is not None else out


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")


def by_condition(long: DataFrame, samples: DataFrame, key: Sequence[str], how: str = "mean", condition: str = "condition") -> DataFrame:
    """Mean or median over the samples of each condition; ``samples`` is (sample, condition)."""
    agg = {"mean": F.avg("v__"), "median": F.percentile("v__", F.lit(0.5))}[how]
    rows = long.withColumn("v__", finite("value")).join(samples.select("sample", condition), "sample")
    return rows.groupBy(*key, condition).agg(agg.alias("value"))


def expressed_flags(rna: DataFrame, samples: DataFrame, threshold: float = 10, min_samples: int = 1, condition: str = "condition", key: str = "gene") -> DataFrame:
    """1 where at least ``min_samples`` samples of a condition reach the threshold."""
    rows = rna.join(samples.select("sample", condition), "sample")
    hits = F.count(F.when(finite("value") >= threshold, 1))
    return rows.groupBy(key, condition).agg((hits >= min_samples).cast("int").alias("flag"))


def bound_by_condition(
    fp_bound: DataFrame, fp_score: DataFrame, atac_overlap: DataFrame, annotation: DataFrame, samples: DataFrame, threshold: float = 2, min_samples: int = 1, condition: str = "condition"
) -> DataFrame:
    """(peak, condition, flag): bound with a high enough score in ``min_samples`` samples, and the peak's
    region open in any sample, of the condition."""
    keep = samples.select("sample", condition)
    own = fp_bound.select("peak", "sample", F.col("value").alias("b__")).join(fp_score.select("peak", "sample", finite("value").alias("s__")), ["peak", "sample"], "left").join(keep, "sample")
    bound = own.groupBy("peak", condition).agg(F.count(F.when((F.col("b__") > 0) & (F.col("s__") >= threshold), 1)).alias("n_bound"))
    open_ = atac_overlap.join(keep, "sample").groupBy("region", condition).agg(F.count(F.when(F.col("value") > 0, 1)).alias("n_open"))
    where = annotation.groupBy("peak").agg(F.min("region").alias("region"))
    both = bound.join(where, "peak", "left").join(open_, ["region", condition], "left")
    flag = (F.col("n_bound") >= min_samples) & (F.coalesce("n_open", F.lit(0)) > 0)
    return both.select("peak", condition, flag.cast("int").alias("flag"))


def peaks_with_regions(annotation: DataFrame) -> DataFrame:
    """Peaks with more than one region: what a one-to-one map must not hold."""
    return annotation.groupBy("peak").agg(F.countDistinct("region").alias("n_regions")).where("n_regions > 1")


def bound_and_open(fp_bound: DataFrame, atac_overlap: DataFrame, annotation: DataFrame, na_as_unbound: bool = True) -> DataFrame:
    """Flags that also need the region open in the same sample."""
    where = annotation.groupBy("peak").agg(F.min("region").alias("region"))
    rows = fp_bound.join(where, "peak", "left").join(atac_overlap.select("region", "sample", F.col("value").alias("o__")), ["region", "sample"], "left")
    b, o = F.col("value"), F.col("o__")
    if na_as_unbound:
        b, o = F.coalesce(b, F.lit(0)), F.coalesce(o, F.lit(0))
    flag = F.when(b.isNull() | o.isNull(), None).otherwise(((b > 0) & (o > 0)).cast("int"))
    return rows.select("peak", "sample", flag.alias("value"))


def bound_and_expressed(fp_bound: DataFrame, annotation: DataFrame, motif_db: DataFrame, tf_flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags that also need a factor of one of the peak's motifs expressed in the sample, and the
    annotation with the peak's expressed factors; peaks without one go."""
    tfs = annotation.select("peak", "motif").distinct().join(motif_db, "motif")
    tfs = tfs.select("peak", F.explode(split_list("gene_symbol")).alias("tf")).distinct()
    on = tfs.join(tf_flags.where("flag > 0").select(F.col("gene").alias("tf"), "sample"), "tf")
    lit = on.select("peak", "sample").distinct()
    names = on.groupBy("peak").agg(F.array_join(F.array_sort(F.collect_set("tf")), ",").alias("tfs"))
    rows = fp_bound.join(names.select("peak"), "peak", "left_semi").join(lit.withColumn("lit__", F.lit(1)), ["peak", "sample"], "left")
    flags = rows.select("peak", "sample", ((F.coalesce("value", F.lit(0)) > 0) & F.col("lit__").isNotNull()).cast("int").alias("value"))
    return flags, annotation.join(names, "peak")


def often_bound(fp_bound: DataFrame, min_bound: int = 1, na_as_unbound: bool = True, key: str = "peak") -> DataFrame:
    """Keys bound in at least ``min_bound`` samples; with ``na_as_unbound=False`` any null drops a key."""
    agg = fp_bound.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("value") > 0, 1)), F.lit(0)).alias("n_bound"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"))
    ok = F.col("n_bound") >= min_bound
    return agg.where(ok if na_as_unbound else ok & (F.col("n_null") == 0)).select(key, F.col("n_bound").cast("long").alias("n_bound"))


def keep_keys(df: DataFrame, keys: DataFrame, key: str = "peak") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def keep_where(omics: OmicsSet, predicate: Column) -> OmicsSet:
    """Footprint tables cut to the peaks of which an annotation row fits the predicate, and to peaks all three share."""
    keys = omics.fp_annotation.where(predicate).select("peak").distinct()
    for t in (omics.fp_score, omics.fp_bound):
        keys = keys.join(t.select("peak").distinct(), "peak", "left_semi")
    return replace(omics, fp_score=keep_keys(omics.fp_score, keys), fp_bound=keep_keys(omics.fp_bound, keys), fp_annotation=keep_keys(omics.fp_annotation.where(predicate), keys))


def expressed_genes(rna: DataFrame, tf_list: DataFrame, gene_min: float = 5, tf_min: float = 10, min_samples: int = 1) -> DataFrame:
    """Genes that reach their threshold (factors have their own) in enough samples."""
    tfs = tf_list.select(F.col("tf").alias("gene"), F.lit(True).alias("is_tf")).distinct()
    rows = rna.join(tfs, "gene", "left").withColumn("least", F.when(F.col("is_tf"), tf_min).otherwise(gene_min))
    hits = rows.groupBy("gene").agg(F.count(F.when(finite("value") >= F.col("least"), 1)).alias("n_samples"))
    return hits.where(F.col("n_samples") >= min_samples)


def tf_expression_flags(rna: DataFrame, tf_list: DataFrame, threshold: float = 0, strict: bool = True) -> DataFrame:
    """(gene, sample, flag) of the factors, by > or >=."""
    v = finite("value")
    hit = v > threshold if strict else v >= threshold
    return rna.join(tf_list.select(F.col("tf").alias("gene")), "gene", "left_semi").select("gene", "sample", F.coalesce(hit, F.lit(False)).cast("int").alias("flag"))


def variance_table(long: DataFrame, key: str) -> DataFrame:
    """Mean, sample variance (null below two values) and relative standard deviation."""
    v = finite("value")
    return long.groupBy(key).agg(F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("rsd"), F.count(v).alias("n"))


def quantile_normalise(long: DataFrame, key: str = "peak", ties: str = "average") -> DataFrame:
    """Each sample's i-th smallest value becomes the mean of all samples' i-th smallest, over samples
    that have as many values; tied values get the mean of their places (or keep their order by key).
    A repeated key takes its smallest value."""
    one = long.select(key, "sample", finite("value").cast("double").alias("value")).groupBy(key, "sample").agg(F.min("value").alias("value"))
    # A value that occurs n times holds n places; no sample is sorted as a whole.
    counts = value_counts(one, "value", ["sample"])
    places = counts.select("sample", "x__", F.explode(F.sequence(F.col("below__") + 1, F.col("below__") + F.col("n__"))).alias("place"))
    reference = places.groupBy("place").agg(F.avg("x__").alias("ref"))
    if ties == "first":
        nth = F.row_number().over(Window.partitionBy("sample", "value").orderBy(key))
        placed = one.join(counts.withColumnRenamed("x__", "value"), ["sample", "value"], "left").withColumn("place", F.col("below__") + nth)
        return placed.join(reference, "place", "left").select(key, "sample", F.col("ref").alias("value"))
    tied = places.join(reference, "place").groupBy("sample", F.col("x__").alias("value")).agg(F.avg("ref").alias("q__"))
    return one.join(tied, ["sample", "value"], "left").select(key, "sample", F.col("q__").alias("value"))


def named_conditions(samples: DataFrame, label: str) -> DataFrame:
    """Missing labels take the sample's name; a repeated label gets the sample's name appended."""
    rows = samples.withColumn("l__", F.coalesce(F.nullif(F.col(label), F.lit("")), F.col("sample").cast("string")))
    n = F.count(F.lit(1)).over(Window.partitionBy("l__"))
    return rows.withColumn(label, F.when(n > 1, F.concat_ws("_", "l__", F.col("sample").cast("string"))).otherwise(F.col("l__"))).drop("l__")


def unaligned_keys(*tables: DataFrame, key: str = "peak") -> DataFrame:
    """Keys that not every table has, with the number of tables that do."""
    rows = None
    for t in tables:
        k = t.select(F.col(key).cast("string").alias(key)).distinct()
        rows = k if rows is None else rows.unionAll(k)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_tables")).where(F.col("n_tables") < len(tables))


def gene_keys(rna: DataFrame, mode: str = "both") -> DataFrame:
    """Distinct non-empty gene keys from symbols, identifiers or both (columns HGNC, ensembl_gene_id)."""
    cols = {"both": ["HGNC", "ensembl_gene_id"], "hgnc": ["HGNC"], "ensembl": ["ensembl_gene_id"]}[mode]
    return rna.select(F.explode(F.array(*cols)).alias("gene_key")).where("gene_key is not null and gene_key <> ''").distinct()


def attach_tfs(annotation: DataFrame, motif_db: DataFrame) -> DataFrame:
    """Each peak's factors, packed: those of its motifs, or the motif's upper-cased prefix where unknown."""
    rows = annotation.select("peak", "motif").distinct().join(motif_db.select("motif", "gene_symbol"), "motif", "left")
    name = F.coalesce(F.nullif(F.col("gene_symbol"), F.lit("")), F.upper(F.substring_index("motif", "_", 1)))
    exploded = rows.select("peak", F.explode(split_list(name)).alias("tf"))
    packed = exploded.groupBy("peak").agg(F.array_join(F.array_sort(F.collect_set("tf")), ",").alias("tfs"))
    return annotation.join(packed, "peak", "left")


def expand_tfs(annotation: DataFrame, tfs: str = "tfs") -> DataFrame:
    """One row a peak, motif and factor."""
    return annotation.withColumn("tf", F.explode(split_list(tfs))).drop(tfs)


def expression_lookup(rna: DataFrame) -> DataFrame:
    """(gene_key, sample, value) by symbol, and by identifier where that is no symbol (columns gene, ensembl)."""
    symbols = rna.where("gene is not null and gene <> ''").select(F.col("gene").alias("gene_key"), "sample", "value")
    ids = rna.where("ensembl is not null").select(F.col("ensembl").alias("gene_key"), "sample", "value")
    return symbols.unionByName(ids.join(symbols.select("gene_key").distinct(), "gene_key", "left_anti"))


def gate_chain(omics: OmicsSet, min_bound: int = 1, tf_threshold: float = 10) -> OmicsSet:
    """Bound often enough, then open, then with an expressed factor; often enough again after each."""
    cut = lambda o: replace(
        o,
        fp_score=keep_keys(o.fp_score, k := often_bound(o.fp_bound, min_bound)),
        fp_annotation=keep_keys(o.fp_annotation, k),
        fp_bound=keep_keys(o.fp_bound, k),
    )
    out = cut(omics)
    if out.atac_overlap is not None:
        out = cut(replace(out, fp_bound=bound_and_open(out.fp_bound, out.atac_overlap, out.fp_annotation)))
    if out.motif_db is not None and out.tf_list is not None:
        flags = tf_expression_flags(out.rna, out.tf_list, tf_threshold, strict=False)
        bound, named = bound_and_expressed(out.fp_bound, out.fp_annotation, out.motif_db, flags)
        out = cut(replace(out, fp_bound=bound, fp_annotation=named))
    return out
