"""Differential links: standard tables, comparisons of two conditions, filters, directions, many conditions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftlink.functions.scalars import any_above, finite, fold_magnitude, log2_ratio, snake
from weftlink.functions.stats import average_rank, benjamini_hochberg, digamma, exact_quantile, f_upper, t_tails, trigamma, trigamma_inverse, with_average_rank
from weftlink.operators.mixed import mixed_models
from weftlink.operators.numbering import small
from weftlink.sources.staging import staged

KEY = ("tf", "gene_key", "peak_id")
#: Rows of a comparison, at most, that one task ranks.
RANK_ROWS = 200_000
#: Distinct scores of all comparisons, at most, whose ranks are broadcast.
RANK_VALUES = 1_000_000
#: Comparisons, at most, whose conditions' sums are columns of one row a key.
SUM_COMPARISONS = 32
MEASURES = ("link_score", "fp_score", "tf_expr", "gene_expr")
#: Other spellings of columns, in order of preference.
ALIASES = {"link_score": ("edge_weight", "link_weight", "weight"), "fp_score": ("fp_bed_score", "footprint_score"), "active": ("active_link",), "r_gene": ("r", "corr")}


def standard_links(df: DataFrame) -> DataFrame:
    """Snake-case names, aliases resolved, numbers finite, score not negative with its sign in
    ``link_sign``: from r_gene where present, else from the score if any is negative."""
    out = df.withColumnsRenamed({c: snake(c) for c in df.columns})
    for name, others in ALIASES.items():
        if name not in out.columns and (found := next((o for o in others if o in out.columns), None)):
            out = out.withColumnRenamed(found, name)
    missing = [c for c in KEY if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    for c in MEASURES:
        out = out.withColumn(c, finite(c) if c in out.columns else F.lit(None).cast("double"))
    if "link_sign" in out.columns:
        spelled = F.lower(F.trim("link_sign"))
        sign = F.when(spelled.isin("+", "pos", "positive", "1", "up", "activator"), "+").when(spelled.isin("-", "neg", "negative", "-1", "down", "repressor"), "-")
    elif "r_gene" in out.columns:
        sign = F.when(finite("r_gene") < 0, "-").when(finite("r_gene") > 0, "+")
    else:
        sign = F.when(F.col("link_score") < 0, "-").when(F.col("link_score") >= 0, "+")
    active = F.col("active").cast("int") if "active" in out.columns else F.lit(None).cast("int")
    return out.withColumn("link_sign", sign).withColumn("link_score", F.abs("link_score")).withColumn("active", active)


def one_a_key(df: DataFrame, key: Sequence[str] = KEY, how: str = "max_link_score", order: Sequence[str] = ()) -> DataFrame:
    """The row of each key with the largest score (nulls last), or the first in a stated order."""
    first = [F.col("link_score").desc_nulls_last()] if how == "max_link_score" else []
    rest = [F.col(c).asc_nulls_first() for c in (order or [c for c in df.columns if c not in key])]
    w = Window.partitionBy(*key).orderBy(*first, *rest)
    return df.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__")


def key_faults(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, fault): keys that repeat in a table, or that only one table has. Empty: the tables match."""
    n = lambda t, name: t.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    both = n(a, "n_a").join(n(b, "n_b"), list(key), "outer").na.fill(0, ["n_a", "n_b"])
    fault = F.when(F.col("n_a") == 0, "only in second").when(F.col("n_b") == 0, "only in first").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated")
    return both.select(*key, fault.alias("fault")).where("fault is not null")


def compare(
    case: DataFrame, control: DataFrame, key: Sequence[str] = KEY, signs: str = "error", pseudo: float = 1.0, only_active_both: bool = False, group: Sequence[str] = (), measures: Sequence[str] = MEASURES, ranks: bool = True
) -> DataFrame:
    """Case against control by key: delta, log2 ratio and fold of each measure, ranks of scores, changes.

    ``group`` columns (a comparison id) part independent comparisons in one table, so many comparisons
    are one join. Unlike signs: ``error``, ``drop``, ``prefer_case`` or ``prefer_max_magnitude``.
    Without ``ranks`` the rank columns, which take sums and joins of their own, are left out.
    """
    cols = [*measures, "link_sign", "active"]
    side = lambda t, s: t.select(*group, *key, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    rows = side(case, "case").join(side(control, "ctrl"), [*group, *key], "left")
    return _compared(rows, signs, pseudo, only_active_both, group, measures, ranks)


def _compared(rows: DataFrame, signs: str, pseudo: float, only_active_both: bool, group: Sequence[str], measures: Sequence[str], ranks: bool) -> DataFrame:
    """What ``compare`` adds to rows that hold both sides."""
    a, b = F.col("link_sign_case"), F.col("link_sign_ctrl")
    unlike = F.coalesce(a != b, F.lit(False))
    sign = F.coalesce(a, b)
    if signs == "error":
        sign = F.when(unlike, F.raise_error(F.lit("link signs differ between conditions")).cast("string")).otherwise(sign)
    elif signs == "drop":
        rows = rows.where(~unlike)
    elif signs == "prefer_max_magnitude":
        sign = F.when(unlike & (F.coalesce("link_score_ctrl", F.lit(0.0)) > F.coalesce("link_score_case", F.lit(0.0))), b).otherwise(sign)
    elif signs != "prefer_case":
        raise ValueError(signs)
    rows = rows.withColumn("link_sign", sign)
    if ranks:
        # Staged: the rows are needed again to be counted.
        rows = once = staged(rows, "compared")
    for m in measures:
        x, y = F.col(f"{m}_case"), F.col(f"{m}_ctrl")
        rows = rows.withColumn(f"delta_{m}", x - y).withColumn(f"log2FC_{m}", log2_ratio(x, y, pseudo)).withColumn(f"fc_{m}", F.try_divide(x + pseudo, y + pseudo))
    if ranks:
        # Groups that one task sorts quickly are ranked by windows.
        largest = once.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        for s in ("case", "ctrl"):
            if largest <= RANK_ROWS:
                rows = rows.withColumn(f"rank_{s}", average_rank(f"link_score_{s}", list(group), descending=True))
            else:
                rows = with_average_rank(rows, f"link_score_{s}", f"rank_{s}", list(group), descending=True, counted=once, held=RANK_VALUES)
        rows = rows.withColumn("rank_shift", F.col("rank_case") - F.col("rank_ctrl"))
    p, q = F.col("active_case") > 0, F.col("active_ctrl") > 0
    change = F.when(p & q, "shared").when(p & ~q, "gain").when(~p & q, "loss").when(~p & ~q, "inactive")
    rows = rows.withColumn("edge_change", change).withColumn("active_both", (p & q).cast("int")).withColumn("active_any", (p | q).cast("int"))
    if only_active_both:
        w = Window.partitionBy(*group)
        known = (F.count("active_case").over(w) > 0) & (F.count("active_ctrl").over(w) > 0)
        hide = known & ~F.coalesce(F.col("active_both") == 1, F.lit(False))
        rows = rows.withColumn("hide__", hide)
        for c in [f"{k}_{m}" for m in measures for k in ("delta", "log2FC", "fc")] + ["rank_shift"] * ranks:
            rows = rows.withColumn(c, F.when(~F.col("hide__"), F.col(c)))
        rows = rows.drop("hide__")
    return rows


def compare_many(
    links: DataFrame, specs: DataFrame, key: Sequence[str] = KEY, signs: str = "error", pseudo: float = 1.0, only_active_both: bool = False, measures: Sequence[str] = MEASURES, ranks: bool = True
) -> DataFrame:
    """All comparisons at once: ``links`` has a condition; ``specs`` is (comparison_id, case, control), a row a comparison.

    A key's links of all conditions are gathered in one row, in which each case finds its control: links are shuffled by
    key once (not at all where they lie by key), whatever the number of comparisons. The staged comparisons are counted
    before they are broadcast. Links without a whole key meet no control and are not gathered.
    """
    specs = staged(specs.select("comparison_id", "case", "control"), "comparisons")
    cols = ["condition", *measures, "link_sign", "active"]
    lacks = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in key])
    held = links.groupBy(*key, F.when(lacks, F.xxhash64(*cols)).alias("alone__")).agg(F.collect_list(F.struct(*cols)).alias("all__"))
    each = held.select("*", F.explode("all__").alias("x__"))
    met = each.join(small(specs, specs.count()), F.col("x__.condition") == F.col("case"))
    found = F.when(F.col("alone__").isNull(), F.filter("all__", lambda y: y["condition"] == F.col("control")))
    met = met.select("comparison_id", *key, "x__", F.explode_outer(found).alias("y__"))
    rows = met.select("comparison_id", *key, *[F.col(f"{t}.{c}").alias(f"{c}_{s}") for t, s in (("x__", "case"), ("y__", "ctrl")) for c in cols[1:]])
    return _compared(rows, signs, pseudo, only_active_both, ("comparison_id",), measures, ranks)


def score_deltas(parts: DataFrame, specs: DataFrame, score, key: Sequence[str] = KEY) -> DataFrame:
    """(comparison_id, key, delta_link_score) of ``compare_many``, where not null, of links that are still to be summed:
    ``parts`` is (key, condition, part), ``score`` makes a link's score of the sum of its parts.

    A key's sums are columns, one a condition, so parts are summed before their only shuffle, and links of single conditions
    are neither made nor sorted. More than ``SUM_COMPARISONS`` comparisons are made from links.
    """
    specs = staged(specs.select("comparison_id", "case", "control"), "comparisons")
    few = specs.limit(SUM_COMPARISONS + 1).collect()
    pairs = [r for r in few if r["case"] is not None and r["control"] is not None]
    size = lambda c: F.abs(finite(score(F.sum(c))))
    for k in key:
        parts = parts.where(F.col(k).isNotNull())
    if len(few) > SUM_COMPARISONS or not pairs:
        links = parts.groupBy(*key, "condition").agg(size("part").alias("link_score"))
        links = links.withColumns({"link_sign": F.lit(None).cast("string"), "active": F.lit(None).cast("int")})
        rows = compare_many(links, specs, key, "prefer_case", measures=("link_score",), ranks=False)
        return rows.where("delta_link_score is not null").select("comparison_id", *key, "delta_link_score")
    at = {c: f"s{i}__" for i, c in enumerate(sorted({c for r in pairs for c in (r["case"], r["control"])}))}
    parts = parts.where(F.col("condition").isin(list(at)))
    sums = parts.groupBy(*key).agg(*[size(F.when(F.col("condition") == F.lit(c), F.col("part"))).alias(s) for c, s in at.items()])
    kind = specs.schema["comparison_id"].dataType
    each = [F.struct(F.lit(r["comparison_id"]).cast(kind).alias("comparison_id"), (F.col(at[r["case"]]) - F.col(at[r["control"]])).alias("delta_link_score")) for r in pairs]
    rows = sums.select(*key, F.inline(F.array(*each))).where("delta_link_score is not null")
    return rows.select("comparison_id", *key, "delta_link_score")


def contrasts(labels: DataFrame, control_tag: str, sep: str = "_") -> DataFrame:
    """(comparison_id, case, control) of labels (label) against the control of their line (the part
    before the first separator); a single control serves all lines."""
    line = F.substring_index("label", sep, 1)
    rows = labels.select("label", line.alias("line"), F.col("label").endswith(control_tag).alias("is_control")).distinct()
    n = rows.where("is_control").agg(F.count(F.lit(1)).alias("n"))
    case = rows.where("not is_control").select(F.col("label").alias("case"), "line").crossJoin(n)
    control = rows.where("is_control").select(F.col("label").alias("control"), F.col("line").alias("c_line"))
    pairs = case.join(control, (F.col("n") == 1) | (F.col("line") == F.col("c_line")))
    return pairs.select(F.concat_ws("_vs_", "case", "control").alias("comparison_id"), "case", "control")


def filter_deltas(
    df: DataFrame,
    mode: str = "live",
    gene_log2fc: float | None = None,
    tf_log2fc: float | None = None,
    gene_min: float = 4,
    tf_min: float = 4,
    fp_min: float = 4,
    link_min: float = 2,
    delta_min: float = 2,
) -> DataFrame:
    """Delta links that count. ``live``: cutoffs on |log2 ratio| of gene and factor (None: no cutoff), and
    no factor that changes significantly against its target. ``documented``: minima of expression,
    footprint, score and |delta| in either condition as well."""
    g, t = F.col("log2FC_gene_expr"), F.col("log2FC_tf_expr")
    yes = lambda c: F.coalesce(c, F.lit(False))
    keep = F.lit(True)
    if gene_log2fc is not None:
        keep = keep & yes(F.abs(g) >= gene_log2fc)
    if tf_log2fc is not None:
        opposite = yes((F.abs(t) >= tf_log2fc) & (F.signum(t) * F.signum(g) * F.when(F.col("link_sign") == "-", -1).otherwise(1) < 0))
        keep = keep & ~opposite
    if mode == "documented":
        either = lambda m, least: any_above([F.col(f"{m}_case"), F.col(f"{m}_ctrl")], least)
        keep = keep & either("gene_expr", gene_min) & either("tf_expr", tf_min) & either("fp_score", fp_min) & either("link_score", link_min) & yes(F.abs("delta_link_score") >= delta_min)
    return df.where(keep)


def with_direction(df: DataFrame, gene_log2: float = 0.5, fp_delta: float = 0.5, fp_min: float = 0, tf_min: float = 0, gene_min: float = 0, tf_log2: float | None = None, by: str = "delta") -> DataFrame:
    """Adds ``direction``: up where gene and footprint both rise by their cutoffs, down where both fall;
    values on the higher side must reach their minima; a significant factor must not oppose."""
    g = F.col("log2FC_gene_expr")
    f = F.col("delta_fp_score") if by == "delta" else F.col("log2FC_fp_score")
    way = F.when((g >= gene_log2) & (f >= fp_delta), "Up").when((g <= -gene_log2) & (f <= -fp_delta), "Down")
    high = lambda m: F.when(g > 0, F.col(f"{m}_case")).otherwise(F.col(f"{m}_ctrl"))
    ok = (high("fp_score") >= fp_min) & (high("tf_expr") >= tf_min) & (high("gene_expr") >= gene_min)
    if tf_log2 is not None:
        t = F.col("log2FC_tf_expr")
        ok = ok & ~F.coalesce((F.abs(t) >= tf_log2) & (F.signum(t) != F.signum(g)), F.lit(False))
    return df.withColumn("direction", F.when(ok, way)).where("direction is not null")


def link_modes(df: DataFrame, by: Sequence[str] = ("tf",)) -> DataFrame:
    """activator where all known signs are +, repressor where all are -, else null."""
    sign = F.col("link_sign")
    lo, hi = F.min(sign), F.max(sign)
    return df.groupBy(*by).agg(F.when((lo == "+") & (hi == "+"), "activator").when((lo == "-") & (hi == "-"), "repressor").alias("mode"), F.count(sign).alias("n_signs"))


def filter_for_topics(df: DataFrame, log2fc_fp: float | None = 1, delta_fp: float | None = None, log2fc_gene: float | None = 1, bound_either: bool = True, expressed_either: bool = True) -> DataFrame:
    """Edges with bound site and expressed factor on either side, large enough changes, and gene and
    footprint moving the same way (by delta where a log ratio is 0)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    keep = F.lit(True)
    for c, least in (("log2FC_fp_score", log2fc_fp), ("delta_fp_score", delta_fp), ("log2FC_gene_expr", log2fc_gene)):
        if least is not None:
            keep = keep & yes(F.abs(c) >= least)
    for on, names in ((bound_either, "fp_bound"), (expressed_either, "tf_expr_flag")):
        if on and f"{names}_case" in df.columns:
            keep = keep & (yes(F.col(f"{names}_case") > 0) | yes(F.col(f"{names}_ctrl") > 0))
    way = lambda l, d: F.when(F.signum(l) != 0, F.signum(l)).otherwise(F.signum(d))
    g, f = way(F.col("log2FC_gene_expr"), F.col("delta_gene_expr")), way(F.col("log2FC_fp_score"), F.col("delta_fp_score"))
    return df.where(keep & yes((g == f) & (g != 0)))


def standard_deltas(df: DataFrame, case: str, control: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Columns suffixed by condition names become ``*_case`` and ``*_ctrl``; log ratios and fold
    magnitudes are filled in where the table lacks them."""
    out = df.withColumnsRenamed({f"{m}_{c}": f"{m}_{s}" for m in (*measures, "active", "link_sign") for c, s in ((case, "case"), (control, "ctrl"))})
    for m in measures:
        have = set(out.columns)
        if {f"{m}_case", f"{m}_ctrl"} <= have:
            log = log2_ratio(f"{m}_case", f"{m}_ctrl")
            out = out.withColumn(f"log2FC_{m}", F.coalesce(finite(f"log2FC_{m}"), log) if f"log2FC_{m}" in have else log)
        if f"log2FC_{m}" in out.columns:
            fc = finite(f"fc_{m}") if f"fc_{m}" in have else F.lit(None).cast("double")
            out = out.withColumn(f"fc_mag_{m}", fold_magnitude(fc, F.col(f"log2FC_{m}")))
    return out.withColumn("comparison_id", F.lit(f"{case}_vs_{control}"))


def file_comparison(path: str = "file") -> dict[str, F.Column]:
    """Expressions case, control and direction of a delta-link file's name."""
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    pattern = r"(?i)^(.+?)_vs_(.+?)_(?:delta_links_filtered|filtered_links|delta_links)(?:_(up|down))?\.csv$"
    got = [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")) for i in (1, 2, 3)]
    return {"case": got[0], "control": got[1], "direction": got[2]}


def edge_keys(filtered: DataFrame) -> DataFrame:
    """Distinct (comparison, tf, gene, peak) of filtered links."""
    return filtered.select("comparison_id", *KEY).distinct()


def edges_in(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys, ["comparison_id", *KEY], "left_semi")


def edges_by_tf_gene(edges: DataFrame, sums: Sequence[str], firsts: Sequence[str] = ()) -> DataFrame:
    """One row a comparison, factor and gene: sums (0 of nothing), and the first of other columns by peak."""
    agg = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums] + [F.min_by(c, "peak_id").alias(c) for c in firsts]
    return edges.groupBy("comparison_id", "tf", "gene_key").agg(*agg)


def tf_hub_summary(df: DataFrame) -> DataFrame:
    """Per factor: sums and counts of footprint changes by sign, largest expression, median log ratio,
    and the means over all factors beside them."""
    d = F.col("delta_fp_score")
    agg = df.groupBy("tf").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("sum_delta"),
        F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("sum_abs_delta"),
        F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)).alias("sum_gain"),
        F.coalesce(F.sum(F.when(d < 0, d)), F.lit(0.0)).alias("sum_loss"),
        F.count(F.when(d > 0, 1)).alias("n_gain"),
        F.count(F.when(d < 0, 1)).alias("n_loss"),
        F.max(F.greatest("tf_expr_case", "tf_expr_ctrl")).alias("max_tf_expr"),
        F.percentile("log2FC_tf_expr", F.lit(0.5)).alias("median_log2fc_tf"),
    )
    whole = agg.agg(F.avg("sum_abs_delta").alias("mean_abs_delta"), F.count(F.lit(1)).alias("n_tfs"))
    return agg.crossJoin(F.broadcast(whole))


def volcano_classes(df: DataFrame, log2fc: str, p: str, fc_cut: float = 1, p_cut: float = 0.05) -> DataFrame:
    """Adds class NS / FC / P / FC_P and -log10 p; a zero p becomes a tenth of the smallest other one."""
    least = df.where(F.col(p) > 0).agg(F.min(p).alias("least__"))
    rows = df.crossJoin(F.broadcast(least)).withColumn("p_used", F.when(F.col(p) == 0, F.col("least__") * 0.1).otherwise(F.col(p)))
    big, sure = F.coalesce(F.abs(log2fc) > fc_cut, F.lit(False)), F.coalesce(F.col("p_used") < p_cut, F.lit(False))
    kind = F.when(big & sure, "FC_P").when(big, "FC").when(sure, "P").otherwise("NS")
    return rows.withColumn("volcano_class", kind).withColumn("neg_log10_p", -F.log10("p_used")).drop("least__")


def gene_funnel(changed: DataFrame, links: DataFrame, fp_cut: float = 0.5, tf_cut: float = 0.5) -> DataFrame:
    """(comparison_id, direction, stage, n_genes): changed genes, those in links, those with a passing
    footprint, those whose factor passes too."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    per = links.groupBy("comparison_id", "gene_key").agg(F.max(yes(F.abs("delta_fp_score") >= fp_cut)).alias("fp"), F.max(yes(F.abs("log2FC_tf_expr") >= tf_cut)).alias("tf"))
    rows = changed.select("comparison_id", "direction", "gene_key").distinct().join(per, ["comparison_id", "gene_key"], "left")
    linked = F.col("fp").isNotNull()
    stages = F.array(
        F.struct(F.lit("1_total").alias("stage"), F.lit(True).alias("ok")),
        F.struct(F.lit("2_linked").alias("stage"), linked.alias("ok")),
        F.struct(F.lit("3_footprint").alias("stage"), yes(F.col("fp")).alias("ok")),
        F.struct(F.lit("4_tf").alias("stage"), (yes(F.col("fp")) & yes(F.col("tf"))).alias("ok")),
    )
    flat = rows.select("comparison_id", "direction", "gene_key", F.explode(stages).alias("s"))
    return flat.groupBy("comparison_id", "direction", "s.stage").agg(F.countDistinct(F.when(F.col("s.ok"), F.col("gene_key"))).alias("n_genes"))


# Many conditions: moderated tests over an edges x samples table.


@F.pandas_udf(StructType([StructField("shift", DoubleType()), StructField("spread", DoubleType())]))
def _log_chi(df: pd.Series) -> pd.DataFrame:
    """Mean shift and variance of the logarithm of a variance estimate with these degrees of freedom."""
    made = {d: (np.log(d / 2) - digamma(d / 2), trigamma(d / 2)) for d in df.dropna().unique() if d > 0}
    return pd.DataFrame([made.get(d, (None, None)) for d in df], columns=["shift", "spread"], dtype="float64")


@F.pandas_udf(DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper(max(x, 0.0), a, min(b, 1e12)) if x == x and a > 0 and b > 0 else None for x, a, b in zip(f, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tails(t.to_numpy(float), np.minimum(df.to_numpy(float), 1e9)))


def moderated(edges: DataFrame) -> DataFrame:
    """Adds ``s2_post`` and ``df_total`` to edges with a variance ``s2`` and its degrees of freedom ``df``: variances are
    drawn to a prior whose weight and size come from the moments of all log variances. Edges without degrees of
    freedom take the prior. Staged."""
    edges = staged(edges, "variances")
    some = edges.where("df > 0 and s2 is not null")
    mid = exact_quantile(some, "s2", 0.5, "mid").first()[0]
    if mid is None:
        return edges.withColumn("s2_post", F.lit(None).cast("double")).withColumn("df_total", F.lit(None).cast("double"))
    # A variance of 0 has no logarithm; it counts as a small share of the middle one.
    x = F.greatest(F.col("s2"), F.lit(1e-5 * (mid or 1.0)))
    e = some.select("df", x.alias("x"), _log_chi(F.col("df").cast("double")).alias("c")).withColumn("e", F.log("x") + F.col("c.shift"))
    m = e.agg(F.avg("e").alias("mean"), F.var_samp("e").alias("var"), F.avg("c.spread").alias("own"), F.sum("df").alias("pooled"), F.avg("x").alias("whole")).first()
    extra = (m["var"] or 0.0) - m["own"]
    if extra > 0:
        d0 = 2 * trigamma_inverse(extra)
        s0 = float(np.exp(m["mean"] + digamma(d0 / 2) - np.log(d0 / 2)))
        post = (F.lit(d0 * s0) + F.col("df") * F.coalesce("s2", F.lit(0.0))) / (F.lit(d0) + F.col("df"))
        total = F.least(F.lit(d0) + F.col("df"), F.lit(float(m["pooled"])))
    else:
        post, total = F.lit(m["whole"]), F.lit(float(m["pooled"]))
    return edges.withColumn("s2_post", post).withColumn("df_total", total)


def multi_anova(values: DataFrame, info: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, F, df1, df2, p, p_adj, means): moderated F test that the means of all conditions are 0, as in a model without
    an intercept. ``values`` is (key, sample, value), ``info`` (sample, condition). Samples without a value or a
    condition do not count for an edge; ``means`` maps the conditions that it has to their means."""
    rows = values.select(*key, "sample", finite("value").alias("value")).join(info.select("sample", "condition"), "sample").where("value is not null and condition is not null")
    group = rows.groupBy(*key, "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    means = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("condition").cast("string"), "m")))).alias("means")
    edge = group.groupBy(*key).agg(
        F.sum(F.col("n") * F.col("v")).alias("ss"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"), means
    )
    edge = moderated(edge.withColumn("s2", F.try_divide(F.col("ss"), F.col("df"))))
    f = F.try_divide(F.col("smm") / F.col("k"), F.col("s2_post"))
    out = edge.select(*key, f.alias("F"), F.col("k").cast("double").alias("df1"), F.col("df_total").alias("df2"), "means")
    return benjamini_hochberg(out.withColumn("p", _f_tail("F", "df1", "df2")), "p", "p_adj").select(*key, "F", "df1", "df2", "p", "p_adj", "means")


def multi_trend(values: DataFrame, info: DataFrame, covariate: str, key: Sequence[str] = KEY, others: Sequence[str] = ()) -> DataFrame:
    """(key, slope, se, t, df, p, p_adj): moderated slope on a covariate, with further covariates in the model. Centred
    sums of products per edge over the samples that it has; edges whose covariates depend on each other, or
    that have no more samples than coefficients, have no slope."""
    names = [f"x{i}" for i in range(1 + len(others))]
    k = len(names)
    known = info.select("sample", *[finite(c).alias(n) for c, n in zip((covariate, *others), names, strict=True)])
    rows = values.select(*key, "sample", finite("value").alias("y")).join(known, "sample").dropna(subset=["y", *names])
    size = F.count(F.lit(1))
    sums = [(F.covar_pop(names[i], names[j]) * size).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    edge = rows.groupBy(*key).agg(size.alias("n"), (F.var_pop("y") * size).alias("yy"), *sums, *[(F.covar_pop(x, "y") * size).alias(f"y{i}") for i, x in enumerate(names)])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edge.select(*key).schema.fields) + ", slope double, unscaled double, s2 double, df double"

    def solve(batches):
        for b in batches:
            a = np.stack([b[f"x{min(i, j)}_{max(i, j)}"].to_numpy(float) for i in range(k) for j in range(k)], 1).reshape(-1, k, k)
            y = np.stack([b[f"y{i}"].to_numpy(float) for i in range(k)], 1)
            scale = np.sqrt(np.maximum(np.einsum("eii->ei", a), 1e-300))
            unit = a / scale[:, :, None] / scale[:, None, :]
            df = b["n"].to_numpy(float) - k - 1
            ok = (np.linalg.eigvalsh(unit)[:, 0] > 1e-9) & (df >= 0) if len(b) else np.zeros(0, bool)
            inv = np.full(a.shape, np.nan)
            inv[ok] = np.linalg.inv(unit[ok]) / scale[ok][:, :, None] / scale[ok][:, None, :]
            beta = np.einsum("eij,ej->ei", inv, y)
            rest = np.maximum(b["yy"].to_numpy(float) - (beta * y).sum(1), 0)
            out = b[list(key)].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                made = {"slope": beta[:, 0], "unscaled": inv[:, 0, 0], "s2": np.where(df > 0, rest / df, np.nan), "df": np.where(ok, df, np.nan)}
            for c, v in made.items():
                out[c] = pd.Series(v, index=out.index).astype(object).where(np.isfinite(v), None)
            yield out

    fit = moderated(edge.mapInPandas(solve, shape))
    se = F.sqrt(F.col("unscaled") * F.col("s2_post"))
    df = F.when(F.col("slope").isNotNull(), F.col("df_total"))
    out = fit.select(*key, "slope", F.when(F.col("slope").isNotNull(), se).alias("se"), F.try_divide(F.col("slope"), se).alias("t"), df.alias("df")).withColumn("p", _t_tail("t", "df"))
    return benjamini_hochberg(out.withColumn("p", finite("p")), "p", "p_adj").select(*key, "slope", "se", "t", "df", "p", "p_adj")


def multi_lmm(values: DataFrame, info: DataFrame, effects: Sequence[str], group: str, key: Sequence[str] = KEY, reml: bool = True) -> DataFrame:
    """(key, effect, beta, se, t, df, p, p_adj) of a model with a random intercept a group; see ``mixed_models``."""
    return mixed_models(values, info, effects, group, key, reml)
