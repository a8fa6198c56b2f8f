"""Column expressions: finite numbers, ratios, coordinates, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The number as double, null where it is null, NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def log2_ratio(a: Column | str, b: Column | str, pseudo: float = 1.0) -> Column:
    """log2((a + pseudo) / (b + pseudo)), null where that is not finite."""
    x = F.try_divide(col(a) + pseudo, col(b) + pseudo)
    return F.when(x > 0, F.log2(x))


def fold_magnitude(fc: Column, log2fc: Column) -> Column:
    """max(fc, 1/fc), else 2^|log2fc|."""
    own = F.when(fc > 0, F.greatest(fc, F.try_divide(F.lit(1.0), fc)))
    return F.coalesce(own, F.pow(F.lit(2.0), F.abs(log2fc)))


def parse_region(region: Column | str) -> Column:
    """``chrom:start-end`` as struct(chrom, start, end); parts that do not fit are null."""
    r = col(region)
    part = lambda i: F.regexp_extract(r, r"^([^:]+):(\d+)-(\d+)$", i)
    return F.struct(F.nullif(part(1), F.lit("")).alias("chrom"), part(2).try_cast("int").alias("start"), part(3).try_cast("int").alias("end"))


def format_region(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(col(chrom), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))


def midpoint(start: Column | str, end: Column | str) -> Column:
    """Floor of the mean of start and end."""
    return F.floor((col(start) + col(end)) / 2).cast("long")


def chromosome_order(chrom: Column | str) -> Column:
    """1..22, X 23, Y 24, M 25, anything else after them."""
    name = F.upper(F.regexp_replace(col(chrom), "(?i)^chr", ""))
    return F.coalesce(F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25), name.try_cast("int"), F.lit(1000))


def first_word(symbol: Column | str) -> Column:
    """A gene symbol cut at its first white space."""
    return F.regexp_replace(col(symbol), r"\s.*$", "")


def truth(c: Column | str) -> Column:
    """Flags spelled as numbers or words; anything unknown is null."""
    s = F.lower(F.trim(col(c).cast("string")))
    return F.when(s.isin("true", "t", "1", "1.0", "yes", "y"), True).when(s.isin("false", "f", "0", "0.0", "no", "n"), False)


def split_list(c: Column | str, pattern: str = r"\s*(?:,|::|;)\s*") -> Column:
    """A packed list of names as a sorted array of distinct, non-empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(col(c), pattern), lambda x: F.trim(x)), lambda x: x != "")))


def pack_list(c: Column | str, sep: str = ",") -> Column:
    """Aggregate: sorted distinct values in one string."""
    return F.array_join(F.array_sort(F.collect_set(col(c))), sep)


def doc_parts(doc_id: Column | str) -> Column:
    """``comparison::entity[::more]::direction`` as struct(comparison, entity, direction)."""
    p = F.split(col(doc_id), "::")
    n = F.size(p)
    entity = F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), "::")
    return F.struct(F.get(p, F.lit(0)).alias("comparison"), F.when(n > 2, entity).alias("entity"), F.when(n > 1, F.get(p, n - 1)).alias("direction"))


def direction_group(direction: Column | str) -> Column:
    d = F.lower(col(direction))
    return F.when(d.isNull() | (d == ""), "Unknown").when(d.contains("up"), "Up").when(d.contains("down"), "Down").otherwise(F.initcap(d))


def any_above(cols: Sequence[Column], threshold: float) -> Column:
    """Whether any of the columns exceeds the threshold; true if there are no columns."""
    if not cols:
        return F.lit(True)
    return F.coalesce((F.greatest(*cols) if len(cols) > 1 else cols[0]) > threshold, F.lit(False))


def safe_name(name: str) -> str:
    """A label that files and columns may bear."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name)


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower())).strip("_")
