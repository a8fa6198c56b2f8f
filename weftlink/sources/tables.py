"""Readers and writers: footprint overviews, motif tables, position matrices, region tables, priors,
link and delta files, species link tables, study snapshots."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions.scalars import chromosome_order, finite, format_region, log2_ratio, safe_name
from weftlink.operators.compare import file_comparison, one_a_key, standard_links
from weftlink.operators.matrix import OmicsSet

#: Canonical columns of an enhancer-gene prior and their other spellings.
PRIOR_ALIASES = {
    "chrom": ("chrom", "chr", "seqnames", "chromosome"),
    "start": ("start", "chromstart", "begin"),
    "end": ("end", "chromend", "stop"),
    "gene_key": ("connected_gene", "gene", "gene_symbol", "symbol", "gene_key"),
    "prior_id": ("gh_id", "genehancer_id", "prior_id", "id"),
    "confidence": ("confidence", "score", "gh_score"),
}
SPECIES = {"hs": "Homo_sapiens", "human": "Homo_sapiens", "mm": "Mus_musculus", "mouse": "Mus_musculus", "rn": "Rattus_norvegicus", "dr": "Danio_rerio", "dm": "Drosophila_melanogaster", "ce": "Caenorhabditis_elegans", "sc": "Saccharomyces_cerevisiae"}


def read_csv(spark: SparkSession, path, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A headed text table; all columns are text unless a schema is given."""
    r = spark.read.option("header", True).option("sep", sep).option("nullValue", "NA")
    return (r.schema(schema) if schema else r).csv(path)


def overview_motifs(spark: SparkSession, root: str) -> DataFrame:
    """(sample, motif, file) of overview files in ``root/sample/db/motif/``; read from the listing, not the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_overview.txt").option("recursiveFileLookup", True).load(root).select("path")
    part = lambda i: F.element_at(F.split("path", "/"), -i)
    return files.select(part(4).alias("sample"), part(2).alias("motif"), F.col("path").alias("file"))


def headed_rows(spark: SparkSession, paths, marks: Sequence[str], sep: str) -> DataFrame:
    """(file, head, row) of text tables with a head each, in one read: cells as text, whatever columns a file has
    and in whatever order. A line that holds all ``marks`` as cells is a head. Quoted cells may hold separators, not line
    feeds: a row is a line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    cell = lambda mark: F.array_contains(F.transform(F.split(F.col("value"), f"[{sep}]"), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))), mark)
    is_head = functools.reduce(lambda a, b: a & b, map(cell, marks))
    width = lines.where(is_head).agg(F.max(F.size(F.split("value", f"[{sep}]")))).first()[0] or 1
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"sep": sep, "nullValue": "NA", "maxColumns": str(width + 1)})
    rows = lines.select("file", is_head.alias("is_head"), cells.alias("c")).select("file", "is_head", F.array(*[F.col(f"c.c{i}") for i in range(width)]).alias("row"))
    heads = rows.where("is_head").select("file", F.col("row").alias("head")).distinct()
    return rows.where("not is_head").drop("is_head").join(heads, "file")


def read_overviews(spark: SparkSession, paths, sample_level: int = 4) -> DataFrame:
    """(motif, peak, region, sample, score, bound) from overview files of many samples in one read: score
    and bound columns are found by their endings, whatever their sample prefix."""
    rows = headed_rows(spark, paths, ("TFBS_chr",), "\t").withColumnsRenamed({"file": "file__", "head": "head__", "row": "row__"})

    def ending(e: str):
        """The value under the first head that ends so."""
        at = F.array_position(F.transform("head__", lambda h: F.coalesce(h.endswith(e), F.lit(False))), True)
        return F.get("row__", at.cast("int") - 1)

    get = lambda *ends: F.coalesce(*map(ending, ends))
    out = rows.select(
        get("TFBS_name").alias("motif"),
        format_region(get("TFBS_chr"), get("TFBS_start"), get("TFBS_end")).alias("peak"),
        format_region(get("peak_chr"), get("peak_start"), get("peak_end")).alias("region"),
        F.element_at(F.split("file__", "/"), -sample_level).alias("sample"),
        get("_ATAC_score", "_score").try_cast("double").alias("score"),
        get("_ATAC_bound", "_bound").try_cast("int").alias("bound"),
    )
    return out.groupBy("motif", "peak", "region", "sample").agg(F.min("score").alias("score"), F.max("bound").alias("bound"))


def write_footprints(rows: DataFrame, path: str) -> None:
    """One folder a motif, so that a motif is read alone."""
    rows.repartition("motif").write.mode("overwrite").partitionBy("motif").parquet(path)


def motif_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(motif, n_rows, n_peaks) of a footprint folder."""
    return spark.read.parquet(path).groupBy("motif").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("peak").alias("n_peaks"))


def trim_motifs(df: DataFrame, column: str = "motif") -> DataFrame:
    """Motif ids without leading underscores."""
    return df.withColumn(column, F.regexp_replace(column, "^_+", ""))


def read_motif_db(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def tf_list(motifs: DataFrame) -> DataFrame:
    """Distinct factors of motif symbols; dimers are split."""
    return motifs.select(F.explode(F.split("gene_symbol", "::")).alias("tf")).select(F.trim("tf").alias("tf")).where("tf <> ''").distinct()


def parse_pfm(text: str, strict: bool = True) -> list[tuple[str, str, int, list[float]]]:
    """(id, name, width, counts) of the matrices of a text: a ``>`` line, then four rows, labelled A, C,
    G, T or in that order. Faulty ones are an error, or left out."""
    import re

    out = []
    for block in re.split(r"(?m)^\s*>", text)[1:]:
        head, *rows = [line.strip() for line in block.splitlines() if line.strip()]
        ident, _, name = head.partition("\t") if "\t" in head else head.partition(" ")
        found: dict[str, list[float]] = {}
        for i, row in enumerate(rows[:4]):
            label = row[0].upper() if row[0].upper() in "ACGT" else "ACGT"[i]
            found[label] = [float(x) for x in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", row[1:] if row[0].isalpha() else row)]
        widths = {len(v) for v in found.values()}
        if len(found) == 4 and len(widths) == 1 and 0 not in widths:
            out.append((ident.strip(), name.strip() or ident.strip(), widths.pop(), [x for b in "ACGT" for x in found[b]]))
        elif strict:
            raise ValueError(f"matrix {ident!r} needs four rows of one length")
    return out


def read_pfm(spark: SparkSession, paths, strict: bool = True) -> DataFrame:
    """(id, name, w, m) from position-matrix files, one file a task."""
    texts = spark.read.text(paths, wholetext=True)
    kind = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("w", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))]))
    parse = F.udf(lambda t: parse_pfm(t, strict), kind)
    return texts.select(F.explode(parse("value")).alias("x")).select("x.*")


def read_regions(spark: SparkSession, path: str, overlap_prefix: str = "Overlap_", metadata: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Scores and overlaps (region, sample, value) of a region table with numeric sample columns and
    ``Overlap_`` columns."""
    df = read_csv(spark, path)
    lower = {c.lower(): c for c in df.columns}
    region = format_region(*[lower[k] for k in ("chr", "start", "end")])
    over = [c for c in df.columns if c.startswith(overlap_prefix)]
    samples = [c for c in df.columns if c not in over and c.lower() not in ("chr", "start", "end") and c not in metadata]
    rows = df.withColumn("region", region)
    long = lambda names, cut: rows.select("region", *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names]).unpivot("region", names, "sample", "value").withColumn("sample", F.expr(f"substring(sample, {cut + 1})"))
    return long(samples, 0), long(over, len(overlap_prefix))


def sort_regions(df: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Chromosomes in natural order, then position."""
    return df.orderBy(chromosome_order(chrom), chrom, start, end)


def standard_priors(df: DataFrame) -> DataFrame:
    """Canonical columns of an enhancer-gene table; absent ones are null."""
    lower = {c.lower(): c for c in df.columns}
    kinds = {"start": "int", "end": "int", "confidence": "double"}
    pick = lambda name: next((F.col(f"`{lower[a]}`") for a in PRIOR_ALIASES[name] if a in lower), F.lit(None))
    cast = lambda name: pick(name).cast("string").try_cast(kinds[name]) if name in kinds else pick(name).cast("string")
    return df.select(*[cast(n).alias(n) for n in PRIOR_ALIASES])


def gene_table(df: DataFrame) -> DataFrame:
    """(gene_key, ensembl, chrom, start, end, strand, tss): tss is the end on the minus strand."""
    tss = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    chrom = F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), F.col("chrom")))
    return df.select("gene_key", "ensembl", chrom.alias("chrom"), "start", "end", "strand", tss.alias("tss")).distinct()


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """A per-condition link file in standard form."""
    return standard_links(read_csv(spark, path))


#: Measures of a link, and the name that an older file may have for one.
DELTA_MEASURES, OLDER = ("link_score", "fp_score", "tf_expr", "gene_expr"), {"fp_score": "fp_bed_score"}


def read_deltas(spark: SparkSession, paths, max_files: int | None = None) -> DataFrame:
    """Delta files of many comparisons in one read, each under its own head. Case, control and direction come
    from file names; columns ``measure_condition`` become ``measure_case`` and ``measure_ctrl``; flags that
    a file lacks are 0. Changes are standard: ``delta_fp``, ``delta_gene``, ``log2fc_fp``, ``log2fc_gene``,
    ``log2fc_tf`` and their fold sizes ``fc_mag_*``; a lacking ratio is taken from the fold, then the delta.
    All other ``delta_``, ``log2FC_`` and ``fc_`` columns of any file are carried. Of a list of files the first
    ``max_files`` are read."""
    if max_files is not None and not isinstance(paths, str):
        paths = list(paths)[:max_files]
    rows = headed_rows(spark, paths, ("tf", "gene_key", "peak_id"), ",")
    name = file_comparison()
    rows = rows.select("head", "row", F.coalesce(name["case"], F.raise_error(F.concat(F.lit("no case and control in the name of "), "file")).cast("string")).alias("case_"), name["control"].alias("ctrl_"), name["direction"].alias("direction_"))
    at = lambda c: F.get("row", (F.array_position("head", c) - 1).cast("int"))
    number = lambda c: finite(at(c).try_cast("double"))
    sided = lambda m, s: number(F.concat(F.lit(f"{m}_"), F.col(f"{s}_")))
    measure = lambda m, s: F.coalesce(sided(m, s), sided(OLDER[m], s)) if m in OLDER else sided(m, s)
    cols = [measure(m, s).alias(f"{m}_{s}") for m in DELTA_MEASURES for s in ("case", "ctrl")]
    cols += [F.coalesce(sided(m, s), F.lit(0.0)).cast("int").alias(f"{m}_{s}") for m in ("fp_bound", "tf_expr_flag", "gene_expr_flag") for s in ("case", "ctrl")]
    has = lambda c: F.array_contains("head", c)
    first = lambda *known: functools.reduce(lambda rest, k: F.when(has(k[0]), k[1]).otherwise(rest), reversed(known), F.lit(None).cast("double"))
    fold = lambda c: F.when(number(c) > 0, number(c))
    size = lambda x: F.greatest(x, 1 / x)
    log2fc_fp = first(*[(c, number(c)) for c in ("log2FC_fp_score", "log2FC_fp_bed_score")], *[(c, F.log2(fold(c))) for c in ("fc_fp_score", "fc_fp_bed_score")], *[(c, number(c)) for c in ("delta_fp_score", "delta_fp_bed_score")])
    log2fc_gene = first(("log2FC_gene_expr", number("log2FC_gene_expr")), ("fc_gene_expr", F.log2(fold("fc_gene_expr"))), ("delta_gene_expr", number("delta_gene_expr")))
    log2fc_tf = F.when(has("log2FC_tf_expr"), number("log2FC_tf_expr")).otherwise(log2_ratio(sided("tf_expr", "case"), sided("tf_expr", "ctrl")))
    cols += [first(("delta_fp_score", number("delta_fp_score")), ("delta_fp_bed_score", number("delta_fp_bed_score"))).alias("delta_fp"), number("delta_gene_expr").alias("delta_gene")]
    cols += [log2fc_fp.alias("log2fc_fp"), log2fc_gene.alias("log2fc_gene"), log2fc_tf.alias("log2fc_tf")]
    cols += [
        F.when(has("fc_fp_score") | has("fc_fp_bed_score"), size(first(("fc_fp_score", fold("fc_fp_score")), ("fc_fp_bed_score", fold("fc_fp_bed_score"))))).otherwise(F.pow(2.0, F.abs(log2fc_fp))).alias("fc_mag_fp"),
        F.when(has("fc_gene_expr"), size(fold("fc_gene_expr"))).otherwise(F.pow(2.0, F.abs(log2fc_gene))).alias("fc_mag_gene"),
        F.pow(2.0, F.abs(log2fc_tf)).alias("fc_mag_tf"),
    ]
    heads = rows.select(F.explode("head").alias("c")).distinct().where("c like 'delta\\_%' or c like 'log2FC\\_%' or c like 'fc\\_%'")
    given = [number(r.c).alias(r.c) for r in heads.orderBy("c").collect()]
    keys = [at(c).alias(c) for c in ("tf", "gene_key", "peak_id", "link_sign")]
    return rows.select(*keys, F.concat_ws("_vs_", "case_", "ctrl_").alias("comparison_id"), F.col("direction_").alias("file_direction"), *cols, *given)


def link_samples(tables: dict[str, DataFrame], value: str = "link_score", strict: bool = True, keep: str = "max_link_score") -> DataFrame:
    """(tf, gene_key, peak_id, sample, value) of the standard link tables of several samples. A key that repeats
    in a sample keeps one row (``max_link_score``, or ``first`` by score and value); with ``strict`` every sample must
    hold the same keys, else the first key that does not is named when the rows are read."""
    if len(tables) < 2:
        raise ValueError("at least two samples are needed")
    parts = []
    for name, table in tables.items():
        if value not in table.columns:
            raise ValueError(f"no column {value} in sample {name}")
        parts.append(table.select("tf", "gene_key", "peak_id", F.lit(name).alias("sample"), "link_score", F.col(value).cast("double").alias("value")))
    rows = one_a_key(functools.reduce(lambda a, b: a.unionByName(b), parts), ("tf", "gene_key", "peak_id", "sample"), keep).drop("link_score")
    if not strict:
        return rows
    keys = ["tf", "gene_key", "peak_id"]
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"))
    fault = F.raise_error(F.concat(F.lit("not in every sample: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    return rows.join(n, keys).withColumn("value", F.when(F.col("n__") == len(tables), F.col("value")).otherwise(fault.cast("double"))).drop("n__")


def read_aligned_sites(spark: SparkSession, folder: str, tag: str, distinct: bool = False) -> dict[str, DataFrame]:
    """Cached aligned sites: ``fp_score`` and ``fp_bound`` (peak, sample, value), ``fp_annotation`` and ``id_map``.
    With ``distinct`` the first row of a repeated peak counts; both matrices must hold the same peaks."""

    def long(kind: str) -> DataFrame:
        df = read_csv(spark, f"{folder}/fp_{kind}_{tag}.csv").withColumn("row__", F.monotonically_increasing_id())
        if distinct:
            first = df.groupBy("peak_ID").agg(F.min("row__").alias("row__"))
            df = df.join(first, ["peak_ID", "row__"], "left_semi")
        samples = [c for c in df.columns if c not in ("peak_ID", "row__")]
        values = df.select(F.col("peak_ID").alias("peak"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in samples])
        return values.unpivot("peak", samples, "sample", "value")

    score, bound, annotation = long("scores"), long("bounds"), read_csv(spark, f"{folder}/fp_annotation_{tag}.csv")
    a, b = score.select("peak").distinct(), bound.select("peak").distinct()
    if a.exceptAll(b).unionAll(b.exceptAll(a)).limit(1).count():
        raise ValueError("scores and flags do not hold the same peaks")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/fp_id_map_{tag}.csv")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        ids = read_csv(spark, path.toString())
    else:
        ids = annotation.select(F.col("fp_peak").alias("peak_ID"), F.col("fp_peak").alias("fp_peak_bak"), "atac_peak", F.lit(None).cast("double").alias("group_size"))
    return {"fp_score": score, "fp_bound": bound, "fp_annotation": annotation, "id_map": ids}


def write_by_condition(rows: DataFrame, path: str, *by: str) -> None:
    """Partitioned Parquet, one folder a value."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_bed(rows: DataFrame, path: str, by: Sequence[str] = ("tf", "condition"), region: str = "peak") -> None:
    """Tab-separated intervals, sorted in every file, in one folder a factor and condition."""
    from weftlink.functions.scalars import parse_region

    r = parse_region(region)
    names = [F.regexp_replace(F.col(b).cast("string"), r"[^A-Za-z0-9_.-]+", "_").alias(b) for b in by]
    rows.select(r["chrom"].alias("chrom"), r["start"].alias("start"), r["end"].alias("end"), *names).sortWithinPartitions(*by, "chrom", "start", "end").write.mode("overwrite").option("sep", "\t").partitionBy(*by).csv(path)


class LinkTables:
    """Link tables by species: a tab-separated file becomes Parquet once; reads push filters down."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._held = spark, folder.rstrip("/"), {}

    @staticmethod
    def species(name: str) -> str:
        if name in SPECIES.values():
            return name
        if name.lower() not in SPECIES:
            raise ValueError(f"unknown species {name!r}")
        return SPECIES[name.lower()]

    def path(self, species: str) -> str:
        return f"{self.folder}/{self.species(species)}"

    def convert(self, tsv: str, species: str, rows_a_file: int = 250_000) -> None:
        """All columns as text, files of bounded size."""
        df = read_csv(self.spark, tsv, "\t")
        df.withColumnsRenamed({c: c.replace(".", "_") for c in df.columns}).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(self.path(species))
        self._held.pop(self.species(species), None)

    def available(self) -> list[str]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(str(PurePosixPath(s.getPath().toString()).name) for s in fs.listStatus(root)) if fs.exists(root) else []

    def load(self, species: str, tfs: Sequence[str] | None = None, targets: Sequence[str] | None = None, columns: Sequence[str] | None = None, cache: bool = True) -> DataFrame:
        name = self.species(species)
        df = self._held.get(name) if cache else None
        if df is None:
            df = self.spark.read.parquet(self.path(species))
            if cache:
                self._held[name] = df
        if tfs:
            df = df.where(F.col("Name_TF").isin(list(tfs)))
        if targets:
            df = df.where(F.col("Name_Target").isin(list(targets)))
        if columns:
            have = [c for c in columns if c in df.columns]
            if not have:
                raise ValueError("None of the requested columns present")
            df = df.select(have)
        return df

    def clear(self) -> None:
        self._held.clear()


def save_study(omics: OmicsSet, path: str) -> None:
    """One Parquet table a slot."""
    for f in fields(OmicsSet):
        v = getattr(omics, f.name)
        for name, table in (v.items() if isinstance(v, dict) else [(f.name, v)]):
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{'derived/' if isinstance(v, dict) else ''}{safe_name(name)}")


def load_study(spark: SparkSession, path: str, slots: Sequence[str] = ("fp_score", "fp_bound", "fp_annotation", "rna", "samples")) -> OmicsSet:
    """The named slots, lazily."""
    return OmicsSet(**{s: spark.read.parquet(f"{path}/{s}") for s in slots})
