"""The corpus pipeline: language ID, line dedup, near-copy removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` applies them to the table documents, writing each stage's rows as Parquet and
reading them back; rows that the next stage has been made of are deleted.

Defined cases: a null or empty text, or one without a letter, has no language and goes, so a table of such
texts gives an empty result, as does an empty table; a null source is a source of its own; rows that share
an id but not the text are documents of their own; rows that repeat both are one document from the Jaccard
stage on, until the mix repeats it; other columns are carried to the mix and end with the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import forget, staged, text_key, word_count
from weftlink.llm.jaccard_join import drop_near_copies
from weftlink.llm.language_id import fit, keep_known
from weftlink.llm.line_dedup import dedup_lines
from weftlink.llm.mixing import apply_mix
from weftlink.llm.packing import pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts, texts without letters and texts near no learned language go."""
    return keep_known(docs, fit(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts; a document of which no word is left goes.

    ``n_chars`` follows the text.
    """
    cleaned = dedup_lines(docs).where(~((F.col("text") == "") & (F.col("n_deleted") > 0)))
    out = [F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cleaned.select(out)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return apply_mix(docs)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins; copies that the mix made never share a bin."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.length("text") > 0, text_key(F.col("text"))).alias("cluster"))
    return pack(sized, "doc_id", "size", "source", "cluster")


STAGES = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", unlike_documents),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_bins),
]

#: Language profiles, minhashes and best-fit search have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(*before)
        before = [docs]
    return docs
