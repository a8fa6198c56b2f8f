"""Documents and terms from links, topic models, and scoring of links by topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.stats import exact_quantile, gamma_cutoff, gamma_moments
from weftlink.operators.numbering import FEW, numbered_within, running_start, same, small
from weftlink.operators.permuted import permutation_hash, permuted_p  # noqa: F401
from weftlink.sources.staging import staged


def tf_documents(edges: DataFrame, by: str = "gene", clusters: DataFrame | None = None, modality: str | None = None) -> DataFrame:
    """Adds ``direction``, ``tf_doc`` and ``doc_id`` (comparison::factor or cluster::direction); rows
    without a direction go. ``clusters`` is (tf, cluster), matched without case."""
    log = {"gene": "log2FC_gene_expr", "fp": "log2FC_fp_score"}.get(by)
    way = F.lit("All") if log is None else F.when(F.col(log) > 0, "Up").when(F.col(log) < 0, "Down")
    rows = edges.withColumn("direction", way).where("direction is not null")
    if clusters is None:
        rows = rows.withColumn("tf_doc", F.col("tf"))
    else:
        c = clusters.select(F.upper("tf").alias("up__"), "cluster").dropDuplicates(["up__"])
        rows = rows.join(c, F.upper("tf") == F.col("up__"), "left").withColumn("tf_doc", F.coalesce(F.col("cluster").cast("string"), F.col("tf"))).drop("up__", "cluster")
    name = F.concat_ws("::", "comparison_id", "tf_doc", "direction")
    return rows.withColumn("doc_id", F.concat(F.lit(f"{modality}::"), name) if modality else name)


def tf_cluster_map(motifs: DataFrame) -> DataFrame:
    """(tf, cluster) from (gene_symbol, cluster): the cluster that most of a factor's motifs have, ties
    to the smaller name; factors whose best cluster is unnamed (#N/A) are left out."""
    rows = motifs.select(F.explode(F.split("gene_symbol", "::")).alias("tf"), F.col("cluster").cast("string").alias("cluster"))
    counts = rows.select(F.upper(F.trim("tf")).alias("tf"), "cluster").where("tf <> ''").groupBy("tf", "cluster").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tf").orderBy(F.desc("n"), "cluster")
    return counts.withColumn("i", F.row_number().over(w)).where("i = 1 and cluster <> '#N/A'").select("tf", "cluster")


def weight_counts(df: DataFrame, weight: str = "weight", scale: float = 50, least: int = 1) -> DataFrame:
    """Adds integer counts: ``count_bin`` by the share of the largest weight, ``count_log`` by log1p;
    zero stays zero, anything else is at least ``least``."""
    top = df.agg(F.max(weight).alias("top__"))
    rows = df.crossJoin(F.broadcast(top))
    w = F.col(weight)
    count = lambda x: F.when(w > 0, F.greatest(F.ceil(x), F.lit(least))).otherwise(0).cast("long")
    return rows.withColumn("count_bin", count(w / F.col("top__") * scale)).withColumn("count_log", count(F.log1p(w) * scale)).drop("top__")


def top_terms(df: DataFrame, n: int, by: str = "doc_id", weight: str = "weight", tie: str = "term_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(weight), tie)
    return df.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= n).drop("n__")


def min_document_frequency(df: DataFrame, least: int) -> DataFrame:
    often = df.groupBy("term_id").agg(F.countDistinct("doc_id").alias("df__")).where(F.col("df__") >= least)
    return df.join(often.select("term_id"), "term_id", "left_semi")


def document_terms(
    edges: DataFrame, term: str = "peak", weight: str = "delta_fp_score", top_n: int = 500, min_df: int = 2, scale: float = 50, distinct: bool = False, with_tfs: bool = False
) -> DataFrame:
    """(doc_id, term_id, weight, count_bin, count_log) from edges with ``doc_id``.

    Sites: |weight| summed (with ``distinct`` the largest per gene and site first). Genes: the largest
    per site, then summed (or the largest of all with ``distinct``).
    """
    v = F.abs(F.col(weight))
    rows = edges.withColumn("w__", v).where("w__ > 0")
    if term == "peak":
        name = F.concat(F.lit("PEAK:"), F.col("peak_id").cast("string"))
        if distinct:
            rows = rows.groupBy("doc_id", "peak_id", "gene_key").agg(F.max("w__").alias("w__"))
        terms = rows.groupBy("doc_id", name.alias("term_id")).agg(F.sum("w__").alias("weight"))
    else:
        name = F.concat(F.lit("GENE:"), F.col("gene_key"))
        per_site = rows.groupBy("doc_id", "gene_key", "peak_id").agg(F.max("w__").alias("w__"))
        terms = per_site.groupBy("doc_id", name.alias("term_id")).agg((F.max if distinct else F.sum)("w__").alias("weight"))
    if with_tfs:
        tfs = rows.groupBy("doc_id", F.concat(F.lit("TF:"), F.col("tf")).alias("term_id")).agg(F.max("w__").alias("weight")) if "tf" in rows.columns else None
        terms = terms.unionByName(tfs) if tfs is not None else terms
    return weight_counts(min_document_frequency(top_terms(terms, top_n), min_df), scale=scale)


#: Presets: (term, weight).
PRESETS = {"peak_delta_fp": ("peak", "delta_fp_score"), "peak_fc_fp": ("peak", "fc_mag_fp_score"), "gene_fc_expr": ("gene", "fc_mag_gene_expr")}


def preset_terms(edges: DataFrame, preset: str, **options) -> DataFrame:
    term, weight = PRESETS[preset]
    return document_terms(edges, term, weight, **options)


def joint_terms(edges: DataFrame, peak_weight: str = "delta_fp_score", gene_weight: str = "fc_mag_gene_expr", balance: str = "min", count: str = "count_bin", min_df: int = 2, top_n: int = 500, scale: float = 50) -> DataFrame:
    """Sites and genes in one table, of one pass over the edges; with ``balance="min"`` each document's
    modalities are scaled to the smaller total (rounded half to even, zeros dropped)."""
    links = edges.select("doc_id", "gene_key", "peak_id", F.abs(F.col(peak_weight)).alias("p__"), F.abs(F.col(gene_weight)).alias("g__")).where("p__ > 0 or g__ > 0")
    links = links.groupBy("doc_id", "gene_key", "peak_id").agg(F.sum(F.when(F.col("p__") > 0, F.col("p__"))).alias("p__"), F.max(F.when(F.col("g__") > 0, F.col("g__"))).alias("g__"))
    named = lambda modality, name, w: F.struct(F.lit(modality).alias("modality"), F.concat(F.lit(f"{modality.upper()}:"), F.col(name).cast("string")).alias("term_id"), F.col(w).alias("w__"))
    both = links.select("doc_id", F.explode(F.array(named("peak", "peak_id", "p__"), named("gene", "gene_key", "g__"))).alias("t")).select("doc_id", "t.*").where("w__ is not null")
    terms = both.groupBy("doc_id", "modality", "term_id").agg(F.sum("w__").alias("weight"))
    w = Window.partitionBy("doc_id", "modality").orderBy(F.desc("weight"), "term_id")
    terms = min_document_frequency(terms.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= top_n).drop("n__"), min_df)
    top = terms.agg(*[F.max(F.when(F.col("modality") == m, F.col("weight"))).alias(m) for m in ("peak", "gene")])
    share = {"count_bin": F.col("weight") / F.when(F.col("modality") == "peak", F.col("peak")).otherwise(F.col("gene")), "count_log": F.log1p("weight")}[count]
    rows = terms.crossJoin(F.broadcast(top)).select("doc_id", "modality", "term_id", F.greatest(F.ceil(share * scale), F.lit(1)).cast("long").alias("n"))
    if balance == "min":
        sums = rows.groupBy("doc_id").agg(*[F.sum(F.when(F.col("modality") == m, F.col("n"))).alias(m) for m in ("peak", "gene")]).where("peak is not null and gene is not null")
        own = F.when(F.col("modality") == "peak", F.col("peak")).otherwise(F.col("gene"))
        rows = rows.join(sums, "doc_id").withColumn("n", F.bround(F.col("n") * F.least("peak", "gene") / own).cast("long")).where("n > 0")
    return min_document_frequency(rows.groupBy("doc_id", "term_id").agg(F.sum("n").alias("pseudo_count")), min_df)


def pooled_terms(edges: DataFrame, which: str = "abs", min_abs: float | None = None, boosts: Sequence[tuple[str, float]] = (), doc: Sequence[str] = ("comparison_id", "tf"), term: str = "gene_key", top_n: int = 500, min_df: int = 2, q: float = 0.9) -> DataFrame:
    """(doc_id, term_id, weight): |delta|, gain or loss of link scores, times 1 + b min(1, x / q90) for
    each boost column (name, b)."""
    d = F.col("delta_link_score")
    w = {"abs": F.abs(d), "gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0))}[which]
    rows = edges.where(F.abs(d) >= min_abs) if min_abs is not None else edges
    rows = rows.withColumn("w__", w)
    if boosts:
        sizes = rows.select(*[F.abs(c).cast("double").alias(f"s{i}__") for i, (c, _) in enumerate(boosts)])
        for i in range(len(boosts)):
            rows = rows.crossJoin(F.broadcast(exact_quantile(sizes, f"s{i}__", q, f"q{i}__")))
        for i, (c, b) in enumerate(boosts):
            share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs(c), F.col(f"q{i}__")), F.lit(0.0)))
            rows = rows.withColumn("w__", F.col("w__") * (1 + b * share))
    terms = rows.where("w__ > 0").groupBy(F.concat_ws("::", *doc).alias("doc_id"), F.col(term).cast("string").alias("term_id")).agg(F.sum("w__").alias("weight"))
    return min_document_frequency(top_terms(terms, top_n), min_df)


def gene_documents(edges: DataFrame, doc: str = "gene", term: str = "tf", **options) -> DataFrame:
    """Genes (or comparison::gene) as documents, factors or sites as terms."""
    return pooled_terms(edges, doc=("gene_key",) if doc == "gene" else ("comparison_id", "gene_key"), term={"tf": "tf", "peak": "peak_id"}[term], **options)


def index_terms(doc_term: DataFrame, count: str = "pseudo_count") -> tuple[DataFrame, DataFrame]:
    """(documents with sparse vectors, vocabulary): terms numbered by order over all tasks, documents
    as one vector each."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    terms = doc_term.select("term_id").distinct().withColumn("all__", F.lit(1))
    vocab = numbered_within(terms, ["all__"], ["term_id"], "i").select("term_id", F.col("i").cast("int").alias("i"))
    n = vocab.count()
    rows = doc_term.join(vocab, "term_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col(count).cast("double").alias("v")))).alias("x"))
    build = F.udf(lambda x: SparseVector(n, [(r["i"], r["v"]) for r in x]), VectorUDT())
    return rows.select("doc_id", build("x").alias("features")), vocab


@dataclass
class TopicModel:
    """theta (doc_id, topic, theta), phi (topic, term_id, phi), and figures of the fit."""

    theta: DataFrame
    phi: DataFrame
    metrics: dict


def fit_lda(doc_term: DataFrame, k: int, count: str = "pseudo_count", rounds: int = 20, seed: int = 1, optimizer: str = "em") -> TopicModel:
    """LDA by the distributed library; topics number from 1, priors 50/K and 0.1 above the optimizer's least."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    docs, vocab = index_terms(doc_term, count)
    docs = docs.persist()
    lda = LDA(k=k, maxIter=rounds, seed=seed, optimizer=optimizer, docConcentration=[50.0 / k + 1], topicConcentration=1.1) if optimizer == "em" else LDA(k=k, maxIter=rounds, seed=seed, optimizer="online")
    model = lda.fit(docs)
    spread = lambda df, c: df.select("*", F.posexplode(vector_to_array(c)).alias("at", "x"))
    theta = spread(model.transform(docs).select("doc_id", "topicDistribution"), "topicDistribution").select("doc_id", (F.col("at") + 1).alias("topic"), F.col("x").alias("theta"))
    m = model.topicsMatrix().toArray()
    m = m / m.sum(0)
    phi = doc_term.sparkSession.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(m.shape[0]), k), "topic": np.tile(np.arange(1, k + 1), m.shape[0]), "phi": m.reshape(-1)}))
    phi = phi.join(vocab.withColumn("i", F.col("i").cast("long")), "i").select("topic", "term_id", "phi")
    return TopicModel(theta, phi, {"k": k} | perplexity(doc_term, theta, phi, count))


def fit_sampled_lda(doc_term: DataFrame, k: int, count: str = "pseudo_count", sweeps: int = 50, alpha: float | None = None, beta: float = 0.1, seed: int = 1) -> TopicModel:
    """LDA by sampling with delayed counts, priors 50/K and 0.1; see ``sample_topics``."""
    from weftlink.operators.warp import sample_topics

    # Staged: the perplexity is taken over the same terms.
    doc_term = staged(doc_term.select("doc_id", "term_id", count), "doc-terms")
    theta, phi = sample_topics(doc_term, k, count, sweeps, alpha, beta, seed)
    return TopicModel(theta, phi, {"k": k} | perplexity(doc_term.where(F.col(count) >= 1), theta, phi, count))


def perplexity(doc_term: DataFrame, theta: DataFrame, phi: DataFrame, count: str = "pseudo_count") -> dict:
    """exp(-log likelihood per token) of counts under theta phi."""
    p = doc_term.join(theta, "doc_id").join(phi, ["topic", "term_id"]).groupBy("doc_id", "term_id").agg(F.first(count).alias("n"), F.sum(F.col("theta") * F.col("phi")).alias("p"))
    r = p.agg(F.sum(F.col("n") * F.log(F.greatest("p", F.lit(1e-300)))).alias("ll"), F.sum("n").alias("n")).first()
    return {"loglik": r.ll, "n_tokens": r.n, "perplexity": float(np.exp(-r.ll / r.n)) if r.n else None}


def fit_grid(doc_term: DataFrame, ks: Sequence[int], **options) -> dict[int, TopicModel]:
    return {k: fit_lda(doc_term, k, **options) for k in ks}


def select_models(metrics: Sequence[dict]) -> dict[str, int]:
    """k of the largest log likelihood, the smallest perplexity and the sharpest bend of log likelihood."""
    rows = sorted(metrics, key=lambda r: r["k"])
    bend = {rows[i]["k"]: rows[i + 1]["loglik"] - 2 * rows[i]["loglik"] + rows[i - 1]["loglik"] for i in range(1, len(rows) - 1)}
    return {"loglik": max(rows, key=lambda r: r["loglik"])["k"], "perplexity": min(rows, key=lambda r: r["perplexity"])["k"]} | ({"bend": max(bend, key=lambda k: bend[k])} if bend else {})


def fit_nmf(doc_term: DataFrame, k: int, count: str = "weight", runs: int = 1, rounds: int = 100, seed: int = 1, method: str = "brunet", **options) -> TopicModel:
    """Non-negative factors of the sparse table by multiplicative updates (``brunet``, ``lee``, ``nsNMF``), best of several
    starts; theta are a document's shares, phi those of a topic's terms. See ``factors``."""
    from weftlink.operators.factorise import column_sums, factors, numbers

    w, h, figures = factors(doc_term, k, count, method, runs, rounds, seed, **options)
    spread = lambda df, name, to, share: df.select(F.col(name).alias(to), F.posexplode(share).alias("at", "x")).withColumn("topic", (F.col("at") + 1).cast("int"))
    scale, total = numbers(column_sums(h, k)) if figures["losses"] else numbers(np.ones(k)), F.aggregate("f", F.lit(0.0), lambda s, x: s + x)
    theta = spread(w, "d", "doc_id", F.transform("f", lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))).select("doc_id", "topic", F.col("x").alias("theta"))
    phi = spread(h, "t", "term_id", F.zip_with("f", scale, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)))).select("topic", "term_id", F.col("x").alias("phi"))
    return TopicModel(theta, phi, figures | {"divergence": figures["loss"]})


def assign_topics(theta: DataFrame, cutoff: float = 0.2, top_n: int | None = None, sep: str = ";") -> DataFrame:
    """(doc_id, topics): topics at or above the cutoff (or the best n), packed in order of number."""
    if top_n is not None:
        w = Window.partitionBy("doc_id").orderBy(F.desc("theta"), "topic")
        rows = theta.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= top_n)
    else:
        rows = theta.where(F.col("theta") >= cutoff)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("topic")), lambda x: x.cast("string")), sep).alias("topics"))


def annotate_links(links: DataFrame, k: int, which: str = "abs", min_df: int = 2, cutoff: float = 0.2, seed: int = 1, **options) -> DataFrame:
    """Links with the packed topics of their factor, from an LDA of factors over genes with counts of
    max(1, round(10 w / q90))."""
    terms = pooled_terms(links, which, doc=("tf",), min_df=min_df)
    q = exact_quantile(terms, "weight", 0.9, "q__")
    counts = terms.crossJoin(F.broadcast(q)).withColumn("pseudo_count", F.greatest(F.lit(1), F.bround(10 * F.col("weight") / F.col("q__")).cast("long")))
    model = fit_lda(counts, k, seed=seed, **options)
    return links.join(assign_topics(model.theta, cutoff).withColumnRenamed("doc_id", "tf"), "tf", "left")


def _topic_list(df: DataFrame) -> Column:
    """The topics of ``df`` in order, as an array."""
    kind = df.schema["topic"].dataType
    return F.array(*[F.lit(r.topic).cast(kind) for r in df.select("topic").distinct().orderBy("topic").collect()]).cast(f"array<{kind.simpleString()}>")


def _by_topic(df: DataFrame, key: str, topics: Column, value: Column, out: str) -> tuple[DataFrame, int]:
    """(key, out): values of each key in the order of ``topics``, null where there is none; and the number of keys.

    ``df`` has one row a topic and key. Staged, as it is joined to links and counted.
    """
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("topic", value.alias("v"))).alias("x__"))
    in_order = F.transform(topics, lambda t: F.get(F.filter("x__", lambda x: x["topic"] == t), 0)["v"])
    rows = staged(per.select(key, in_order.alias(out)), "by-topic")
    return rows, rows.count()


def _links_with(edges: DataFrame, site: tuple[DataFrame, int], others: dict[str, tuple[tuple[DataFrame, int], str]]) -> DataFrame:
    """Distinct links (doc_id, tf, gene_key, peak_id) with the arrays of their site and of other columns.

    Many sites: links are shuffled once, by site, for the distinct and the join. Few: nothing but for the distinct.
    """
    links = edges.select("doc_id", "tf", "gene_key", F.col("peak_id").cast("string").alias("peak_id"))
    links = (links if site[1] <= FEW else links.repartition("peak_id")).distinct().join(small(*site), "peak_id", "left")
    for key, (table, how) in others.items():
        links = links.join(small(*table), key, how)
    return links


def edge_topics(edges: DataFrame, theta: DataFrame, phi: DataFrame, top_n: int = 1, min_score: float | None = None, sum_sites: bool = False) -> DataFrame:
    """The best topics of each edge by theta(document, topic) x phi(topic, gene).

    Documents and genes come to an edge with all their topics, which are ranked within its row.
    """
    keys = ["doc_id", "tf", "gene_key"] + ([] if sum_sites else ["peak_id"])
    theta = staged(theta.select("doc_id", "topic", "theta").where("topic is not null"), "theta")
    topics = _topic_list(theta)
    doc, gene = _by_topic(theta, "doc_id", topics, F.col("theta"), "t__"), _by_topic(phi.withColumnRenamed("term_id", "gene_key"), "gene_key", topics, F.col("phi"), "g__")
    rows = edges.select(*keys).distinct().join(small(*doc), "doc_id").join(small(*gene), "gene_key")
    score = lambda t, i: F.get("t__", i) * F.get("g__", i)
    held = F.filter(F.transform(topics, lambda t, i: F.struct((-score(t, i)).alias("less"), t.alias("topic"), score(t, i).alias("score"))), lambda x: x["score"].isNotNull())
    if min_score is not None:
        held = F.filter(held, lambda x: x["score"] >= min_score)
    best = F.slice(F.array_sort(held), 1, top_n)
    rows = rows.select(*keys, F.posexplode(best).alias("at__", "x__"))
    return rows.select(*keys, "x__.topic", "x__.score", (F.col("at__") + 1).alias("topic_rank"))


def normalised_scores(phi: DataFrame) -> DataFrame:
    """phi over the topic's largest value, within 0..1."""
    top = F.max("phi").over(Window.partitionBy("topic"))
    return phi.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("phi"), top), F.lit(0.0)))))


def term_class(term="term_id"):
    return F.when(F.col(term).startswith("PEAK:"), "PEAK").when(F.col(term).startswith("GENE:"), "GENE").otherwise("OTHER")


def gamma_cutoffs(scores: DataFrame, p: float = 0.975, min_terms: int = 50) -> DataFrame:
    """(topic, term_class, cutoff): quantile of a gamma fitted by moments, or the score of the
    ``min_terms``-th term where there is no fit."""
    rows = scores.withColumn("term_class", term_class())
    fit = rows.groupBy("topic", "term_class").agg(gamma_moments("score").alias("g"))
    w = Window.partitionBy("topic", "term_class").orderBy(F.desc("score"), "term_id")
    nth = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= min_terms).groupBy("topic", "term_class").agg(F.min("score").alias("nth"))
    rows = fit.join(nth, ["topic", "term_class"]).select("topic", "term_class", "g.shape", "g.rate", "nth")
    return rows.withColumn("fitted", gamma_cutoff("shape", "rate", F.lit(p))).select("topic", "term_class", F.coalesce("fitted", "nth").alias("cutoff"), F.col("fitted").isNotNull().alias("fitted"))


def binarize(scores: DataFrame, method: str = "gammafit", p: float = 0.975, top_n: int = 500, min_terms: int = 50) -> DataFrame:
    """(topic, term_id, score, in_topic): above the class's cutoff, at least the best ``min_terms``; or the best n."""
    w = Window.partitionBy("topic", "term_class").orderBy(F.desc("score"), "term_id")
    rows = scores.withColumn("term_class", term_class()).withColumn("i", F.row_number().over(w))
    if method == "topn":
        all_terms = Window.partitionBy("topic").orderBy(F.desc("score"), "term_id")
        return rows.withColumn("in_topic", F.row_number().over(all_terms) <= top_n).select("topic", "term_id", "score", "in_topic")
    cut = gamma_cutoffs(scores, p, min_terms)
    rows = rows.join(cut, ["topic", "term_class"], "left")
    return rows.select("topic", "term_id", "score", (F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False)) | (F.col("i") <= min_terms)).alias("in_topic"))


def _link_parts(edges: DataFrame, phi: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    peak = phi.where(F.col("term_id").startswith("PEAK:")).select("topic", F.expr("substring(term_id, 6)").alias("peak_id"), F.col(value).alias("peak_score"))
    gene = phi.where(F.col("term_id").startswith("GENE:")).select("topic", F.expr("substring(term_id, 6)").alias("gene_key"), F.col(value).alias("gene_score"))
    return peak, gene


def link_topic_scores(edges: DataFrame, theta: DataFrame, phi: DataFrame, in_topic: DataFrame | None = None, gate: str = "none", top_k: int = 3, min_prob: float = 0, with_tf: bool = False) -> DataFrame:
    """(doc_id, tf, gene_key, peak_id, topic, score, prob, topic_rank): theta x phi(site) x phi(gene)
    (x phi(factor)), topics being ranked within a link's row; gated by membership of gene, site, both or either; prob within the link, uniform
    where all scores are 0."""
    theta, phi = staged(theta.select("doc_id", "topic", "theta").where("topic is not null"), "theta"), staged(phi, "phi")
    topics, one = _topic_list(theta), F.struct(F.col("theta").alias("x"))
    parts = _link_parts(edges, phi, "phi")
    others = {"doc_id": (_by_topic(theta, "doc_id", topics, one, "t__"), "inner"), "gene_key": (_by_topic(parts[1], "gene_key", topics, F.col("gene_score"), "g__"), "left")}
    factors = ["g__", "p__"]
    if with_tf:
        tf = phi.where(F.col("term_id").startswith("TF:")).select("topic", F.expr("substring(term_id, 4)").alias("tf"), "phi")
        others["tf"] = (_by_topic(tf, "tf", topics, F.col("phi"), "f__"), "left")
        factors.append("f__")
    rows = _links_with(edges, _by_topic(parts[0], "peak_id", topics, F.col("peak_score"), "p__"), others)
    inside = F.lit(True)
    at = lambda c, i: F.get(c, i)
    if gate != "none" and in_topic is not None:
        on = staged(in_topic.where("in_topic").withColumn("one__", F.lit(1.0)), "members")
        p, g = _link_parts(edges, on, "one__")
        rows = rows.join(small(*_by_topic(p, "peak_id", topics, F.col("peak_score"), "pin__")), "peak_id", "left").join(small(*_by_topic(g, "gene_key", topics, F.col("gene_score"), "gin__")), "gene_key", "left")

    def score(i: Column) -> Column:
        s = at("t__", i)["x"]
        for c in ("p__", "g__", *factors[2:]):
            s = s * F.coalesce(at(c, i), F.lit(0.0))
        if gate != "none" and in_topic is not None:
            pin, gin = at("pin__", i).isNotNull(), at("gin__", i).isNotNull()
            s = F.when({"peak": pin, "gene": gin, "both": pin & gin, "either": pin | gin}[gate], s).otherwise(0.0)
        return s

    held = F.filter(F.transform(topics, lambda t, i: F.struct(at("t__", i).isNotNull().alias("here"), t.alias("topic"), score(i).alias("score"))), lambda x: x["here"])
    total = F.aggregate("s__", F.lit(0.0), lambda a, x: a + F.coalesce(x["score"], F.lit(0.0)))
    prob = lambda x: F.when(F.col("all__") > 0, x["score"] / F.col("all__")).otherwise(F.lit(1.0) / F.size("s__"))
    keys = ["doc_id", "tf", "gene_key", "peak_id"]
    rows = rows.select(*keys, held.alias("s__")).select(*keys, "s__", total.alias("all__"))
    ranked = F.array_sort(F.transform("s__", lambda x: F.struct(prob(x).isNull().alias("none"), (-prob(x)).alias("less"), x["topic"].alias("topic"), x["score"].alias("score"), prob(x).alias("prob"))))
    rows = rows.select(*keys, F.posexplode(F.slice(ranked, 1, top_k)).alias("at__", "x__"))
    return rows.select(*keys, "x__.topic", "x__.score", "x__.prob", (F.col("at__") + 1).alias("topic_rank")).where(F.col("prob") >= min_prob)


#: Rows of a group that one task of a round orders, about.
PERMUTED_ROWS = 8_000_000


def empirical_fdr(rows: DataFrame, by: str = "topic", rounds: int = 100, seed: int = 1) -> DataFrame:
    """Adds ``p_perm``: share of permuted products of site and gene score at least as large as a link's,
    per group, counting the observed one; and q over the group.

    A group's rows are numbered once. In each round they are ordered by a hash of round and number, and the gene score in
    place i is paired with the site score of number i. Products are counted by value, and a link's count is sought among
    the counted values, so rounds are sums and a group is as many tasks as it fills. The same seed gives the same result.
    """
    keys = [c for c in rows.columns if c not in ("peak_score", "gene_score", by)]
    score = lambda c: F.col(c).cast("double")
    base = staged(numbered_within(rows, [by], [*keys, "peak_score", "gene_score"], "i__").withColumn("obs__", score("peak_score") * score("gene_score")), "links")
    runs = base.select(by, F.col("i__").alias("at__"), F.lit(1).cast("long").alias("n__"), "peak_score", "gene_score")
    found = permuted_p(runs, runs, base.select(by, F.col("obs__").alias("x"), F.lit(1).cast("long").alias("n__")), by, rounds, seed, PERMUTED_ROWS)
    on = [*same("b", "f", [by]), F.col("b.obs__") == F.col("f.x")]
    return base.alias("b").join(found.alias("f"), on, "left").select(*[f"b.`{c}`" for c in rows.columns], "f.p_perm", "f.q_perm")


def _permuted_links(links: DataFrame, pairs: DataFrame, rounds: int, seed: int) -> DataFrame:
    """``empirical_fdr`` of every link in every topic, for ``links`` (gene_key, peak_id, ...) and ``pairs`` (gene_key, peak_id,
    x__) with an array of scores by topic: links of a gene and a site have equal scores, so runs of them are permuted, and
    p and q go into the arrays. The links' order is by gene, site and the rest, the same in all topics."""
    sized = links.groupBy("gene_key", "peak_id").agg(F.count(F.lit(1)).alias("n__"))
    on = same("n", "x", ["gene_key", "peak_id"])
    sized = sized.alias("n").join(pairs.alias("x"), on).select("n.*", "x.x__")
    placed = staged(running_start(sized, ["gene_key", "peak_id"], "n__", "at__"), "pairs")
    runs = placed.select("gene_key", "peak_id", "at__", "n__", F.posexplode("x__").alias("t__", "e__"))
    runs = runs.select("gene_key", "peak_id", "at__", "n__", "t__", "e__", "e__.topic", "e__.peak_score", "e__.gene_score")
    genes = runs.groupBy("topic", "gene_key").agg(F.min("at__").alias("at__"), F.sum("n__").alias("n__"), F.first("gene_score").alias("gene_score"))
    found = staged(permuted_p(runs, genes, runs.select("topic", F.col("e__.link_score").alias("x"), "n__"), "topic", rounds, seed, PERMUTED_ROWS), "permuted")
    both = runs.alias("r").join(small(found, found.count()).alias("f"), [*same("r", "f", ["topic"]), F.col("r.e__.link_score") == F.col("f.x")], "left")
    entry = F.struct("r.t__", F.col("r.e__").withField("p_perm", F.col("f.p_perm")).withField("q_perm", F.col("f.q_perm")).alias("e"))
    return both.groupBy("r.at__", "r.gene_key", "r.peak_id").agg(F.sort_array(F.collect_list(entry)).alias("x__")).select("gene_key", "peak_id", F.col("x__.e").alias("x__"))


def topic_links(edges: DataFrame, scores: DataFrame, in_topic: DataFrame, method: str = "link_score_prob", prob_cutoff: float = 0.3, fdr: float = 0.2, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Every link in every topic with site and gene score, membership of both, probability of the link
    (score share) and of the gene, and whether the link passes by the method: ``link_score_prob``,
    ``gene_prob`` or ``link_score_efdr``."""
    terms = scores.select("topic", "term_id", "score").join(in_topic.where("in_topic").select("topic", "term_id", F.lit(True).alias("in__")), ["topic", "term_id"], "full")
    terms = staged(terms.withColumn("v__", F.struct(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"), F.coalesce("in__", F.lit(False)).alias("pass"))), "terms")
    topics = _topic_list(scores)
    peak, gene = _link_parts(edges, terms, "v__")
    site, others = _by_topic(peak, "peak_id", topics, F.col("peak_score"), "p__"), {"gene_key": (_by_topic(gene, "gene_key", topics, F.col("gene_score"), "g__"), "left")}
    value = lambda c, i: F.coalesce(F.get(c, i)["score"], F.lit(0.0))
    passes = lambda c, i: F.coalesce(F.get(c, i)["pass"], F.lit(False))
    entry = lambda t, i: F.struct(t.alias("topic"), value("p__", i).alias("peak_score"), value("g__", i).alias("gene_score"), passes("p__", i).alias("peak_pass"), passes("g__", i).alias("gene_pass"), (value("p__", i) * value("g__", i)).alias("link_score"))
    total = lambda c: F.aggregate("x__", F.lit(0.0), lambda a, x: a + x[c])
    keys = ["gene_key", "peak_id", "doc_id", "tf"]
    by_topic = F.transform(topics, entry).alias("x__")
    if method == "link_score_efdr":
        links = staged(edges.select("gene_key", F.col("peak_id").cast("string").alias("peak_id"), "doc_id", "tf").distinct(), "links")
        pairs = links.select("gene_key", "peak_id").distinct().join(small(*site), "peak_id", "left").join(small(*others["gene_key"][0]), "gene_key", "left")
        permuted = _permuted_links(links, pairs.select("gene_key", "peak_id", by_topic), rounds, seed)
        rows = links.alias("l").join(permuted.alias("p"), same("l", "p", ["gene_key", "peak_id"])).select("l.*", "p.x__")
    else:
        rows = _links_with(edges, site, others).select(*keys, by_topic)
    tested = ("p_perm", "q_perm") if method == "link_score_efdr" else ()
    rows = rows.select(*keys, total("link_score").alias("links__"), total("gene_score").alias("genes__"), F.size("x__").alias("n__"), F.explode("x__").alias("e__"))
    share = lambda c, t: F.when(F.col(t) > 0, F.col(f"e__.{c}") / F.col(t)).otherwise(F.lit(1.0) / F.col("n__"))
    rows = rows.select("e__.topic", *keys, *[f"e__.{c}" for c in ("peak_score", "gene_score", "peak_pass", "gene_pass", "link_score")], share("link_score", "links__").alias("link_prob"), share("gene_score", "genes__").alias("gene_prob"), *[f"e__.{c}" for c in tested])
    member = F.col("peak_pass") & F.col("gene_pass")
    if method == "link_score_efdr":
        return rows.withColumn("link_pass", member & (F.col("q_perm") <= fdr))
    prob = {"link_score_prob": "link_prob", "gene_prob": "gene_prob"}[method]
    return rows.withColumn("link_pass", member & (F.col(prob) >= prob_cutoff))


def passing_links(rows: DataFrame, prob: str = "link_prob", min_prob: float = 0) -> DataFrame:
    return rows.where(F.col("link_pass") & (F.col(prob) >= min_prob)).select("doc_id", "tf", "gene_key", "peak_id", "topic", F.col("link_score").alias("score"), F.col(prob).alias("prob"))


def link_gene_sets(link_scores: DataFrame, min_prob: float = 0, with_tfs: bool = True, tf_top_n: int | None = None, tf_max_topics: int | None = None) -> DataFrame:
    """(topic, gene) of genes with enough probability and of factors, the best n a topic, none that
    spans too many topics."""
    rows = link_scores.where(F.col("prob") >= min_prob)
    genes = rows.select("topic", F.col("gene_key").alias("gene"))
    if not with_tfs:
        return genes.distinct()
    tfs = rows.groupBy("topic", "tf").agg(F.max("prob").alias("prob"))
    if tf_max_topics is not None:
        tfs = tfs.withColumn("k__", F.count(F.lit(1)).over(Window.partitionBy("tf"))).where(F.col("k__") <= tf_max_topics)
    if tf_top_n is not None:
        tfs = tfs.withColumn("i__", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("prob"), "tf"))).where(F.col("i__") <= tf_top_n)
    return genes.union(tfs.select("topic", F.col("tf").alias("gene"))).distinct()


def theta_tfs(theta: DataFrame, edges: DataFrame, top_n: int = 50, min_theta: float | None = None) -> DataFrame:
    """(topic, tf, theta): factors of each topic's best documents."""
    w = Window.partitionBy("topic").orderBy(F.desc("theta"), "doc_id")
    best = theta.withColumn("i__", F.row_number().over(w)).where(F.col("i__") <= top_n)
    best = best.where(F.col("theta") >= min_theta) if min_theta is not None else best
    return best.join(edges.select("doc_id", "tf").distinct(), "doc_id").groupBy("topic", "tf").agg(F.max("theta").alias("theta"))


def topic_genes(in_topic: DataFrame, edges: DataFrame, how: str = "max", theta: DataFrame | None = None, tf_top_n: int = 50) -> DataFrame:
    """(topic, gene, score): genes of a topic's terms (sites through their links), with the best or summed
    score; factors from theta count as genes of score theta."""
    agg = {"max": F.max, "sum": F.sum}[how]
    on = in_topic.where("in_topic")
    peak, gene = _link_parts(edges, on, "score")
    via = peak.join(edges.select(F.col("peak_id").cast("string").alias("peak_id"), "gene_key").distinct(), "peak_id").select("topic", F.col("gene_key").alias("gene"), F.col("peak_score").alias("score"))
    rows = gene.select("topic", F.col("gene_key").alias("gene"), F.col("gene_score").alias("score")).unionByName(via)
    if theta is not None:
        rows = rows.unionByName(theta_tfs(theta, edges, tf_top_n).select("topic", F.col("tf").alias("gene"), F.col("theta").alias("score")))
    return rows.groupBy("topic", "gene").agg(agg("score").alias("score"))


def coherence(doc_term: DataFrame, phi: DataFrame, top_n: int = 20, smooth: float = 1) -> DataFrame:
    """(topic, coherence): mean over pairs of a topic's best terms of log((D(i, j) + s) / D(j)), j the better."""
    w = Window.partitionBy("topic").orderBy(F.desc("phi"), "term_id")
    best = phi.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top_n).select("topic", "term_id", "i")
    docs = doc_term.select("doc_id", "term_id").distinct()
    n = docs.groupBy("term_id").agg(F.count(F.lit(1)).alias("d"))
    held = best.join(docs, "term_id")
    a, b = held.alias("a"), held.alias("b")
    both = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.i") > F.col("b.i")))
    both = both.groupBy(F.col("a.topic").alias("topic"), F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count(F.lit(1)).alias("dij"))
    x, y = best.alias("x"), best.join(n, "term_id").alias("y")
    pairs = x.join(y, (F.col("x.topic") == F.col("y.topic")) & (F.col("x.i") > F.col("y.i"))).select(F.col("x.topic").alias("topic"), F.col("x.i").alias("i"), F.col("y.i").alias("j"), F.col("y.d").alias("dj"))
    rows = pairs.join(both, ["topic", "i", "j"], "left")
    return rows.groupBy("topic").agg(F.avg(F.log((F.coalesce("dij", F.lit(0)) + smooth) / F.col("dj"))).alias("coherence"))


def term_specificity(phi: DataFrame, top_n: int = 20) -> DataFrame:
    """(topic, term_id, specificity, z): log2 of phi over the mean of the other topics; the best n terms a
    topic, each term to its best topic only; row z scores within 2.5."""
    k = F.count(F.lit(1)).over(Window.partitionBy("term_id"))
    s = F.sum("phi").over(Window.partitionBy("term_id"))
    rest = F.coalesce(F.try_divide(s - F.col("phi"), k - 1), F.lit(0.0))
    rows = phi.withColumn("specificity", F.log2(F.col("phi") + 1e-12) - F.log2(rest + 1e-12))
    z = F.try_divide(F.col("phi") - F.avg("phi").over(Window.partitionBy("term_id")), F.stddev_samp("phi").over(Window.partitionBy("term_id")))
    rows = rows.withColumn("z", F.greatest(F.lit(-2.5), F.least(F.lit(2.5), F.coalesce(z, F.lit(0.0)))))
    own = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc("specificity"), "topic"))
    rows = rows.withColumn("own", own).where("own = 1")
    best = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("specificity"), "term_id"))
    return rows.withColumn("i", best).where(F.col("i") <= top_n).select("topic", "term_id", "specificity", "z")


def tf_topic_weights(theta: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """(comparison_id, tf, topic, value): theta of documents dealt to factors by their share of weight (the
    largest per document, factor and gene, summed)."""
    per = edges.groupBy("comparison_id", "doc_id", "tf", "gene_key").agg(F.max(F.abs(weight)).alias("w")).groupBy("comparison_id", "doc_id", "tf").agg(F.sum("w").alias("w"))
    share = per.withColumn("share", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("doc_id"))), F.lit(0.0)))
    return share.join(theta, "doc_id").groupBy("comparison_id", "tf", "topic").agg(F.sum(F.col("share") * F.col("theta")).alias("value"))


def topics_by_comparison(theta: DataFrame, edges: DataFrame, by: str = "fp") -> DataFrame:
    """(comparison_id, direction, topic, theta): mean theta of documents, directed by the sign of their
    summed changes."""
    c = {"fp": "delta_fp_score", "gene": "log2FC_gene_expr"}[by]
    s = F.sum(F.signum(c))
    docs = edges.groupBy("comparison_id", "doc_id").agg(F.when(s > 0, "Up").when(s < 0, "Down").otherwise("Mixed").alias("way"))
    return docs.join(theta, "doc_id").groupBy("comparison_id", F.col("way").alias("direction"), "topic").agg(F.avg("theta").alias("theta"))


def pair_topic_maxima(link_scores: DataFrame, topics: Sequence, value: str = "prob", min_value: float = 0) -> DataFrame:
    """Largest value of each (tf::gene) by topic, absent ones 0."""
    rows = link_scores.where(F.col(value) >= min_value).withColumn("pair", F.concat_ws("::", "tf", "gene_key"))
    return rows.groupBy("pair").pivot("topic", list(topics)).agg(F.max(value)).na.fill(0.0)


def topic_distances(phi: DataFrame) -> DataFrame:
    """(a, b, distance): Jensen-Shannon divergence of topics; topics are few, terms are dealt."""
    a, b = phi.alias("a"), phi.alias("b")
    rows = a.join(b, (F.col("a.term_id") == F.col("b.term_id")) & (F.col("a.topic") < F.col("b.topic")))
    m = (F.col("a.phi") + F.col("b.phi")) / 2
    part = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return rows.groupBy(F.col("a.topic").alias("a"), F.col("b.topic").alias("b")).agg((F.sum(part(F.col("a.phi"))) / 2 + F.sum(part(F.col("b.phi"))) / 2).alias("distance"))


def topic_map(phi: DataFrame) -> list[tuple]:
    """(topic, x, y): classical scaling of topic distances, on a K x K table."""
    got = topic_distances(phi).toPandas()
    names = sorted({*got["a"], *got["b"]})
    at = {v: i for i, v in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for a, b, x in got.itertuples(index=False):
        d[at[a], at[b]] = d[at[b], at[a]] = np.sqrt(max(x, 0))
    j = np.eye(len(names)) - 1 / max(len(names), 1)
    value, vector = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    xy = vector[:, ::-1][:, :2] * np.sqrt(np.maximum(value[::-1][:2], 0))
    return [(n, float(xy[i, 0]), float(xy[i, 1]) if xy.shape[1] > 1 else 0.0) for i, n in enumerate(names)]


def score_histogram(rows: DataFrame, value: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(topic, bin, n) of a score."""
    return rows.groupBy("topic", F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def topic_counts(in_topic: DataFrame) -> DataFrame:
    """(topic, n_peaks, n_genes, n_other) of passing terms."""
    c = lambda k: F.countDistinct(F.when(F.col("in_topic") & (term_class() == k), F.col("term_id")))
    return in_topic.groupBy("topic").agg(c("PEAK").alias("n_peaks"), c("GENE").alias("n_genes"), c("OTHER").alias("n_other"))


def zscale(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """z scores within columns, then within rows."""
    z = lambda c, by: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(Window.partitionBy(by)), F.stddev_samp(c).over(Window.partitionBy(by))), F.lit(0.0))
    return df.withColumn("z__", z(value, column)).withColumn("z", z("z__", row)).drop("z__")


def merge_overlapping(gene_sets: DataFrame, threshold: float = 0.7, max_rows: int = 2_000_000) -> list[tuple]:
    """(topic, merged): in order of number, a topic takes in later ones of which it shares the threshold of
    either set, growing as it does. Sets come to the driver; their size is checked."""
    got = gene_sets.select("topic", "gene").distinct().limit(max_rows + 1).collect()
    if len(got) > max_rows:
        raise ValueError("gene sets are too large to merge on the driver")
    sets: dict = {}
    for r in got:
        sets.setdefault(r.topic, set()).add(r.gene)
    out, order = {}, sorted(sets)
    for i, t in enumerate(order):
        if t in out:
            continue
        out[t], held = t, set(sets[t])
        for u in order[i + 1 :]:
            if u not in out:
                both = len(held & sets[u])
                if both / len(held) >= threshold or both / len(sets[u]) >= threshold:
                    out[u] = t
                    held |= sets[u]
    return sorted(out.items())


def marker_overlap(sets: DataFrame, markers: DataFrame, universe: int, by: Sequence[str] = ("topic",)) -> DataFrame:
    """(by, set, n_topic, n_markers, overlap, coverage, p): shared genes of topics and marker sets, with
    the chance of as many. ``sets`` has (by, gene), ``markers`` (set, gene)."""
    from weftlink.functions.stats import fisher_p

    g = sets.select(*by, "gene").distinct()
    m = markers.select("set", "gene").distinct()
    sizes = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_topic"))
    of = m.groupBy("set").agg(F.count(F.lit(1)).alias("n_markers"))
    hit = g.join(m, "gene").groupBy(*by, "set").agg(F.count(F.lit(1)).alias("overlap"))
    rows = sizes.crossJoin(of).join(hit, [*by, "set"], "left").na.fill(0, ["overlap"])
    a, b = F.col("overlap"), F.col("n_topic") - F.col("overlap")
    c, d = F.col("n_markers") - F.col("overlap"), universe - F.col("n_topic") - F.col("n_markers") + F.col("overlap")
    odds = F.try_divide((a * d).cast("double"), (b * c).cast("double"))
    return rows.withColumn("coverage", F.try_divide(a.cast("double"), F.col("n_markers"))).withColumn("odds_ratio", odds).withColumn("p", fisher_p(a, b, c, d))


def exclusive_markers(edge_topics_: DataFrame, markers: DataFrame, top_n: int = 1, how: str = "mean") -> DataFrame:
    """(topic, set, n): each marker counts only in its best topics, by mean or summed score or edge count,
    ties to the smaller topic."""
    both = edge_topics_.select("topic", F.explode(F.array("gene_key", "tf")).alias("gene"), "score").join(markers, "gene")
    agg = {"mean": F.avg("score"), "sum": F.sum("score"), "count": F.count(F.lit(1)).cast("double")}[how]
    best = both.groupBy("set", "gene", "topic").agg(agg.alias("s"))
    w = Window.partitionBy("set", "gene").orderBy(F.desc("s"), "topic")
    return best.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top_n).groupBy("topic", "set").agg(F.countDistinct("gene").alias("n"))


def purity(counts: DataFrame) -> DataFrame:
    """Per set: the topic with most markers, its share of the set's and of the topic's markers."""
    total = F.sum("n").over(Window.partitionBy("topic"))
    own = F.sum("n").over(Window.partitionBy("set"))
    w = Window.partitionBy("set").orderBy(F.desc("n"), "topic")
    rows = counts.withColumn("purity", F.col("n") / total).withColumn("share", F.col("n") / own).withColumn("i", F.row_number().over(w))
    return rows.where("i = 1").select("set", F.col("topic").alias("best_topic"), "n", "purity", "share")


def fit_neural(doc_term: DataFrame, k: int, variant: str = "split", epochs: int = 200, batch: int = 64, hidden: int = 128, rate: float = 1e-3, seed: int = 1, count: str = "pseudo_count", embedding: int = 32) -> TopicModel:
    """A logistic-normal model trained by Adam on gradients summed over executors. Variants: ``plain`` (free phi), ``embedded``
    (phi from topic and word vectors), ``split`` (gene and site counts enter through layers of their own)."""
    from weftlink.operators.neural import fit_documents

    return TopicModel(*fit_documents(doc_term, k, variant, epochs, batch, hidden, rate, seed, count, embedding))
