"""One query an operator over the lens, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import stats
from weftlink.operators import benchmark, compare, correlate, enrich, graph, intervals, links, matrix, motif, topics
from weftlink.plans.lens import SQL, Lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that orders of summing don't show."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def query(sql: str | None = None, plain: bool = False):
    """Registers a function of a lens; its SQL may use the lens's views (``plain``: it brings its own)."""

    def add(f: Callable[[Lens], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: rounded(f(Lens(spark, folder)))
        if sql is not None:
            text = sql.strip()
            ORACLE_SQL[f.__name__] = text if plain else f"WITH RECURSIVE {SQL.strip()}" + (", " + text[5:].strip() if text.upper().startswith("WITH ") else "\n" + text)
        return f

    return add


# Two-sided p of a correlation, as a finite sum with gamma functions; 26 or other even degrees of freedom, and odd ones.
P = """CASE WHEN n < 3 OR r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0 WHEN (n - 2) % 2 = 0 THEN
  greatest(0, 1 - abs(r) * list_sum(list_transform(range(0, ((n - 2) // 2)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(1 - r * r, j))))
  ELSE greatest(0, 1 - 2 / pi() * (asin(abs(r)) + CASE WHEN n > 3 THEN abs(r) * list_sum(list_transform(range(0, ((n - 3) // 2)::BIGINT), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(sqrt(1 - r * r), 2 * j + 1))) ELSE 0 END)) END"""


def bh_sql(source: str, family: str = "") -> str:
    part = f"PARTITION BY {family} " if family else ""
    return (
        f"SELECT * EXCLUDE (raw), CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER ({part}ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) END AS p_adj FROM ("
        f"SELECT *, p * count(p) OVER ({part.strip()}) / (count(p) OVER ({part}ORDER BY p RANGE UNBOUNDED PRECEDING)) AS raw FROM {source})"
    )


CORR = f"""
c AS (SELECT peak, gene AS tf, count(*) AS n, CASE WHEN isnan(corr(fp.value, rna.value)) THEN NULL ELSE corr(fp.value, rna.value) END AS r
      FROM fp JOIN rna ON fp.sample = rna.sample JOIN tf_list ON gene = tf GROUP BY 1, 2),
cp AS (SELECT *, {P} AS p FROM c),
cq AS ({bh_sql("cp")})"""


@query(f"WITH {CORR} SELECT peak, tf, n::INT AS n, round(r, 6) AS r, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM cq WHERE r > 0.1 AND p_adj < 0.9")
def tf_footprint_correlation(l: Lens) -> DataFrame:
    found = correlate.correlate_tfs_to_footprints(l.annotation(), l.fp(), l.rna(), mode="all", tfs=l.tf_list())
    return correlate.passing(found, 0.1, 0.9)


@query(f"WITH {CORR} SELECT peak, tf, n::INT AS n, round(r, 6) AS r, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM ({bh_sql('cp', 'tf')})")
def tf_footprint_correlation_family(l: Lens) -> DataFrame:
    return correlate.correlate_tfs_to_footprints(l.annotation(), l.fp(), l.rna(), mode="all", tfs=l.tf_list(), family=("tf",))


TFS = """named AS (SELECT DISTINCT peak, unnest(string_split(gene_symbol, '::')) AS tf FROM annotation JOIN motif_db USING (motif))"""


@query(f"WITH {TFS}, {CORR} SELECT peak, tf, n::INT AS n, round(r, 6) AS r, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM ({bh_sql('(SELECT cp.* FROM cp JOIN named USING (peak, tf))')})")
def tf_footprint_correlation_canonical(l: Lens) -> DataFrame:
    return correlate.correlate_tfs_to_footprints(matrix.attach_tfs(l.annotation(), l.motif_db()), l.fp(), l.rna())


RANKS = """
j AS (SELECT peak, gene AS tf, fp.value AS a, rna.value AS b FROM fp JOIN rna ON fp.sample = rna.sample JOIN tf_list ON gene = tf),
k AS (SELECT peak, tf, rank() OVER (PARTITION BY peak, tf ORDER BY a) + (count(*) OVER (PARTITION BY peak, tf, a) - 1) / 2.0 AS a,
             rank() OVER (PARTITION BY peak, tf ORDER BY b) + (count(*) OVER (PARTITION BY peak, tf, b) - 1) / 2.0 AS b FROM j)"""


@query(f"WITH {RANKS}, s AS (SELECT peak, tf, count(*) AS n, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE corr(a, b) END AS r FROM k GROUP BY 1, 2) SELECT peak, tf, n::INT AS n, round(r, 6) AS r, round({P}, 6) AS p FROM s")
def tf_footprint_spearman(l: Lens) -> DataFrame:
    pairs = correlate.tf_footprint_pairs(l.annotation(), "all", l.tf_list())
    return correlate.correlate(pairs, l.fp(), l.rna().withColumnRenamed("gene", "tf"), "peak", "tf", "spearman")


@query("""WITH x AS (SELECT f.peak, r.gene AS tf, f.sample, f.value AS a, r.value AS b FROM fp f JOIN rna r ON f.sample = r.sample JOIN tf_list ON r.gene = tf_list.tf),
s AS (SELECT x.peak, x.tf, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum(abs(sign(x.a - y.a))) AS na, sum(abs(sign(x.b - y.b))) AS nb, count(DISTINCT x.sample) + 1 AS n
      FROM x JOIN x y ON x.peak = y.peak AND x.tf = y.tf AND x.sample < y.sample GROUP BY 1, 2)
SELECT peak, tf, n::INT AS n, round(s / sqrt(na) / sqrt(nb), 6) AS r FROM s""")
def tf_footprint_kendall(l: Lens) -> DataFrame:
    pairs = correlate.tf_footprint_pairs(l.annotation(), "all", l.tf_list())
    return correlate.correlate(pairs, l.fp(), l.rna().withColumnRenamed("gene", "tf"), "peak", "tf", "kendall").drop("p")


@query("""WITH c AS (SELECT f.peak, r.gene AS tf, count(*) AS n, corr(f.value, r.value) AS r0 FROM fp f JOIN rna r ON f.sample = r.sample JOIN tf_list ON r.gene = tf
  JOIN bound b ON b.peak = f.peak AND b.sample = f.sample AND b.value > 0 WHERE r.value >= 3000 GROUP BY 1, 2),
e AS (SELECT peak, tf FROM (SELECT DISTINCT peak FROM fp), tf_list JOIN (SELECT DISTINCT gene FROM rna) g ON g.gene = tf)
SELECT e.peak, e.tf, coalesce(n, 0)::INT AS n, CASE WHEN n >= 3 AND NOT isnan(r0) THEN round(r0, 6) END AS r FROM e LEFT JOIN c USING (peak, tf)""")
def gated_correlation(l: Lens) -> DataFrame:
    rna = l.rna().withColumnRenamed("gene", "tf")
    on = rna.select("tf", "sample", (F.col("value") >= 3000).cast("int").alias("value"))
    pairs = correlate.tf_footprint_pairs(l.annotation(), "all", l.tf_list())
    return correlate.correlate(pairs, l.fp(), rna, "peak", "tf", x_open=l.bound(), y_open=on).drop("p")


REGION = f"""
cand AS (SELECT DISTINCT s_nationkey AS region, p_brand AS gene FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT region, gene, count(*) AS n, CASE WHEN isnan(corr(a.value, r.value)) THEN NULL ELSE corr(a.value, r.value) END AS r FROM cand JOIN atac a USING (region) JOIN rna r USING (gene, sample) GROUP BY 1, 2),
cp AS (SELECT *, {P} AS p FROM c)"""


def _region_candidates(l: Lens) -> DataFrame:
    li = l.table("lineitem").join(l.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(l.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.col("s_nationkey").alias("region"), F.col("p_brand").alias("gene")).distinct()


@query(f"WITH {REGION} SELECT region, gene, n::INT AS n, round(r, 6) AS r, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM ({bh_sql('cp')})")
def region_gene_correlation(l: Lens) -> DataFrame:
    return correlate.correlate_regions_to_genes(_region_candidates(l), l.atac(), l.rna())


@query(f"WITH {REGION}, rows AS (SELECT a.peak, a.motif AS tf, a.motif, cp.gene, n, r, p FROM annotation a JOIN (SELECT DISTINCT peak, gene, n, r, p FROM (SELECT f.peak, k.gene, count(*) AS n, CASE WHEN isnan(corr(f.value, r.value)) THEN NULL ELSE corr(f.value, r.value) END AS r FROM (SELECT DISTINCT peak, gene FROM annotation JOIN cand USING (region)) k JOIN fp f USING (peak) JOIN rna r USING (gene, sample) GROUP BY 1, 2) z, LATERAL (SELECT {P} AS p)) cp USING (peak)) SELECT peak, gene, tf, motif, n::INT AS n, round(r, 6) AS r, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM ({bh_sql('rows')})")
def footprint_gene_correlation(l: Lens) -> DataFrame:
    rows = l.annotation().join(_region_candidates(l), "region").select("peak", "gene", F.col("motif").alias("tf"), "motif")
    return correlate.correlate_footprints_to_genes(rows, l.fp(), l.rna())


@query(f"WITH pairs AS (SELECT DISTINCT t.tf, g.gene FROM tf_list t, (SELECT DISTINCT gene FROM rna) g), c AS (SELECT tf, p.gene, count(*) AS n, corr(a.value, b.value) AS r FROM pairs p JOIN rna a ON a.gene = tf JOIN rna b ON b.gene = p.gene AND a.sample = b.sample GROUP BY 1, 2), cp AS (SELECT tf, gene, n, least(1, r) AS r, CASE WHEN r > 0.999999999 THEN 0 ELSE {P} END AS p FROM c) SELECT tf, p.gene, n::INT AS n_rna_tf, round(r, 6) AS r_rna_tf, round(cp.p, 6) AS p_rna_tf, round(p_adj, 6) AS p_adj_rna_tf FROM pairs p LEFT JOIN ({bh_sql('cp')}) cp USING (tf, gene)")
def tf_gene_correlation(l: Lens) -> DataFrame:
    genes = l.rna().select("gene").distinct()
    return correlate.add_tf_gene_correlation(l.tf_list().crossJoin(genes), l.rna())


@query(f"WITH c AS (SELECT peak, count(*) AS n, corr(f.value, r.value) AS r FROM fp f JOIN rna r ON f.sample = r.sample AND gene = 'Brand#7' GROUP BY 1), cp AS (SELECT *, {P} AS p FROM c) SELECT peak, n::INT AS n, round(r, 6) AS r, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM ({bh_sql('cp')})")
def one_tf_to_all_sites(l: Lens) -> DataFrame:
    return correlate.one_to_all(l.rna().where("gene = 'Brand#7'").select("sample", "value"), l.fp())


@query("SELECT gene, condition, round(avg(value), 6) AS value FROM rna JOIN samples USING (sample) GROUP BY 1, 2")
def condition_mean(l: Lens) -> DataFrame:
    return matrix.by_condition(l.rna(), l.samples(), ["gene"])


@query("SELECT peak, condition, round(quantile_cont(value::DOUBLE, 0.5), 6) AS value FROM fp JOIN samples USING (sample) GROUP BY 1, 2")
def condition_median(l: Lens) -> DataFrame:
    return matrix.by_condition(l.fp(), l.samples(), ["peak"], "median")


@query("SELECT region, condition, round(avg(value), 6) AS value FROM atac JOIN samples USING (sample) GROUP BY 1, 2")
def condition_mean_regions(l: Lens) -> DataFrame:
    return matrix.by_condition(l.atac(), l.samples(), ["region"])


FLAGS = "flags AS (SELECT gene, condition, (count(*) FILTER (value >= 3000) >= 2)::INT AS flag FROM rna JOIN samples USING (sample) GROUP BY 1, 2)"


@query(f"WITH {FLAGS} SELECT * FROM flags")
def expressed_by_condition(l: Lens) -> DataFrame:
    return matrix.expressed_flags(l.rna(), l.samples(), 3000, 2)


BOUND = """nb AS (SELECT b.peak, condition, count(*) FILTER (b.value > 0 AND f.value >= 520) AS n FROM bound b LEFT JOIN fp f USING (peak, sample) JOIN samples USING (sample) GROUP BY 1, 2),
no AS (SELECT region, condition, count(*) FILTER (value > 0) AS n FROM open JOIN samples USING (sample) GROUP BY 1, 2),
bc AS (SELECT peak, nb.condition, (nb.n >= 1 AND coalesce(no.n, 0) > 0)::INT AS flag FROM nb LEFT JOIN (SELECT peak, min(region) AS region FROM annotation GROUP BY 1) a USING (peak) LEFT JOIN no ON no.region = a.region AND no.condition = nb.condition)"""


def _bound(l: Lens) -> DataFrame:
    return matrix.bound_by_condition(l.bound(), l.fp(), l.overlap(), l.annotation(), l.samples(), 520)


@query(f"WITH {BOUND} SELECT * FROM bc")
def bound_by_condition(l: Lens) -> DataFrame:
    return _bound(l)


@query("SELECT b.peak, b.sample, (coalesce(b.value, 0) > 0 AND coalesce(o.value, 0) > 0)::INT AS value FROM bound b LEFT JOIN (SELECT peak, min(region) AS region FROM annotation GROUP BY 1) a USING (peak) LEFT JOIN open o ON o.region = a.region AND o.sample = b.sample")
def bound_and_open(l: Lens) -> DataFrame:
    return matrix.bound_and_open(l.bound(), l.overlap(), l.annotation())


@query("""WITH t AS (SELECT DISTINCT peak, unnest(string_split(gene_symbol, '::')) AS tf FROM annotation JOIN motif_db USING (motif)),
lit AS (SELECT DISTINCT peak, sample FROM t JOIN rna ON gene = tf WHERE value > 3400)
SELECT b.peak, b.sample, (coalesce(b.value, 0) > 0 AND l.peak IS NOT NULL)::INT AS value FROM bound b LEFT JOIN lit l USING (peak, sample) WHERE b.peak IN (SELECT peak FROM lit)""")
def bound_and_expressed(l: Lens) -> DataFrame:
    flags = matrix.tf_expression_flags(l.rna(), l.tf_list(), 3400)
    return matrix.bound_and_expressed(l.bound(), l.annotation(), l.motif_db(), flags)[0]


@query("SELECT peak, count(*) FILTER (value > 0) AS n_bound FROM bound GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 18")
def often_bound(l: Lens) -> DataFrame:
    return matrix.often_bound(l.bound(), 18)


@query("SELECT peak, count(*) FILTER (value > 0) AS n_bound FROM bound GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 5 AND count(*) = count(value)")
def often_bound_strict(l: Lens) -> DataFrame:
    return matrix.often_bound(l.bound(), 5, na_as_unbound=False)


@query("SELECT gene, count(*) FILTER (value >= CASE WHEN tf IS NULL THEN 3000 ELSE 3300 END) AS n_samples FROM rna LEFT JOIN tf_list ON gene = tf GROUP BY 1 HAVING count(*) FILTER (value >= CASE WHEN tf IS NULL THEN 3000 ELSE 3300 END) >= 4")
def expressed_genes(l: Lens) -> DataFrame:
    return matrix.expressed_genes(l.rna(), l.tf_list(), 3000, 3300, 4)


@query("SELECT gene, sample, (value > 3300)::INT AS flag FROM rna WHERE gene IN (SELECT tf FROM tf_list)")
def tf_expression_flags(l: Lens) -> DataFrame:
    return matrix.tf_expression_flags(l.rna(), l.tf_list(), 3300)


@query("SELECT peak, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var, round(stddev_samp(value) / avg(value), 6) AS rsd, count(*) AS n FROM fp GROUP BY 1")
def site_variance(l: Lens) -> DataFrame:
    return matrix.variance_table(l.fp(), "peak")


@query("""WITH v AS (SELECT peak, sample, CASE WHEN (peak * 3 + sample) % 11 <> 0 THEN value END AS value FROM fp),
p AS (SELECT *, CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY sample ORDER BY value NULLS LAST, peak) END AS i FROM v),
r AS (SELECT i, avg(value) AS ref FROM p WHERE i IS NOT NULL GROUP BY 1)
SELECT peak, sample, CASE WHEN value IS NOT NULL THEN round(avg(ref) OVER (PARTITION BY sample, value), 6) END AS value FROM p LEFT JOIN r USING (i)""")
def quantile_normalised(l: Lens) -> DataFrame:
    v = l.fp().withColumn("value", F.when((F.col("peak") * 3 + F.col("sample")) % 11 != 0, F.col("value")))
    return matrix.quantile_normalise(v)


@query(f"WITH {TFS} SELECT a.peak, region, motif, tfs FROM annotation a LEFT JOIN (SELECT peak, string_agg(tf, ',' ORDER BY tf) AS tfs FROM named GROUP BY 1) n USING (peak)")
def site_factors(l: Lens) -> DataFrame:
    return matrix.attach_tfs(l.annotation(), l.motif_db())


@query(f"WITH {TFS} SELECT a.peak, region, motif, tf FROM annotation a JOIN named USING (peak)")
def site_factor_rows(l: Lens) -> DataFrame:
    return matrix.expand_tfs(matrix.attach_tfs(l.annotation(), l.motif_db()))


@query("SELECT c_custkey AS sample, CASE WHEN count(*) OVER (PARTITION BY lab) > 1 THEN lab || '_' || c_custkey ELSE lab END AS label FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE c_mktsegment END AS lab FROM customer)")
def unique_labels(l: Lens) -> DataFrame:
    rows = l.table("customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("label"))
    return matrix.named_conditions(rows, "label")


@query("SELECT peak::VARCHAR AS peak, count(*) AS n_tables FROM (SELECT DISTINCT peak FROM fp UNION ALL SELECT DISTINCT peak FROM bound WHERE value > 0 UNION ALL SELECT DISTINCT peak FROM annotation) GROUP BY 1 HAVING count(*) < 3")
def unaligned_sites(l: Lens) -> DataFrame:
    return matrix.unaligned_keys(l.fp(), l.bound().where("value > 0"), l.annotation())


@query("SELECT tf FROM tf_list")
def factor_list(l: Lens) -> DataFrame:
    from weftlink.sources.tables import tf_list

    return tf_list(l.motif_db())


@query("""SELECT e.id, e.chrom, e.start, e."end", w.id AS r_id, w.chrom AS r_chrom, w.start AS r_start, w."end" AS r_end FROM ev e JOIN win w ON e.chrom = w.chrom AND e.start < w."end" AND e."end" > w.start""")
def interval_overlap(l: Lens) -> DataFrame:
    return intervals.overlap_join(l.events(), l.windows(), bin_size=1000)


@query("""SELECT e.id, w.id AS r_id FROM ev e LEFT JOIN win w ON e.chrom = w.chrom AND e.start <= w."end" AND e."end" >= w.start""")
def interval_overlap_closed_left(l: Lens) -> DataFrame:
    return intervals.overlap_join(l.events(), l.windows(), closed=True, bin_size=1000, how="left").select("id", "r_id")


@query("""WITH h AS (SELECT DISTINCT e.id FROM ev e JOIN win w ON e.chrom = w.chrom AND e.start < w."end" AND e."end" > w.start WHERE (least(e."end", w."end") - greatest(e.start, w.start))::DOUBLE / (e."end" - e.start) >= 0.5)
SELECT ev.id, (h.id IS NOT NULL)::INT AS truth FROM ev LEFT JOIN h USING (id)""")
def truth_by_overlap(l: Lens) -> DataFrame:
    return benchmark.truth_by_overlap(l.events(), l.windows())


@query("""WITH m AS (SELECT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS group_size FROM g GROUP BY chrom, k""")
def merged_intervals(l: Lens) -> DataFrame:
    return intervals.merged(l.events(), ["chrom"], "start", "end")


@query("""WITH d AS (SELECT e.id, w.id AS r_id, abs(w."end" - e.start) AS distance, row_number() OVER (PARTITION BY e.id ORDER BY abs(w."end" - e.start), w."end", w.id) AS i FROM ev e JOIN win w ON e.chrom = w.chrom AND abs(w."end" - e.start) <= 5000)
SELECT id, distance FROM d WHERE i = 1""")
def nearest_site(l: Lens) -> DataFrame:
    a = l.events().select("id", "chrom", F.col("start").alias("pos"))
    b = l.windows().select("id", "chrom", F.col("end").alias("pos"))
    return intervals.nearest(a, b, 5000, ["id"]).select("id", "distance")


@query("""WITH p AS (SELECT DISTINCT chrom, start, "end" FROM win), g AS (SELECT DISTINCT chrom, start AS tss, 'G' || id AS gene_key FROM ev)
SELECT DISTINCT p.chrom, p.start, p."end", gene_key, 'WIN_' || p.chrom || ':' || p.start || '-' || p."end" AS prior_id FROM p JOIN g ON p.chrom = g.chrom AND greatest(p.start - 2000, 0) < g.tss + 1 AND p."end" + 2000 > g.tss""")
def window_priors(l: Lens) -> DataFrame:
    genes = l.events().select("chrom", F.col("start").alias("tss"), F.concat(F.lit("G"), F.col("id").cast("string")).alias("gene_key"))
    return links.window_priors(l.windows().select("chrom", "start", "end").distinct(), genes, 2000)


@query("""SELECT DISTINCT e.id AS region, 'G' || w.id AS gene FROM ev e JOIN win w ON e.chrom = w.chrom AND e.start <= w."end" AND e."end" >= w.start""")
def prior_candidates(l: Lens) -> DataFrame:
    priors = l.windows().select("chrom", "start", "end", F.concat(F.lit("G"), F.col("id").cast("string")).alias("gene_key"))
    return links.prior_candidates(l.events().withColumnRenamed("id", "region"), priors)


def _sites(l: Lens) -> tuple[DataFrame, DataFrame]:
    s = l.table("supplier")
    ann = s.select(F.col("s_suppkey").alias("peak"), F.col("s_nationkey").cast("string").alias("region"), F.lit("chr1").alias("chrom"), (F.col("s_suppkey") * 15).cast("long").alias("start"), (F.col("s_suppkey") * 15 + 10).cast("long").alias("end"))
    scores = l.fp().withColumn("value", F.floor(F.col("value") / 400).cast("double"))
    return scores, ann


@query("""WITH site AS (SELECT s_suppkey AS peak, s_nationkey::VARCHAR AS region, s_suppkey * 15 AS start, s_suppkey * 15 + 10 AS "end" FROM supplier WHERE s_suppkey IN (SELECT peak FROM fp)),
names AS (SELECT DISTINCT sample FROM fp), cell AS (SELECT peak, sample, floor(value / 400) AS v FROM (SELECT peak FROM site) CROSS JOIN names LEFT JOIN fp USING (peak, sample)),
agree AS (SELECT x.peak AS a, y.peak AS b FROM site x JOIN site y USING (region) JOIN cell a ON a.peak = x.peak JOIN cell b ON b.peak = y.peak AND a.sample = b.sample
  GROUP BY 1, 2 HAVING count(*) FILTER (a.v IS NOT DISTINCT FROM b.v) >= ceil(0.5 * (SELECT count(*) FROM names))),
reach(a, b) AS (SELECT DISTINCT a, a FROM agree UNION SELECT r.a, g.b FROM reach r JOIN agree g ON r.b = g.a),
clus AS (SELECT a AS peak, min(b) AS cluster FROM reach GROUP BY 1),
m AS (SELECT *, (start + "end") // 2 AS mid FROM site JOIN clus USING (peak)),
c AS (SELECT *, max(mid + 200) OVER (PARTITION BY region, cluster ORDER BY mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m),
k AS (SELECT *, sum(CASE WHEN seen IS NULL OR mid - 200 > seen THEN 1 ELSE 0 END) OVER (PARTITION BY region, cluster ORDER BY mid ROWS UNBOUNDED PRECEDING) AS chain FROM c)
SELECT peak, region, 'chr1:' || min(start) OVER g || '-' || max("end") OVER g AS merged_id, count(*) OVER g AS group_size FROM k WINDOW g AS (PARTITION BY region, cluster, chain)""")
def aligned_sites(l: Lens) -> DataFrame:
    return intervals.align_sites(*_sites(l), slop=200, least=0.5)


@query(f"""WITH {FLAGS}, {BOUND}, lk AS (SELECT DISTINCT gene_key AS tf, gene_key, peak_id FROM links)
SELECT lk.tf, lk.gene_key, lk.peak_id, bc.condition, (bc.flag > 0 AND coalesce(f.flag, 0) > 0)::INT AS active FROM lk JOIN bc ON bc.peak = peak_id LEFT JOIN flags f ON f.gene = gene_key AND f.condition = bc.condition""")
def link_status(l: Lens) -> DataFrame:
    lk = l.links().select(F.col("gene_key").alias("tf"), "gene_key", "peak_id").distinct()
    return links.link_status(lk, _bound(l), matrix.expressed_flags(l.rna(), l.samples(), 3000, 2))


@query("SELECT tf, gene_key, peak_id, sum(active) AS n_active FROM standard GROUP BY 1, 2, 3 HAVING sum(active) > 0")
def ever_active(l: Lens) -> DataFrame:
    return links.ever_active(l.links())


LIGHT = f"""
{FLAGS}, {BOUND},
basal AS (SELECT DISTINCT gene_key AS tf, gene_key, peak_id, 0.5::DOUBLE AS r_gene FROM links UNION SELECT DISTINCT 'Brand#3', gene_key, peak_id, 0.5::DOUBLE FROM links),
fc AS (SELECT peak, condition, avg(value) AS value FROM fp JOIN samples USING (sample) GROUP BY 1, 2),
rc AS (SELECT gene, condition, avg(value) AS value FROM rna JOIN samples USING (sample) GROUP BY 1, 2),
lit AS (SELECT b.*, y.condition, coalesce(fc.value, 0) AS fp_score, coalesce(bc.flag, 0) AS fp_bound, coalesce(t.value, 0) AS tf_expr, coalesce(tf_.flag, 0) AS tf_expr_flag, coalesce(g.value, 0) AS gene_expr, coalesce(gf.flag, 0) AS gene_expr_flag
  FROM basal b CROSS JOIN years y LEFT JOIN fc ON fc.peak = b.peak_id AND fc.condition = y.condition LEFT JOIN bc ON bc.peak = b.peak_id AND bc.condition = y.condition
  LEFT JOIN rc t ON t.gene = b.tf AND t.condition = y.condition LEFT JOIN flags tf_ ON tf_.gene = b.tf AND tf_.condition = y.condition
  LEFT JOIN rc g ON g.gene = b.gene_key AND g.condition = y.condition LEFT JOIN flags gf ON gf.gene = b.gene_key AND gf.condition = y.condition),
lit2 AS (SELECT *, coalesce(tf_expr / nullif(sum(tf_expr) OVER (PARTITION BY condition, peak_id, gene_key), 0), 0) AS edge_weight, r_gene * fp_score AS link_score FROM lit)"""


def _lit(l: Lens) -> DataFrame:
    one = l.links()
    a = one.select(F.col("gene_key").alias("tf"), "gene_key", "peak_id")
    b = one.select(F.lit("Brand#3").alias("tf"), "gene_key", "peak_id")
    basal = a.union(b).distinct().withColumn("r_gene", F.lit(0.5))
    cond = lambda t, k: matrix.by_condition(t, l.samples(), [k])
    return links.light_by_condition(basal, l.samples(), cond(l.fp(), "peak"), _bound(l), cond(l.rna(), "gene"), matrix.expressed_flags(l.rna(), l.samples(), 3000, 2))


@query(f"""WITH {LIGHT} SELECT tf, gene_key, peak_id, condition, round(fp_score, 6) AS fp_score, round(edge_weight, 6) AS edge_weight, round(link_score, 6) AS link_score,
(fp_bound > 0 AND tf_expr_flag > 0 AND gene_expr_flag > 0 AND fp_score >= 1 AND tf_expr >= 10)::INT AS active_link FROM lit2""")
def links_by_condition(l: Lens) -> DataFrame:
    return _lit(l).select("tf", "gene_key", "peak_id", "condition", "fp_score", "edge_weight", "link_score", "active_link")


@query("""SELECT condition, tf, count(*) AS n_links, count(DISTINCT gene_key) AS n_genes FROM standard WHERE active > 0 GROUP BY 1, 2
UNION ALL SELECT condition, '__TOTAL__', count(*), count(DISTINCT gene_key) FROM standard WHERE active > 0 GROUP BY 1""")
def activity_summary(l: Lens) -> DataFrame:
    return links.activity_summary(l.links())


#: The conditions that the tables hold.
YEARS = list(range(1992, 1999))


@query("""SELECT coalesce(tf, '__TOTAL__') AS tf, """ + ", ".join(f'count(*) FILTER (condition = {y}) AS "{y}"' for y in YEARS) + """
FROM standard WHERE active > 0 GROUP BY ROLLUP (tf)""")
def activity_matrix(l: Lens) -> DataFrame:
    return links.activity_matrix(l.links(), YEARS)


@query("""WITH p AS (SELECT peak, gene, tf, motif, count(*) AS n FROM (SELECT peak, 'g' || (peak % 5) AS gene, motif AS tf, motif FROM annotation) GROUP BY ALL),
x AS (SELECT *, (peak % 10) / 10.0::DOUBLE AS r1, (peak % 7) / 7.0::DOUBLE AS r2, (peak % 9) / 500.0::DOUBLE AS q1, (peak % 8) / 500.0::DOUBLE AS q2, CASE WHEN peak % 6 = 0 THEN NULL ELSE (peak % 5) - 1.0::DOUBLE END AS rt FROM p)
SELECT peak, gene, tf, motif, round(r1, 6) AS r_pearson, round(r2, 6) AS r_spearman FROM x WHERE ((q1 < 0.01 AND r1 > 0.3) OR (q2 < 0.01 AND r1 > 0.3)) AND NOT (r1 < 0.3 OR r2 < 0.3 OR coalesce(rt < 0, FALSE))""")
def links_by_criteria(l: Lens) -> DataFrame:
    k = l.annotation().select("peak", F.concat(F.lit("g"), (F.col("peak") % 5).cast("string")).alias("gene"), F.col("motif").alias("tf"), "motif")
    stats_ = lambda r, q: k.select("*", F.lit(28).alias("n"), r.alias("r"), F.lit(0.0).alias("p"), q.alias("p_adj"))
    both = links.combine_methods(stats_(F.col("peak") % 10 / 10.0, F.col("peak") % 9 / 500.0), stats_(F.col("peak") % 7 / 7.0, F.col("peak") % 8 / 500.0))
    both = both.withColumn("r_rna_tf", F.when(F.col("peak") % 6 != 0, F.col("peak") % 5 - 1.0))
    return links.links_by_criteria(both).select("peak", "gene", "tf", "motif", "r_pearson", "r_spearman")


DELTA_COLS = ("comparison_id", "tf", "gene_key", "peak_id", "delta_link_score", "delta_fp_score", "log2FC_gene_expr", "log2FC_tf_expr", "edge_change", "active_both", "active_any", "rank_case", "rank_shift")


@query("""WITH r AS (SELECT *, rank() OVER (PARTITION BY comparison_id ORDER BY link_score_case DESC NULLS LAST) + (count(*) OVER (PARTITION BY comparison_id, link_score_case) - 1) / 2.0 AS rank_case,
  CASE WHEN link_score_ctrl IS NOT NULL THEN rank() OVER (PARTITION BY comparison_id ORDER BY link_score_ctrl DESC NULLS LAST) + (count(*) OVER (PARTITION BY comparison_id, link_score_ctrl) - 1) / 2.0 END AS rank_ctrl FROM deltas)
SELECT comparison_id, tf, gene_key, peak_id, round(delta_link_score, 6) AS delta_link_score, round(delta_fp_score, 6) AS delta_fp_score, round(log2FC_gene_expr, 6) AS log2FC_gene_expr, round(log2FC_tf_expr, 6) AS log2FC_tf_expr,
  CASE WHEN active_case > 0 AND active_ctrl > 0 THEN 'shared' WHEN active_case > 0 AND NOT active_ctrl > 0 THEN 'gain' WHEN NOT active_case > 0 AND active_ctrl > 0 THEN 'loss' WHEN NOT active_case > 0 AND NOT active_ctrl > 0 THEN 'inactive' END AS edge_change,
  active_both, active_any, round(rank_case::DOUBLE, 6) AS rank_case, round((rank_case - rank_ctrl)::DOUBLE, 6) AS rank_shift FROM r""")
def compared_links(l: Lens) -> DataFrame:
    return l.deltas(ranks=True).select(*DELTA_COLS)


@query("""WITH a AS (SELECT 'line' || (c_custkey % 4) || '_' || CASE WHEN c_custkey % 5 = 0 THEN 'ctrl' ELSE c_mktsegment END AS label FROM customer), d AS (SELECT DISTINCT label, string_split(label, '_')[1] AS line, label LIKE '%ctrl' AS c FROM a)
SELECT x.label || '_vs_' || y.label AS comparison_id, x.label AS "case", y.label AS control FROM d x JOIN d y ON NOT x.c AND y.c AND x.line = y.line""")
def contrasts(l: Lens) -> DataFrame:
    tag = F.when(F.col("c_custkey") % 5 == 0, "ctrl").otherwise(F.col("c_mktsegment"))
    labels = l.table("customer").select(F.concat(F.lit("line"), (F.col("c_custkey") % 4).cast("string"), F.lit("_"), tag).alias("label"))
    return compare.contrasts(labels, "ctrl")


@query("""WITH a AS (SELECT tf, gene_key, peak_id, count(*) AS n FROM standard WHERE condition <= 1995 GROUP BY 1, 2, 3), b AS (SELECT tf, gene_key, peak_id, count(*) AS n FROM standard WHERE condition > 1995 GROUP BY 1, 2, 3)
SELECT tf, gene_key, peak_id, CASE WHEN a.n IS NULL THEN 'only in second' ELSE 'only in first' END AS fault FROM a FULL JOIN b USING (tf, gene_key, peak_id) WHERE a.n IS NULL OR b.n IS NULL""")
def key_faults(l: Lens) -> DataFrame:
    keys = lambda half: l.links().where(half).select("tf", "gene_key", "peak_id").distinct()
    return compare.key_faults(keys("condition <= 1995"), keys("condition > 1995"))


@query("SELECT tf, gene_key, peak_id, round(max(link_score), 6) AS link_score FROM standard GROUP BY 1, 2, 3")
def one_link_a_key(l: Lens) -> DataFrame:
    return compare.one_a_key(l.standard()).select("tf", "gene_key", "peak_id", "link_score")


LIVE = """WHERE abs(log2FC_gene_expr) >= 0.5 AND NOT coalesce(abs(log2FC_tf_expr) >= 0.5 AND sign(log2FC_tf_expr) * sign(log2FC_gene_expr) * CASE WHEN link_sign = '-' THEN -1 ELSE 1 END < 0, FALSE)"""


@query(f"SELECT comparison_id, tf, gene_key, peak_id, round(log2FC_gene_expr, 6) AS log2FC_gene_expr FROM deltas {LIVE}")
def filtered_deltas(l: Lens) -> DataFrame:
    return compare.filter_deltas(l.deltas(), gene_log2fc=0.5, tf_log2fc=0.5).select("comparison_id", "tf", "gene_key", "peak_id", "log2FC_gene_expr")


@query(f"SELECT comparison_id, tf, gene_key, peak_id FROM deltas {LIVE} AND greatest(gene_expr_case, gene_expr_ctrl) > 4 AND greatest(tf_expr_case, tf_expr_ctrl) > 4 AND greatest(fp_score_case, fp_score_ctrl) > 4 AND greatest(link_score_case, link_score_ctrl) > 2 AND abs(delta_link_score) >= 2")
def filtered_deltas_documented(l: Lens) -> DataFrame:
    return compare.filter_deltas(l.deltas(), "documented", 0.5, 0.5).select("comparison_id", "tf", "gene_key", "peak_id")


@query("""SELECT comparison_id, tf, gene_key, peak_id, direction FROM (SELECT *, CASE WHEN log2FC_gene_expr >= 0.5 AND delta_fp_score >= 5 THEN 'Up' WHEN log2FC_gene_expr <= -0.5 AND delta_fp_score <= -5 THEN 'Down' END AS direction,
  CASE WHEN log2FC_gene_expr > 0 THEN fp_score_case ELSE fp_score_ctrl END AS hi FROM deltas) WHERE direction IS NOT NULL AND hi >= 20""")
def link_directions(l: Lens) -> DataFrame:
    return compare.with_direction(l.deltas(), 0.5, 5, fp_min=20).select("comparison_id", "tf", "gene_key", "peak_id", "direction")


@query("SELECT tf, gene_key, CASE WHEN min(link_sign) = '+' AND max(link_sign) = '+' THEN 'activator' WHEN min(link_sign) = '-' AND max(link_sign) = '-' THEN 'repressor' END AS mode, count(link_sign) AS n_signs FROM standard GROUP BY 1, 2")
def link_modes(l: Lens) -> DataFrame:
    return compare.link_modes(l.standard(), ["tf", "gene_key"])


TOPIC_EDGES = """te AS (SELECT * FROM deltas WHERE abs(log2FC_fp_score) >= 0.5 AND abs(log2FC_gene_expr) >= 0.5 AND CASE WHEN sign(log2FC_gene_expr) <> 0 THEN sign(log2FC_gene_expr) ELSE sign(delta_gene_expr) END = CASE WHEN sign(log2FC_fp_score) <> 0 THEN sign(log2FC_fp_score) ELSE sign(delta_fp_score) END
  AND sign(log2FC_gene_expr) <> 0)"""


def _topic_edges(l: Lens) -> DataFrame:
    return compare.filter_for_topics(l.deltas(), 0.5, None, 0.5)


@query(f"WITH {TOPIC_EDGES} SELECT comparison_id, tf, gene_key, peak_id FROM te")
def topic_edges(l: Lens) -> DataFrame:
    return _topic_edges(l).select("comparison_id", "tf", "gene_key", "peak_id")


@query("SELECT comparison_id, tf, gene_key, round(coalesce(sum(delta_link_score), 0), 6) AS delta_link_score, round(coalesce(sum(delta_fp_score), 0), 6) AS delta_fp_score FROM deltas GROUP BY 1, 2, 3")
def edges_by_tf_gene(l: Lens) -> DataFrame:
    return compare.edges_by_tf_gene(l.deltas(), ["delta_link_score", "delta_fp_score"])


@query("""WITH a AS (SELECT tf, count(*) AS n_links, coalesce(sum(delta_fp_score), 0) AS sum_delta, coalesce(sum(abs(delta_fp_score)), 0) AS sum_abs_delta, coalesce(sum(delta_fp_score) FILTER (delta_fp_score > 0), 0) AS sum_gain, coalesce(sum(delta_fp_score) FILTER (delta_fp_score < 0), 0) AS sum_loss,
  count(*) FILTER (delta_fp_score > 0) AS n_gain, count(*) FILTER (delta_fp_score < 0) AS n_loss, max(greatest(tf_expr_case, tf_expr_ctrl)) AS max_tf_expr, quantile_cont(log2FC_tf_expr, 0.5) AS median_log2fc_tf FROM deltas GROUP BY 1)
SELECT tf, n_links, sum_delta, sum_abs_delta, sum_gain, sum_loss, n_gain, n_loss, max_tf_expr, round(median_log2fc_tf, 6) AS median_log2fc_tf, round(avg(sum_abs_delta) OVER (), 6) AS mean_abs_delta, count(*) OVER () AS n_tfs FROM a""")
def factor_hubs(l: Lens) -> DataFrame:
    return compare.tf_hub_summary(l.deltas())


@query("""WITH x AS (SELECT comparison_id, tf, gene_key, peak_id, log2FC_gene_expr AS fc, (peak_id % 20) / 100.0::DOUBLE AS p FROM deltas), m AS (SELECT min(p) AS least FROM x WHERE p > 0)
SELECT comparison_id, tf, gene_key, peak_id, CASE WHEN coalesce(abs(fc) > 1, FALSE) AND q < 0.05 THEN 'FC_P' WHEN coalesce(abs(fc) > 1, FALSE) THEN 'FC' WHEN q < 0.05 THEN 'P' ELSE 'NS' END AS volcano_class, round(-log10(q), 6) AS neg_log10_p
FROM (SELECT *, CASE WHEN p = 0 THEN least * 0.1 ELSE p END AS q FROM x, m)""")
def volcano_classes(l: Lens) -> DataFrame:
    rows = l.deltas().withColumn("p", F.col("peak_id") % 20 / 100.0)
    return compare.volcano_classes(rows, "log2FC_gene_expr", "p").select("comparison_id", "tf", "gene_key", "peak_id", "volcano_class", "neg_log10_p")


@query("""WITH ch AS (SELECT DISTINCT comparison_id, CASE WHEN log2FC_gene_expr > 0 THEN 'Up' ELSE 'Down' END AS direction, gene_key FROM deltas WHERE abs(log2FC_gene_expr) >= 2),
per AS (SELECT comparison_id, gene_key, bool_or(coalesce(abs(delta_fp_score) >= 40, FALSE)) AS fp, bool_or(coalesce(abs(log2FC_tf_expr) >= 2.5, FALSE)) AS tf FROM deltas GROUP BY 1, 2),
j AS (SELECT ch.*, per.gene_key IS NOT NULL AS linked, coalesce(fp, FALSE) AS fp, coalesce(fp, FALSE) AND coalesce(tf, FALSE) AS tf FROM ch LEFT JOIN per USING (comparison_id, gene_key))
SELECT comparison_id, direction, s.stage, count(DISTINCT CASE WHEN s.ok THEN gene_key END) AS n_genes FROM (SELECT comparison_id, direction, gene_key, unnest([{'stage': '1_total', 'ok': TRUE}, {'stage': '2_linked', 'ok': linked}, {'stage': '3_footprint', 'ok': fp}, {'stage': '4_tf', 'ok': tf}]) AS s FROM j) GROUP BY 1, 2, 3""")
def gene_funnel(l: Lens) -> DataFrame:
    d = l.deltas()
    changed = d.where("abs(log2FC_gene_expr) >= 2").select("comparison_id", F.when(F.col("log2FC_gene_expr") > 0, "Up").otherwise("Down").alias("direction"), "gene_key")
    return compare.gene_funnel(changed, d, 40, 2.5)


@query()
def multi_condition_anova(l: Lens) -> DataFrame:
    v = l.fp().select(F.lit("t").alias("tf"), F.lit("g").alias("gene_key"), F.col("peak").alias("peak_id"), "sample", "value")
    return compare.multi_anova(v, l.samples()).drop("means")


@query()
def multi_condition_trend(l: Lens) -> DataFrame:
    v = l.fp().select(F.lit("t").alias("tf"), F.lit("g").alias("gene_key"), F.col("peak").alias("peak_id"), "sample", "value")
    return compare.multi_trend(v, l.samples().withColumn("year", F.col("condition").cast("double")), "year")


@query()
def multi_condition_mixed(l: Lens) -> DataFrame:
    v = l.fp().select(F.lit("t").alias("tf"), F.lit("g").alias("gene_key"), F.col("peak").alias("peak_id"), "sample", "value")
    return compare.multi_lmm(v, l.samples().withColumn("quarter", (F.col("sample") % 10).cast("double")), ["quarter"], "condition")


DOCS = f"""{TOPIC_EDGES}, td AS (SELECT *, comparison_id || '::' || tf || '::' || CASE WHEN log2FC_gene_expr > 0 THEN 'Up' ELSE 'Down' END AS doc_id FROM te WHERE log2FC_gene_expr <> 0)"""


def _docs(l: Lens) -> DataFrame:
    return topics.tf_documents(_topic_edges(l))


@query(f"WITH {DOCS} SELECT doc_id, count(*) AS n FROM td GROUP BY 1")
def topic_documents(l: Lens) -> DataFrame:
    return _docs(l).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _terms_sql(inner: str) -> str:
    return f"""WITH {DOCS}, w AS ({inner}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term_id) AS i FROM w) WHERE i <= 60),
k AS (SELECT * FROM t WHERE term_id IN (SELECT term_id FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3))
SELECT doc_id, term_id, round(weight, 6) AS weight, greatest(1, ceil(weight / (SELECT max(weight) FROM k) * 50))::BIGINT AS count_bin, greatest(1, ceil(ln(1 + weight) * 50))::BIGINT AS count_log FROM k"""


@query(_terms_sql("SELECT doc_id, 'PEAK:' || peak_id AS term_id, sum(abs(delta_fp_score)) AS weight FROM td WHERE abs(delta_fp_score) > 0 GROUP BY 1, 2"))
def site_document_terms(l: Lens) -> DataFrame:
    return topics.document_terms(_docs(l), "peak", "delta_fp_score", 60, 3)


@query(_terms_sql("SELECT doc_id, 'GENE:' || gene_key AS term_id, sum(w) AS weight FROM (SELECT doc_id, gene_key, peak_id, max(abs(delta_gene_expr)) AS w FROM td WHERE abs(delta_gene_expr) > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def gene_document_terms(l: Lens) -> DataFrame:
    return topics.document_terms(_docs(l), "gene", "delta_gene_expr", 60, 3)


@query(f"""WITH {DOCS}, p AS (SELECT doc_id, 'PEAK:' || peak_id AS term_id, sum(abs(delta_fp_score)) AS weight FROM td WHERE abs(delta_fp_score) > 0 GROUP BY 1, 2),
g AS (SELECT doc_id, 'GENE:' || gene_key AS term_id, sum(w) AS weight FROM (SELECT doc_id, gene_key, peak_id, max(abs(delta_gene_expr)) AS w FROM td WHERE abs(delta_gene_expr) > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
p2 AS (SELECT * FROM p WHERE term_id IN (SELECT term_id FROM p GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)), g2 AS (SELECT * FROM g WHERE term_id IN (SELECT term_id FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)),
c AS (SELECT doc_id, term_id, greatest(1, ceil(weight / (SELECT max(weight) FROM p2) * 50))::BIGINT AS n, 'p' AS m FROM p2 UNION ALL SELECT doc_id, term_id, greatest(1, ceil(weight / (SELECT max(weight) FROM g2) * 50))::BIGINT, 'g' FROM g2),
o AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, m) AS own FROM c), z AS (SELECT doc_id, min(own) AS low FROM o GROUP BY 1 HAVING count(DISTINCT m) = 2),
b AS (SELECT doc_id, term_id, round_even(n * low / own, 0)::BIGINT AS n FROM o JOIN z USING (doc_id)), s AS (SELECT doc_id, term_id, sum(n)::BIGINT AS pseudo_count FROM b WHERE n > 0 GROUP BY 1, 2)
SELECT * FROM s WHERE term_id IN (SELECT term_id FROM s GROUP BY 1 HAVING count(*) >= 2)""")
def joint_document_terms(l: Lens) -> DataFrame:
    return topics.joint_terms(_docs(l), "delta_fp_score", "delta_gene_expr", top_n=100_000)


@query("""WITH q AS (SELECT quantile_cont(abs(delta_fp_score), 0.9) AS q FROM deltas WHERE abs(delta_link_score) >= 1),
w AS (SELECT comparison_id || '::' || tf AS doc_id, gene_key AS term_id, sum(abs(delta_link_score) * (1 + 0.5 * least(1, coalesce(abs(delta_fp_score) / q, 0)))) AS weight FROM deltas, q WHERE abs(delta_link_score) >= 1 GROUP BY 1, 2 HAVING sum(abs(delta_link_score)) > 0)
SELECT doc_id, term_id, round(weight, 6) AS weight FROM w WHERE term_id IN (SELECT term_id FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2)""")
def pooled_document_terms(l: Lens) -> DataFrame:
    return topics.pooled_terms(l.deltas(), min_abs=1, boosts=[("delta_fp_score", 0.5)])


@query("""WITH w AS (SELECT gene_key AS doc_id, tf AS term_id, sum(greatest(delta_link_score, 0)) AS weight FROM deltas WHERE delta_link_score > 0 GROUP BY 1, 2) SELECT doc_id, term_id, round(weight, 6) AS weight FROM w""")
def gene_documents(l: Lens) -> DataFrame:
    return topics.gene_documents(l.deltas(), which="gain")


@query("""WITH x AS (SELECT upper(trim(unnest(string_split(gene_symbol, '::')))) AS tf, cluster FROM motif_db), n AS (SELECT tf, cluster, count(*) AS n FROM x GROUP BY 1, 2)
SELECT tf, cluster FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY n DESC, cluster) AS i FROM n) WHERE i = 1""")
def factor_clusters(l: Lens) -> DataFrame:
    return topics.tf_cluster_map(l.motif_db())


@query("SELECT topic, term_id, round(phi, 6) AS phi, round(least(1, greatest(0, phi / max(phi) OVER (PARTITION BY topic))), 6) AS score FROM phi")
def normalised_scores(l: Lens) -> DataFrame:
    return topics.normalised_scores(l.phi())


@query("""WITH s AS (SELECT topic, term_id, phi, log2(phi + 1e-12) - log2(coalesce((sum(phi) OVER t - phi) / nullif(count(*) OVER t - 1, 0), 0) + 1e-12) AS sp, greatest(-2.5, least(2.5, coalesce((phi - avg(phi) OVER t) / nullif(stddev_samp(phi) OVER t, 0), 0))) AS z FROM phi WINDOW t AS (PARTITION BY term_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY sp DESC, topic) AS own FROM s)
SELECT topic, term_id, round(sp, 6) AS specificity, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sp DESC, term_id) AS i FROM o WHERE own = 1) WHERE i <= 20""")
def term_specificity(l: Lens) -> DataFrame:
    return topics.term_specificity(l.phi(), 20)


@query("""WITH l AS (SELECT DISTINCT doc_id, tf, gene_key, peak_id::VARCHAR AS peak_id FROM doc_edges), s AS (SELECT l.*, t.topic, theta * coalesce(p.phi, 0) * coalesce(g.phi, 0) AS score FROM l JOIN theta t USING (doc_id) LEFT JOIN phi p ON p.topic = t.topic AND p.term_id = 'PEAK:' || peak_id LEFT JOIN phi g ON g.topic = t.topic AND g.term_id = 'GENE:' || gene_key),
q AS (SELECT *, CASE WHEN sum(score) OVER k > 0 THEN score / sum(score) OVER k ELSE 1.0 / count(*) OVER k END AS prob FROM s WINDOW k AS (PARTITION BY doc_id, tf, gene_key, peak_id))
SELECT doc_id, tf, gene_key, peak_id, round(score * 1000000, 6) AS score, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tf, gene_key, peak_id ORDER BY prob DESC, topic) AS i FROM q) WHERE i <= 1""")
def link_topic_scores(l: Lens) -> DataFrame:
    out = topics.link_topic_scores(l.doc_edges(), l.theta(), l.phi(), top_k=1)
    return out.select("doc_id", "tf", "gene_key", "peak_id", (F.col("score") * 1_000_000).alias("score"), "prob")


BIN = """sc AS (SELECT topic, term_id, least(1, greatest(0, phi / max(phi) OVER (PARTITION BY topic))) AS score FROM phi),
bt AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term_id) <= 60 AS in_topic FROM sc)"""


def _binary(l: Lens) -> tuple[DataFrame, DataFrame]:
    s = topics.normalised_scores(l.phi()).select("topic", "term_id", "score")
    return s, topics.binarize(s, "topn", top_n=60)


@query(f"WITH {BIN} SELECT topic, term_id, in_topic FROM bt")
def binarized_topics(l: Lens) -> DataFrame:
    return _binary(l)[1].select("topic", "term_id", "in_topic")


@query(f"""WITH {BIN}, l AS (SELECT DISTINCT doc_id, tf, gene_key, peak_id::VARCHAR AS peak_id FROM doc_edges),
x AS (SELECT l.*, t.topic, coalesce(p.score, 0) AS peak_score, coalesce(g.score, 0) AS gene_score, coalesce(p.in_topic, FALSE) AS peak_pass, coalesce(g.in_topic, FALSE) AS gene_pass FROM l CROSS JOIN (SELECT DISTINCT topic FROM phi) t LEFT JOIN bt p ON p.topic = t.topic AND p.term_id = 'PEAK:' || peak_id LEFT JOIN bt g ON g.topic = t.topic AND g.term_id = 'GENE:' || gene_key),
y AS (SELECT *, CASE WHEN sum(peak_score * gene_score) OVER k > 0 THEN peak_score * gene_score / sum(peak_score * gene_score) OVER k ELSE 1.0 / count(*) OVER k END AS link_prob FROM x WINDOW k AS (PARTITION BY doc_id, tf, gene_key, peak_id))
SELECT doc_id, tf, gene_key, peak_id, topic, peak_pass, gene_pass, round(link_prob, 6) AS link_prob, peak_pass AND gene_pass AND link_prob >= 0.2 AS link_pass FROM y""")
def topic_links(l: Lens) -> DataFrame:
    s, b = _binary(l)
    out = topics.topic_links(l.doc_edges(), s, b, prob_cutoff=0.2)
    return out.select("doc_id", "tf", "gene_key", "peak_id", "topic", "peak_pass", "gene_pass", "link_prob", "link_pass")


@query()
def topic_links_permuted(l: Lens) -> DataFrame:
    s, b = _binary(l)
    return topics.topic_links(l.doc_edges(), s, b, "link_score_efdr", rounds=20)


@query()
def gamma_cutoffs(l: Lens) -> DataFrame:
    return topics.gamma_cutoffs(topics.normalised_scores(l.phi()))


@query("""WITH sc AS (SELECT topic, CASE WHEN term_id LIKE 'PEAK:%' THEN 'PEAK' ELSE 'GENE' END AS term_class, phi AS x FROM phi)
SELECT topic, term_class, count(*) FILTER (x > 0) AS n, round(avg(x) ** 2 / var_samp(x), 4) AS shape FROM sc GROUP BY 1, 2""")
def gamma_moments(l: Lens) -> DataFrame:
    rows = l.phi().withColumn("term_class", topics.term_class())
    return rows.groupBy("topic", "term_class").agg(stats.gamma_moments("phi").alias("g")).select("topic", "term_class", "g.n", F.round("g.shape", 4).alias("shape"))


@query(f"""WITH {BIN}, e AS (SELECT DISTINCT peak_id::VARCHAR AS peak_id, gene_key FROM doc_edges), u AS (SELECT topic, substr(term_id, 6) AS gene, score FROM bt WHERE in_topic AND term_id LIKE 'GENE:%' UNION ALL SELECT topic, gene_key, score FROM bt JOIN e ON term_id = 'PEAK:' || peak_id WHERE in_topic)
SELECT topic, gene, round(max(score), 6) AS score FROM u GROUP BY 1, 2""")
def topic_genes(l: Lens) -> DataFrame:
    return topics.topic_genes(_binary(l)[1], l.doc_edges())


@query("""WITH b AS (SELECT topic, term_id, i FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY phi DESC, term_id) AS i FROM phi WHERE term_id LIKE 'GENE:%') WHERE i <= 8),
d AS (SELECT DISTINCT doc_id, 'GENE:' || gene_key AS term_id FROM (SELECT condition || tf || peak_id AS doc_id, gene_key FROM standard)), n AS (SELECT term_id, count(*) AS d FROM d GROUP BY 1),
p AS (SELECT x.topic, x.term_id AS a, y.term_id AS b, n.d FROM b x JOIN b y ON x.topic = y.topic AND x.i > y.i JOIN n ON n.term_id = y.term_id),
c AS (SELECT p.topic, p.a, p.b, p.d, (SELECT count(*) FROM d u JOIN d v ON u.doc_id = v.doc_id WHERE u.term_id = p.a AND v.term_id = p.b) AS both_ FROM p)
SELECT topic, round(avg(ln((both_ + 1) / d::DOUBLE)), 6) AS coherence FROM c GROUP BY 1""")
def topic_coherence(l: Lens) -> DataFrame:
    docs = l.links().select(F.concat(F.col("condition").cast("string"), "tf", F.col("peak_id").cast("string")).alias("doc_id"), F.concat(F.lit("GENE:"), "gene_key").alias("term_id")).distinct()
    return topics.coherence(docs, l.phi().where("term_id like 'GENE:%'"), 8)


@query("SELECT doc_id, string_agg(topic::VARCHAR, ';' ORDER BY topic) AS topics FROM theta WHERE theta >= 0.2 GROUP BY 1")
def assigned_topics(l: Lens) -> DataFrame:
    return topics.assign_topics(l.theta(), 0.2)


@query("""WITH s AS (SELECT DISTINCT e.doc_id, tf, gene_key, peak_id, t.topic, theta * phi AS score FROM doc_edges e JOIN theta t USING (doc_id) JOIN phi p ON p.topic = t.topic AND p.term_id = 'GENE:' || gene_key)
SELECT doc_id, tf, gene_key, peak_id, round(score * 1000, 6) AS score, topic_rank::INT AS topic_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, tf, gene_key, peak_id ORDER BY score DESC, topic) AS topic_rank FROM s) WHERE topic_rank <= 2""")
def edge_topics(l: Lens) -> DataFrame:
    phi = l.phi().where("term_id like 'GENE:%'").withColumn("term_id", F.expr("substring(term_id, 6)"))
    out = topics.edge_topics(l.doc_edges(), l.theta(), phi, 2)
    return out.select("doc_id", "tf", "gene_key", "peak_id", (F.col("score") * 1000).alias("score"), "topic_rank")


@query("""SELECT a.topic AS a, b.topic AS b, round(sum(CASE WHEN a.phi > 0 THEN a.phi * ln(a.phi / ((a.phi + b.phi) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN b.phi > 0 THEN b.phi * ln(b.phi / ((a.phi + b.phi) / 2)) ELSE 0 END) / 2, 6) AS distance
FROM phi a JOIN phi b ON a.term_id = b.term_id AND a.topic < b.topic GROUP BY 1, 2""")
def topic_distances(l: Lens) -> DataFrame:
    return topics.topic_distances(l.phi())


@query("""WITH s AS (SELECT DISTINCT topic, gene FROM (SELECT (peak_id % 5 + 1)::INT AS topic, gene_key AS gene FROM doc_edges WHERE fp_score > 60)), m AS (SELECT DISTINCT 'S' || p_size AS set, p_brand AS gene FROM part),
g AS (SELECT topic, count(*) AS n_topic FROM s GROUP BY 1), k AS (SELECT set, count(*) AS n_markers FROM m GROUP BY 1), h AS (SELECT topic, set, count(*) AS o FROM s JOIN m USING (gene) GROUP BY 1, 2)
SELECT topic, set, n_topic, n_markers, coalesce(o, 0) AS overlap, round(coalesce(o, 0)::DOUBLE / n_markers, 6) AS coverage,
 round(list_sum(list_transform(range(coalesce(o, 0), least(n_topic, n_markers) + 1), lambda x: CASE WHEN 40 - n_topic - n_markers + x < 0 THEN 0 ELSE exp(lgamma(n_topic + 1) + lgamma(41 - n_topic) + lgamma(n_markers + 1) + lgamma(41 - n_markers) - lgamma(41) - lgamma(x + 1) - lgamma(n_topic - x + 1) - lgamma(n_markers - x + 1) - lgamma(40 - n_topic - n_markers + x + 1)) END)), 6) AS p
FROM g CROSS JOIN k LEFT JOIN h USING (topic, set)""")
def marker_overlap(l: Lens) -> DataFrame:
    sets = l.doc_edges().where("fp_score > 60").select((F.col("peak_id") % 5 + 1).cast("int").alias("topic"), F.col("gene_key").alias("gene"))
    marks = l.table("part").select(F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("set"), F.col("p_brand").alias("gene"))
    return topics.marker_overlap(sets, marks, 40).drop("odds_ratio")


@query("SELECT tf, gene_key AS gene, round(sum(link_score), 6) AS score, count(DISTINCT peak_id) AS n_sites FROM standard GROUP BY 1, 2 HAVING sum(link_score) >= 20")
def topic_network(l: Lens) -> DataFrame:
    rows = l.standard().select("tf", F.col("gene_key").alias("gene"), F.col("peak_id").alias("enhancer"), "link_score")
    return graph.topic_network(rows, min_score=20)


@query("""WITH n AS (SELECT condition <= 1995 AS early, tf, gene_key AS gene, sum(link_score) AS score FROM standard GROUP BY 1, 2, 3), a AS (SELECT * FROM n WHERE early), b AS (SELECT * FROM n WHERE NOT early)
SELECT tf, gene, round(coalesce(a.score, 0), 6) AS score_base, round(coalesce(b.score, 0), 6) AS score_contrast, round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) AS delta FROM a FULL JOIN b USING (tf, gene) WHERE abs(coalesce(b.score, 0) - coalesce(a.score, 0)) >= 10""")
def delta_network(l: Lens) -> DataFrame:
    net = lambda half: graph.topic_network(l.standard().where(half).select("tf", F.col("gene_key").alias("gene"), F.col("peak_id").alias("enhancer"), "link_score"))
    return graph.delta_network(net("condition <= 1995"), net("condition > 1995"), 10)


HUBS = "WITH e AS (SELECT DISTINCT condition AS topic, tf, gene_key FROM standard), h0 AS MATERIALIZED (SELECT DISTINCT topic, tf, 1.0::DOUBLE AS h FROM e)" + "".join(
    f""",
a{i} AS MATERIALIZED (SELECT topic, gene_key, sum(h) AS a FROM e JOIN h{i} USING (topic, tf) GROUP BY 1, 2),
s{i} AS MATERIALIZED (SELECT topic, tf, sum(a) AS s FROM e JOIN a{i} USING (topic, gene_key) GROUP BY 1, 2),
h{i + 1} AS MATERIALIZED (SELECT topic, tf, s / sqrt(sum(s * s) OVER (PARTITION BY topic)) AS h FROM s{i})"""
    for i in range(15)
)


@query(f"{HUBS} SELECT topic, tf, round(h / max(h) OVER (PARTITION BY topic), 6) AS hub FROM h15")
def hub_scores(l: Lens) -> DataFrame:
    return graph.hub_scores(l.standard().withColumn("topic", F.col("condition")))


@query("SELECT round(coalesce(quantile_cont(delta_link_score, 0.995) FILTER (delta_link_score > 0), 1), 6) AS cap_pos, round(coalesce(quantile_cont(-delta_link_score, 0.995) FILTER (delta_link_score < 0), 1), 6) AS cap_neg FROM deltas")
def colour_caps(l: Lens) -> DataFrame:
    return graph.caps(l.score_deltas(), "delta_link_score")


@query("SELECT peak_id, count(DISTINCT tf) AS n_tfs, count(DISTINCT gene_key) AS n_genes FROM deltas GROUP BY 1 HAVING count(DISTINCT tf) >= 2")
def shared_sites(l: Lens) -> DataFrame:
    return graph.shared_sites(l.deltas())


@query("""WITH d AS (SELECT tf, gene_key, peak_id, round(sum(delta_link_score), 4) AS delta_link_score FROM deltas WHERE delta_link_score IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tf, gene_key ORDER BY abs(delta_link_score) DESC, peak_id) AS i FROM d) WHERE i = 1)
SELECT tf, gene_key, peak_id, round(delta_link_score, 6) AS delta_link_score FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY abs(delta_link_score) DESC, gene_key, peak_id) AS j FROM b) WHERE j <= 10""")
def strongest_edges(l: Lens) -> DataFrame:
    rows = l.score_deltas().groupBy("tf", "gene_key", "peak_id").agg(F.round(F.sum("delta_link_score"), 4).alias("delta_link_score"))
    return graph.strongest_edges(rows, 10).select("tf", "gene_key", "peak_id", "delta_link_score")


@query("SELECT peak_id, gene_key, round(coalesce(sum(CASE WHEN abs(delta_link_score) > 3 THEN CASE WHEN link_sign = '-' THEN -1 ELSE 1 END * delta_link_score END), 0), 6) AS weight, count(*) FILTER (abs(delta_link_score) > 3) AS n_pass FROM deltas GROUP BY 1, 2")
def site_gene_sums(l: Lens) -> DataFrame:
    return graph.site_gene_sums(l.deltas().withColumn("pass", F.coalesce(F.abs("delta_link_score") > 3, F.lit(False))))


NEAR = """e AS (SELECT DISTINCT 'Brand#' || (peak_id % 12 + 1) AS tf, gene_key FROM standard), mine AS (SELECT gene_key AS node FROM e WHERE tf = 'Brand#3'), tfs AS (SELECT DISTINCT tf AS node FROM e),
child AS (SELECT node FROM mine WHERE node IN (SELECT node FROM tfs)), parent AS (SELECT DISTINCT tf AS node FROM e WHERE gene_key = 'Brand#3' AND tf <> 'Brand#3'), genes AS (SELECT node FROM mine WHERE node NOT IN (SELECT node FROM tfs)),
near_ AS (SELECT node FROM child UNION SELECT node FROM parent), theirs AS (SELECT DISTINCT gene_key AS node FROM e WHERE tf IN (SELECT node FROM near_))"""


@query(f"""WITH {NEAR} SELECT node, 'child_tf' AS role FROM child UNION ALL SELECT node, 'parent_tf' FROM parent UNION ALL SELECT node, CASE WHEN node IN (SELECT node FROM theirs) THEN 'common_gene' ELSE 'root_gene' END FROM genes
UNION ALL SELECT DISTINCT tf, 'co_parent_tf' FROM e WHERE gene_key IN (SELECT node FROM genes) AND tf <> 'Brand#3' AND tf NOT IN (SELECT node FROM near_)""")
def root_neighbourhood(l: Lens) -> DataFrame:
    e = l.links().select(F.concat(F.lit("Brand#"), (F.col("peak_id") % 12 + 1).cast("string")).alias("tf"), "gene_key")
    return graph.root_neighbourhood(e, "Brand#3")


SUMMARY = """ex AS (SELECT (peak_id % 5 + 1)::VARCHAR AS topic, * FROM deltas WHERE abs(delta_link_score) >= 0.25),
ag AS (SELECT topic, tf, count(*) AS n_links, count(DISTINCT gene_key) AS n_genes, sum(delta_link_score) AS sum_delta, sum(abs(delta_link_score)) AS sum_abs_delta, max(log2FC_tf_expr) AS log2fc_tf FROM ex GROUP BY 1, 2)"""


def _summary(l: Lens, hubs: bool = False) -> DataFrame:
    return graph.topic_summary(l.deltas().withColumn("topics", (F.col("peak_id") % 5 + 1).cast("string")), hubs=hubs)


@query(f"WITH {SUMMARY} SELECT topic, tf, n_links, n_genes, round(sum_delta, 6) AS sum_delta, round(sum_abs_delta, 6) AS sum_abs_delta, row_number() OVER (PARTITION BY topic ORDER BY sum_abs_delta DESC, tf)::INT AS tf_rank FROM ag")
def topic_summary(l: Lens) -> DataFrame:
    return _summary(l, hubs=True).select("topic", "tf", "n_links", "n_genes", "sum_delta", "sum_abs_delta", "tf_rank")


@query(f"""WITH {SUMMARY}, k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sum_abs_delta DESC, tf) AS i FROM ag), t AS (SELECT * FROM k WHERE i <= 4), m AS (SELECT quantile_cont(log2fc_tf, 0.5) AS m FROM t), d AS (SELECT quantile_cont(abs(log2fc_tf - m), 0.5) AS mad FROM t, m)
SELECT topic, tf, round(sign(sum_delta) * log2(abs(sum_delta) + 1), 6) AS signed_log, round(CASE WHEN mad > 0 THEN least(3, greatest(-3, (log2fc_tf - m) / (1.4826 * mad))) ELSE 0 END, 6) AS color_z FROM t, m, d""")
def expression_bubbles(l: Lens) -> DataFrame:
    return graph.expression_bubbles(_summary(l), 4).select("topic", "tf", "signed_log", "color_z")


@query("""WITH x AS (SELECT orders.*, (o_totalprice > 250000)::INT AS predicted, (o_orderkey % 3 = 0)::INT AS truth FROM orders), n AS (SELECT o_orderpriority, count(*) FILTER (predicted = 1 AND truth = 1)::DOUBLE AS tp, count(*) FILTER (predicted = 1 AND truth = 0)::DOUBLE AS fp, count(*) FILTER (predicted = 0 AND truth = 1)::DOUBLE AS fn, count(*) FILTER (predicted = 0 AND truth = 0)::DOUBLE AS tn FROM x GROUP BY 1)
SELECT o_orderpriority, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM n""", plain=True)
def confusion_metrics(l: Lens) -> DataFrame:
    rows = l.table("orders").select("o_orderpriority", (F.col("o_totalprice") > 250000).cast("int").alias("predicted"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("truth"))
    return benchmark.evaluate(rows, "predicted", "truth", ["o_orderpriority"])


@query("""WITH r AS (SELECT tf, log2FC_gene_expr AS v, CASE WHEN log2FC_gene_expr > 4 THEN 3 WHEN log2FC_gene_expr > 0 THEN 2 WHEN log2FC_gene_expr > -6 THEN 1 ELSE 0 END AS bin FROM deltas WHERE log2FC_gene_expr IS NOT NULL)
SELECT tf, b.bin::INT AS bin, count(v) AS n FROM (SELECT DISTINCT tf FROM deltas) t CROSS JOIN (SELECT unnest(range(4)) AS bin) b LEFT JOIN r USING (tf, bin) GROUP BY 1, 2""")
def binned_changes(l: Lens) -> DataFrame:
    return benchmark.binned_counts(l.deltas(), "log2FC_gene_expr", [-6, 0, 4], ["tf"])


@query("""WITH r AS (SELECT tf, comparison_id || '|' || tf || '|' || gene_key || '|' || peak_id AS id, log2FC_gene_expr AS v, (peak_id % 9 = 0)::INT AS x FROM deltas WHERE log2FC_gene_expr IS NOT NULL),
s AS (SELECT *, sum(x) OVER (PARTITION BY tf) AS n, row_number() OVER (PARTITION BY tf, x ORDER BY md5(id || '|1'), id, v) AS i FROM r),
c AS (SELECT tf, x, v, rank() OVER (PARTITION BY tf ORDER BY v) + (count(*) OVER (PARTITION BY tf, v) - 1) / 2.0 AS k FROM s WHERE x = 1 OR i <= n),
t AS (SELECT tf, sum(m * m * m - m)::DOUBLE AS ties FROM (SELECT tf, v, count(*) AS m FROM c GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT tf, sum(x)::DOUBLE AS nx, sum(1 - x)::DOUBLE AS ny, sum(x * k) - sum(x) * (sum(x) + 1) / 2 AS w, median(v) FILTER (x = 1) AS mx, median(v) FILTER (x = 0) AS my FROM c GROUP BY 1),
z AS (SELECT a.*, (w - nx * ny / 2 - sign(w - nx * ny / 2) * 0.5) / sqrt(nx * ny / 12 * (nx + ny + 1 - ties / ((nx + ny) * (nx + ny - 1)))) AS z FROM a JOIN t USING (tf))
SELECT tf, nx::BIGINT AS n, round(mx, 6) AS median_predicted, round(my, 6) AS median_random, round(w, 6) AS "W",
 round(CASE WHEN abs(z) > 5.6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(80), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - lgamma(j + 1)) / (2 * j + 1))) END, 6) AS p FROM z""")
def versus_random(l: Lens) -> DataFrame:
    rows = l.deltas().withColumn("predicted", (F.col("peak_id") % 9 == 0).cast("int")).withColumn("id", F.concat_ws("|", "comparison_id", "tf", "gene_key", F.col("peak_id").cast("string")))
    return benchmark.versus_random(rows, "id", "log2FC_gene_expr", "predicted", "tf")


@query("""SELECT a.peak_id % 5 AS topic_a, a.peak_id % 3 AS topic_b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a.peak_id % 5), 6) AS share FROM (SELECT DISTINCT tf, gene_key, peak_id FROM standard) a GROUP BY 1, 2""")
def topic_concordance(l: Lens) -> DataFrame:
    s = l.links().select("tf", "gene_key", "peak_id").distinct()
    return benchmark.concordance(s.withColumn("topic", F.col("peak_id") % 5), s.withColumn("topic", F.col("peak_id") % 3))


@query("""WITH m AS (SELECT DISTINCT region AS peak, motif || '_' || (peak % 3) AS motif FROM annotation), s AS (SELECT motif, count(*) AS c FROM m GROUP BY 1 HAVING count(*) >= 5), p AS (SELECT x.motif AS a, y.motif AS b, count(*) AS w FROM m x JOIN m y ON x.peak = y.peak AND x.motif < y.motif WHERE x.motif IN (SELECT motif FROM s) AND y.motif IN (SELECT motif FROM s) GROUP BY 1, 2)
SELECT a, b, round(w::DOUBLE / (sa.c + sb.c - w), 6) AS similarity FROM p JOIN s sa ON sa.motif = a JOIN s sb ON sb.motif = b""")
def motif_similarity(l: Lens) -> DataFrame:
    ann = l.annotation().select(F.col("region").alias("peak"), F.concat("motif", F.lit("_"), (F.col("peak") % 3).cast("string")).alias("motif"))
    return motif.motif_similarity(*motif.motif_peak_stats(ann, min_support=5))


def _matrices(l: Lens) -> DataFrame:
    """A count matrix a brand, 6 to 8 places wide: letters are suppliers, places are orders, counted over all of lineitem."""
    rows = l.table("lineitem").join(l.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    w = (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 3 + 6).alias("w")
    rows = rows.select(F.col("p_brand").alias("id"), w, F.pmod("l_suppkey", F.lit(4)).alias("letter"), "l_orderkey")
    cell = (F.col("letter") * F.col("w") + F.pmod(F.col("l_orderkey"), F.col("w"))).cast("int").alias("cell")
    counts = rows.groupBy("id", "w", cell).agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = counts.groupBy("id", "w").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("c"))
    return held.select("id", "w", F.transform(F.sequence(F.lit(0), F.col("w") * 4 - 1), lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0.0))).alias("m"))


@query()
def motif_alignments(l: Lens) -> DataFrame:
    return motif.pairwise_alignments(_matrices(l), blocks=3)


@query("""WITH m AS (SELECT DISTINCT peak, motif FROM annotation), c AS (SELECT motif, substr(motif, 1, 1) AS cluster FROM motif_db), x AS (SELECT * FROM m JOIN c USING (motif)), n AS (SELECT cluster, peak, count(*) AS k FROM x GROUP BY 1, 2), t AS (SELECT cluster, motif, count(*) AS k FROM x GROUP BY 1, 2)
SELECT n.cluster, count(*) AS n_peaks, round(avg(k), 6) AS motifs_per_peak, count(*) FILTER (k > 1) AS n_shared, (SELECT count(*) FROM t WHERE t.cluster = n.cluster) AS n_motifs, (SELECT string_agg(motif, ',' ORDER BY k DESC, motif) FROM t WHERE t.cluster = n.cluster) AS top FROM n GROUP BY 1""")
def cluster_peaks(l: Lens) -> DataFrame:
    return motif.cluster_peak_summary(l.annotation(), l.motif_db().select("motif", F.substring("motif", 1, 1).alias("cluster")))


@query()
def topic_model_lda(l: Lens) -> DataFrame:
    terms = topics.pooled_terms(l.deltas(), min_abs=1).withColumn("pseudo_count", F.ceil("weight"))
    return topics.fit_lda(terms, 4, rounds=5).theta


@query()
def topic_model_sampled(l: Lens) -> DataFrame:
    terms = topics.pooled_terms(l.deltas(), min_abs=1).withColumn("pseudo_count", F.ceil("weight"))
    return topics.fit_sampled_lda(terms, 4, sweeps=10).theta


@query()
def topic_model_nmf(l: Lens) -> DataFrame:
    return topics.fit_nmf(topics.pooled_terms(l.deltas(), min_abs=1), 4, runs=1, rounds=10).theta


@query()
def topic_model_neural(l: Lens) -> DataFrame:
    terms = topics.pooled_terms(l.deltas(), min_abs=1).withColumn("pseudo_count", F.ceil("weight"))
    return topics.fit_neural(terms, 4, epochs=5, hidden=16).theta


@query()
def link_communities(l: Lens) -> DataFrame:
    return graph.assign_communities(l.score_deltas())


@query()
def pathway_running_sums(l: Lens) -> DataFrame:
    ranks = topics.topic_genes(_binary(l)[1], l.doc_edges(), "sum")
    sets = l.table("part").select(F.concat(F.lit("set"), (F.col("p_size") % 6).cast("string")).alias("set"), F.col("p_brand").alias("gene")).distinct()
    return enrich.running_sum(ranks, sets, min_size=3, rounds=200).drop("leading_edge")


@query(f"""WITH {FLAGS}, {BOUND}, {TFS}, s AS (SELECT peak, tf, ((peak % 10) / 10.0)::DOUBLE AS rp, ((peak % 50) / 500.0)::DOUBLE AS qp FROM named), u AS (SELECT peak, tf, ((peak % 7) / 7.0)::DOUBLE AS rs, ((peak % 40) / 500.0)::DOUBLE AS qs FROM named),
b AS (SELECT peak, tf, rp, qp, rs, qs, (coalesce(rp > 0.3 AND qp < 0.05, FALSE) OR coalesce(rs > 0.3 AND qs < 0.05, FALSE))::INT AS bound FROM s FULL JOIN u USING (peak, tf))
SELECT b.peak, b.tf, bc.condition, b.bound, (b.bound = 1 AND bc.flag > 0 AND coalesce(f.flag, 0) > 0)::INT AS bound_here FROM b JOIN bc USING (peak) LEFT JOIN flags f ON f.gene = b.tf AND f.condition = bc.condition""")
def factor_site_overview(l: Lens) -> DataFrame:
    named = matrix.expand_tfs(matrix.attach_tfs(l.annotation(), l.motif_db())).select("peak", "tf").distinct()
    p = named.select("peak", "tf", (F.col("peak") % 10 / 10.0).alias("r"), (F.col("peak") % 50 / 500.0).alias("p_adj"))
    s = named.select("peak", "tf", (F.col("peak") % 7 / 7.0).alias("r"), (F.col("peak") % 40 / 500.0).alias("p_adj"))
    out = links.tf_overview(p, s, _bound(l), matrix.expressed_flags(l.rna(), l.samples(), 3000, 2))
    return out.select("peak", "tf", "condition", "bound", "bound_here")


@query("""SELECT gene_key, tf, peak_id, round(link_score, 6) AS link_score FROM (SELECT *, row_number() OVER (PARTITION BY gene_key ORDER BY CASE WHEN gene_expr > 20 THEN fp_score ELSE -fp_score END, link_score, peak_id) AS i FROM (SELECT gene_key, min(tf) AS tf, peak_id, max(gene_expr) AS gene_expr, max(fp_score) AS fp_score, max(link_score) AS link_score FROM standard GROUP BY 1, 3)) WHERE i = 1""")
def best_site_of_gene(l: Lens) -> DataFrame:
    rows = l.standard().groupBy("gene_key", "peak_id").agg(F.min("tf").alias("tf"), F.max("gene_expr").alias("gene_expr"), F.max("fp_score").alias("fp_score"), F.max("link_score").alias("link_score"))
    return benchmark.best_site_per_gene(rows.withColumn("effect", F.col("gene_expr") - 20), "effect", "fp_score", "link_score").select("gene_key", "tf", "peak_id", "link_score")


@query("""WITH lp AS (SELECT id AS loop_id, chrom, start, "end", lead(start) OVER (PARTITION BY chrom ORDER BY id) AS s2, lead("end") OVER (PARTITION BY chrom ORDER BY id) AS e2 FROM win),
sides AS (SELECT loop_id, chrom, start, "end", s2 AS os, e2 AS oe FROM lp WHERE s2 IS NOT NULL UNION ALL SELECT loop_id, chrom, s2, e2, start, "end" FROM lp WHERE s2 IS NOT NULL),
g AS (SELECT chrom, start AS tss, 'G' || id AS gene_key FROM ev),
hit AS (SELECT DISTINCT loop_id, sides.chrom, os AS start, oe AS "end", gene_key, 'promoter' AS how FROM sides JOIN g ON g.chrom = sides.chrom AND sides.start <= tss + 100 AND sides."end" >= tss - 100),
l2 AS (SELECT * FROM sides WHERE loop_id NOT IN (SELECT loop_id FROM hit)),
n AS (SELECT l2.loop_id, l2.chrom, l2.start, l2."end", gene_key, row_number() OVER (PARTITION BY l2.loop_id, l2.start, l2."end" ORDER BY abs(tss - floor((l2.start + l2."end") / 2)), tss) AS i FROM l2 JOIN g ON g.chrom = l2.chrom AND abs(tss - floor((l2.start + l2."end") / 2)) <= 3000)
SELECT * FROM hit UNION SELECT loop_id, chrom, start, "end", gene_key, 'nearest' FROM n WHERE i = 1""")
def anchored_priors(l: Lens) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("id")
    lp = l.windows().withColumn("s2", F.lead("start").over(w)).withColumn("e2", F.lead("end").over(w)).where("s2 is not null")
    loops = lp.select(F.col("id").alias("loop_id"), F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("chrom").alias("chrom2"), F.col("s2").alias("start2"), F.col("e2").alias("end2"))
    genes = l.events().select("chrom", F.col("start").alias("tss"), F.concat(F.lit("G"), F.col("id").cast("string")).alias("gene_key"))
    return links.anchored_priors(loops, genes, 100, 3000)


@query("""SELECT comparison_id, coalesce(sum(abs(delta_link_score)) FILTER (tf = 'PROMO'), 0) AS "PROMO", coalesce(sum(abs(delta_link_score)) FILTER (tf = 'SMALL'), 0) AS "SMALL" FROM (SELECT comparison_id, tf, delta_link_score FROM deltas WHERE abs(delta_link_score) >= 1) GROUP BY 1""")
def factor_delta_table(l: Lens) -> DataFrame:
    return graph.factor_delta_table(l.score_deltas(), ["PROMO", "SMALL"])


@query(f"""WITH {SUMMARY}, k AS (SELECT tf FROM ag WHERE topic = '2' ORDER BY sum_abs_delta DESC, tf LIMIT 3) SELECT comparison_id, tf, gene_key, peak_id, coalesce(abs(delta_link_score) >= 2, FALSE) AS pass, coalesce(abs(log2FC_gene_expr) >= log2(1.5), FALSE) AS gene_changed FROM deltas WHERE peak_id % 5 + 1 = 2 AND tf IN (SELECT tf FROM k)""")
def topic_delta_network(l: Lens) -> DataFrame:
    d = l.deltas().withColumn("topics", (F.col("peak_id") % 5 + 1).cast("string"))
    return graph.topic_delta_network(d, _summary(l), "2", 3).select("comparison_id", "tf", "gene_key", "peak_id", "pass", "gene_changed")


@query("SELECT sample, count(DISTINCT gene) FILTER (value >= 3300) AS n_expressed, count(DISTINCT gene) AS n_genes FROM rna GROUP BY 1")
def expression_summary(l: Lens) -> DataFrame:
    from weftlink.operators import quality

    return quality.expression_summary(l.rna(), 3300)


@query("SELECT condition, count(*) FILTER (active > 0) AS n_active, count(*) AS n_links, round(count(*) FILTER (active > 0) / count(*)::DOUBLE, 6) AS share FROM standard GROUP BY 1")
def activity_totals(l: Lens) -> DataFrame:
    from weftlink.operators import quality

    return quality.activity_totals(l.links())


@query(f"WITH {CORR} SELECT tf, least(floor((r + 1) / 2 * 20), 19)::INT AS bin, count(*) AS n, count(*) FILTER (r > 0.3 AND p_adj < 0.9) AS n_pass FROM cq WHERE r IS NOT NULL GROUP BY 1, 2")
def correlation_histogram(l: Lens) -> DataFrame:
    from weftlink.operators import quality

    found = correlate.correlate_tfs_to_footprints(l.annotation(), l.fp(), l.rna(), mode="all", tfs=l.tf_list())
    return quality.correlation_summary(found, ["tf"], q_max=0.9)


@query("""SELECT comparison_id, topic, set, count(DISTINCT gene_key) AS overlap FROM (SELECT comparison_id, (peak_id % 5 + 1)::INT AS topic, gene_key FROM deltas WHERE abs(delta_link_score) > 6) JOIN (SELECT DISTINCT 'S' || p_size AS set, p_brand FROM part) ON p_brand = gene_key GROUP BY 1, 2, 3""")
def marker_overlap_by_comparison(l: Lens) -> DataFrame:
    sets = l.score_deltas().where("abs(delta_link_score) > 6").select("comparison_id", (F.col("peak_id") % 5 + 1).cast("int").alias("topic"), F.col("gene_key").alias("gene"))
    marks = l.table("part").select(F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("set"), F.col("p_brand").alias("gene"))
    return topics.marker_overlap(sets, marks, 40, ("comparison_id", "topic")).where("overlap > 0").select("comparison_id", "topic", "set", "overlap")
