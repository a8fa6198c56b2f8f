import pytest

from weftlink.sources import config, tables
from weftlink.streaming import incremental


def test_link_tables_by_species(spark, tmp_path):
    tsv = tmp_path / "l.tsv"
    tsv.write_text("Name.TF\tName.Target\tOther\nHNF1A\tGENE1\t1\nHNF4A\tGENE2\t2\nHNF1A\tGENE3\t3\nFOXA2\tGENE4\t4\n")
    t = tables.LinkTables(spark, str(tmp_path / "links"))
    t.convert(str(tsv), "hs")
    assert t.load("human").count() == 4 and t.available() == ["Homo_sapiens"]
    assert sorted(r.Name_Target for r in t.load("hs", tfs=["HNF1A"]).collect()) == ["GENE1", "GENE3"]
    assert t.load("hs", targets=["GENE2"], columns=["Name_Target"]).count() == 1
    with pytest.raises(ValueError, match="None of the requested columns present"):
        t.load("hs", columns=["nope"])
    with pytest.raises(ValueError, match="unknown species"):
        t.load("xx")


def test_overviews_of_two_samples(spark, tmp_path):
    for s, score in (("s1", 2.5), ("s2", 3.5)):
        d = tmp_path / s / "db" / "M1"
        d.mkdir(parents=True)
        head = ["TFBS_chr", "TFBS_start", "TFBS_end", "TFBS_name", "peak_chr", "peak_start", "peak_end", f"{s}_ATAC_score", f"{s}_ATAC_bound"]
        (d / "M1_overview.txt").write_text("\t".join(head) + f"\nchr1\t5\t9\tM1\tchr1\t0\t50\t{score}\t1\n")
    found = tables.overview_motifs(spark, str(tmp_path)).collect()
    assert sorted((r["sample"], r.motif) for r in found) == [("s1", "M1"), ("s2", "M1")]
    rows = tables.read_overviews(spark, [r.file for r in found]).collect()
    assert sorted((r["sample"], r.peak, r.score, r.bound) for r in rows) == [("s1", "chr1:5-9", 2.5, 1), ("s2", "chr1:5-9", 3.5, 1)]


def test_position_matrices():
    text = ">MA1 one\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8 ]\n>MA2 two\n1 2\n3 4\n5 6\n7 8\n>bad x\n1 2\n"
    got = tables.parse_pfm(text, strict=False)
    assert [(g[0], g[2], g[3]) for g in got] == [("MA1", 2, [1.0, 2, 3, 4, 5, 6, 7, 8]), ("MA2", 2, [1.0, 2, 3, 4, 5, 6, 7, 8])]
    with pytest.raises(ValueError):
        tables.parse_pfm(text)


def test_delta_files(spark, tmp_path):
    p = tmp_path / "X_10_vs_Y_0_filtered_links_up.csv"
    p.write_text("tf,gene_key,peak_id,link_score_X_10,link_score_Y_0,delta_link_score\nt,g,p,3,1,2\n")
    r = tables.read_deltas(spark, str(p)).first()
    assert (r.comparison_id, r.file_direction, r.link_score_case, r.link_score_ctrl, r.delta_link_score) == ("X_10_vs_Y_0", "up", 3.0, 1.0, 2.0)


def test_delta_files_keep_their_own_heads(spark, tmp_path):
    (tmp_path / "A1_vs_B1_delta_links.csv").write_text("tf,gene_key,peak_id,fp_score_A1,fp_score_B1,tf_expr_A1,tf_expr_B1,delta_fp_score,fc_gene_expr,fp_bound_A1\nt,g,p,3,1,7,3,2,0.25,1\n")
    (tmp_path / "A2_vs_B2_delta_links_filtered_down.csv").write_text('"peak_id","tf","gene_key","log2FC_fp_bed_score","fp_bed_score_B2","fp_bed_score_A2","log2FC_gene_expr"\n"p,2",t2,g2,-1,8,4,NA\n')
    got = {r.comparison_id: r for r in tables.read_deltas(spark, str(tmp_path)).collect()}
    files = sorted(map(str, tmp_path.iterdir()))
    assert tables.read_deltas(spark, files).count() == 2 and [r.comparison_id for r in tables.read_deltas(spark, files, 1).collect()] == ["A1_vs_B1"]
    a, b = got["A1_vs_B1"], got["A2_vs_B2"]
    assert (a.tf, a.peak_id, a.fp_score_case, a.fp_score_ctrl, a.file_direction) == ("t", "p", 3.0, 1.0, None)
    assert (a.delta_fp, a.log2fc_fp, a.fc_mag_fp, a.log2fc_gene, a.fc_mag_gene, a.log2fc_tf, a.fc_mag_tf) == (2.0, 2.0, 4.0, -2.0, 4.0, 1.0, 2.0)
    assert (a.fp_bound_case, a.fp_bound_ctrl, a.log2FC_fp_bed_score) == (1, 0, None)
    assert (b.tf, b.peak_id, b.fp_score_case, b.fp_score_ctrl, b.file_direction) == ("t2", "p,2", 4.0, 8.0, "down")
    assert (b.delta_fp, b.log2fc_fp, b.fc_mag_fp, b.log2fc_gene, b.fc_mag_gene, b.log2fc_tf) == (None, -1.0, 2.0, None, None, None)


def test_overviews_of_many_columns(spark, tmp_path):
    folder = tmp_path / "s9" / "db" / "m"
    folder.mkdir(parents=True)
    more = [f"x{i}" for i in range(100)]
    (folder / "m_overview.txt").write_text("\t".join(["TFBS_chr", "TFBS_start", "TFBS_end", "TFBS_name", *more, "s9_score", "s9_bound"]) + "\n" + "\t".join(["chr1", "5", "9", "m", *more, "2.5", "1"]) + "\n")
    r = tables.read_overviews(spark, str(folder / "m_overview.txt")).first()
    assert (r.peak, r["sample"], r.score, r.bound) == ("chr1:5-9", "s9", 2.5, 1)


def test_regions_and_priors(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Chr,Start,End,s1,Overlap_s1\nchr10,1,2,5.5,1\nchr2,1,2,NA,0\n")
    score, over = tables.read_regions(spark, str(tmp_path / "r.csv"))
    assert sorted((r.region, r["sample"], r.value) for r in over.collect()) == [("chr10:1-2", "s1", 1.0), ("chr2:1-2", "s1", 0.0)]
    assert {r.region: r.value for r in score.collect()} == {"chr10:1-2": 5.5, "chr2:1-2": None}
    p = tables.standard_priors(spark.createDataFrame([("chr1", "5", "x", "G")], "Chr string, chromStart string, end string, symbol string")).first()
    assert (p.chrom, p.start, p.end, p.gene_key, p.prior_id) == ("chr1", 5, None, "G", None)


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("# study\nfdr: 0.05\nname: 'x y'\nflag: yes\nlist: [a, 2]\nmore:\n- u\n- v\nhome: ~/data\n")
    c = config.read_config(str(f))
    assert (c["fdr"], c["name"], c["flag"], c["list"], c["more"]) == (0.05, "x y", True, ["a", 2], ["u", "v"])
    config.check_config(c, ["fdr"], ["fdr"])
    with pytest.raises(ValueError):
        config.check_config(c, ["absent"])
    with pytest.raises(ValueError):
        config.check_config(c, [], ["name"])
    assert not config.expand_paths(c, ["home"])["home"].startswith("~")


def test_only_new_keys_are_computed(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []

    def compute(df):
        seen.append(df.count())
        return df.selectExpr("k", "k * 2 as v")

    incremental.extend(spark, path, spark.range(3).withColumnRenamed("id", "k"), ["k"], compute)
    got = incremental.extend(spark, path, spark.range(5).withColumnRenamed("id", "k"), ["k"], compute)
    assert got.count() == 5 and seen == [3, 2]


def test_stream_of_pairs(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(4).withColumnRenamed("id", "k").write.parquet(src)
    stream = spark.readStream.schema("k long").parquet(src)
    incremental.stream_pairs(stream, path, ["k"], lambda d: d.selectExpr("k", "k + 1 as v"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(path).count() == 4


def test_results_of_other_parameters_are_computed_anew(spark, tmp_path):
    path, wanted = str(tmp_path / "grown"), spark.range(3).withColumnRenamed("id", "k")
    made = lambda c: lambda d: d.selectExpr("k", f"k + {c} as v")
    run = lambda c: sorted(r.v for r in incremental.extend(spark, path, wanted, ["k"], made(c), {"cutoff": c, "mode": "a"}).collect())
    assert run(1) == [1, 2, 3] and run(5) == [5, 6, 7] and run(1) == [1, 2, 3]
    assert incremental.fingerprint({"a": 1, "b": 2}) == incremental.fingerprint({"b": 2, "a": 1})


def test_links_of_several_samples(spark):
    shape = "tf string, gene_key string, peak_id string, link_score double"
    a = spark.createDataFrame([("t", "g", "p", 1.0), ("t", "g", "p", 4.0), ("t", "h", "p", None)], shape)
    b = spark.createDataFrame([("t", "g", "p", 2.0), ("t", "h", "p", 3.0)], shape)
    got = {(r.gene_key, r["sample"]): r.value for r in tables.link_samples({"a": a, "b": b}).collect()}
    assert got == {("g", "a"): 4.0, ("h", "a"): None, ("g", "b"): 2.0, ("h", "b"): 3.0}
    with pytest.raises(Exception, match="not in every sample"):
        tables.link_samples({"a": a, "b": b.where("gene_key = 'g'")}).collect()
    assert tables.link_samples({"a": a, "b": b.where("gene_key = 'g'")}, strict=False).count() == 3
    with pytest.raises(ValueError):
        tables.link_samples({"a": a})


def test_cached_aligned_sites(spark, tmp_path):
    (tmp_path / "fp_scores_x.csv").write_text("peak_ID,s1,s2\nchr1:1-5,1.5,NA\nchr1:1-5,9,9\nchr1:7-9,2,3\n")
    (tmp_path / "fp_bounds_x.csv").write_text("peak_ID,s1,s2\nchr1:7-9,1,0\nchr1:1-5,1,1\nchr1:1-5,0,0\n")
    (tmp_path / "fp_annotation_x.csv").write_text("fp_peak,atac_peak,motifs\nchr1:1-5,chr1:0-9,M1\n")
    got = tables.read_aligned_sites(spark, str(tmp_path), "x", distinct=True)
    assert sorted((r.peak, r["sample"], r.value) for r in got["fp_score"].where("value is not null").collect()) == [("chr1:1-5", "s1", 1.5), ("chr1:7-9", "s1", 2.0), ("chr1:7-9", "s2", 3.0)]
    assert {r.value for r in got["fp_bound"].where("peak = 'chr1:1-5'").collect()} == {1.0}
    assert got["id_map"].collect()[0].asDict() == {"peak_ID": "chr1:1-5", "fp_peak_bak": "chr1:1-5", "atac_peak": "chr1:0-9", "group_size": None}
    (tmp_path / "fp_bounds_x.csv").write_text("peak_ID,s1\nchr1:7-9,1\n")
    with pytest.raises(ValueError):
        tables.read_aligned_sites(spark, str(tmp_path), "x")


def test_network_as_json(spark):
    import json

    from weftlink.operators import graph

    text = graph.network_json(spark.createDataFrame([("a", 1)], "id string, n int"), spark.createDataFrame([("a", 'q"', None), ("a", "c", 0.5)], "tf string, gene string, w double"))
    assert json.loads(text) == {"nodes": [{"id": "a", "n": 1}], "edges": [{"tf": "a", "gene": "c", "w": 0.5}, {"tf": "a", "gene": 'q"'}]}
