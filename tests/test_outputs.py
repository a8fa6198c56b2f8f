"""Overviews of factors and sites, interval files, expression by either name, and tables with quoted cells."""

from pyspark.sql import functions as F

from weftlink.operators import links, matrix
from weftlink.sources import tables


def test_factor_overview_by_condition(spark):
    stats = lambda rows: spark.createDataFrame(rows, "peak string, tf string, r double, p_adj double")
    pearson = stats([("p1", "A", 0.5, 0.01), ("p1", "B", 0.2, 0.01), ("p2", "A", 0.9, 0.2), ("p3", "A", None, None)])
    spearman = stats([("p1", "B", 0.4, 0.04), ("p2", "A", 0.9, 0.04), ("p4", "C", 0.3, 0.01)])
    bound = spark.createDataFrame([(p, c, int(not (p == "p2" and c == "y"))) for p in ("p1", "p2", "p3", "p4") for c in ("x", "y")], "peak string, condition string, flag int")
    expressed = spark.createDataFrame([("A", "x", 1), ("A", "y", 1), ("B", "x", 0), ("B", "y", 1)], "gene string, condition string, flag int")
    got = {(r.peak, r.tf, r.condition): (r.bound, r.bound_here) for r in links.tf_overview(pearson, spearman, bound, expressed).collect()}
    assert got == {
        ("p1", "A", "x"): (1, 1), ("p1", "A", "y"): (1, 1), ("p1", "B", "x"): (1, 0), ("p1", "B", "y"): (1, 1), ("p2", "A", "x"): (1, 1), ("p2", "A", "y"): (1, 0),
        ("p3", "A", "x"): (0, 0), ("p3", "A", "y"): (0, 0), ("p4", "C", "x"): (0, 0), ("p4", "C", "y"): (0, 0),
    }


def test_interval_files(spark, tmp_path):
    rows = spark.createDataFrame([("chr2:5-9", "A::B", "c 1"), ("chr1:50-60", "A::B", "c 1"), ("chr1:7-9", "A::B", "c 1"), ("chr1:1-2", "C", "c/2")], "peak string, tf string, condition string")
    tables.write_bed(rows.coalesce(1), str(tmp_path / "bed"))
    found = {f"{f.parent.parent.name}/{f.parent.name}": f.read_text() for f in (tmp_path / "bed").rglob("part-*.csv")}
    assert found == {"tf=A_B/condition=c_1": "chr1\t7\t9\nchr1\t50\t60\nchr2\t5\t9\n", "tf=C/condition=c_2": "chr1\t1\t2\n"}


def test_expression_by_symbol_else_identifier(spark):
    rna = spark.createDataFrame([("A", "E1", "s", 1.0), ("", "E2", "s", 2.0), (None, "E3", "s", 3.0), ("B", "A", "s", 4.0), ("C", None, "s", 5.0)], "gene string, ensembl string, sample string, value double")
    got = sorted((r.gene_key, r.value) for r in matrix.expression_lookup(rna).collect())
    # An identifier that is another row's symbol does not stand for itself.
    assert got == [("A", 1.0), ("B", 4.0), ("C", 5.0), ("E1", 1.0), ("E2", 2.0), ("E3", 3.0)]


def test_quoted_cells_with_separators(spark, tmp_path):
    folder = tmp_path / "s1" / "db" / "motif" / "M"
    folder.mkdir(parents=True)
    head = ["TFBS_chr", "TFBS_start", "TFBS_end", "TFBS_name", "note", "peak_chr", "peak_start", "peak_end", "s1_score", "s1_bound"]
    lines = ["\t".join(f'"{h}"' for h in head), 'chr1\t5\t9\tM\t"a\tb"\tchr1\t1\t99\t2.5\t1', 'chr1\t15\t19\tM\tplain\tchr1\t1\t99\t1.5\t0']
    (folder / "M_overview.txt").write_text("\n".join(lines) + "\n")
    got = {r.peak: (r.motif, r.region, r.score, r.bound) for r in tables.read_overviews(spark, str(folder / "M_overview.txt")).collect()}
    assert got == {"chr1:5-9": ("M", "chr1:1-99", 2.5, 1), "chr1:15-19": ("M", "chr1:1-99", 1.5, 0)}
    rows = tables.headed_rows(spark, str(folder / "M_overview.txt"), ("TFBS_chr", "note"), "\t")
    assert {r.row[4] for r in rows.select("row").collect()} == {"a\tb", "plain"} and rows.where(F.size("head") == len(head)).count() == 2
