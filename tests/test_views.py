"""Lists, labels and marks that a reader is shown, and the functions for SQL."""

import pytest
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import assoc, explorer, qc, registered, tables
from helixloom.sources import matrices


def test_labels(spark):
    starts = spark.createDataFrame([(0,), (500,), (1000,), (1500,), (7500,), (20000,)], "n long")
    assert [r[0] for r in starts.select(S.bin_label(F.col("n"))).collect()] == ["0", "500", "1k", "1.5k", "7.5k", "20k"]


def test_n50_point(spark):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([10, 8, 8, 5, 3, 1])], "read_idx long, length int")
    assert qc.n50_point(rows).first()[:] == (8, 18)
    assert qc.n50_point(rows.limit(0)).first()[:] in ((0, 0), (None, 0))


def test_case_label(spark, tmp_path):
    tmp_path.joinpath("t.csv").write_text("sample,trait,other\na,susceptible,x\nb,resistant,y\nc,, \n")
    rows = matrices.phenotypes(spark, str(tmp_path / "t.csv"))
    assert matrices.case_label(rows, "trait") == "resistant" and matrices.case_label(rows, "other") == "y"
    assert matrices.case_label(rows.limit(0), "trait") is None


def test_search_covers_products(spark):
    rows = spark.createDataFrame([("geneA", 0.1, None), ("geneB", 0.2, "Beta-lactamase"), ("lactA", 0.3, "other")], "gene string, p double, product string")
    assert [r.gene for r in tables.sorted_tests(rows, search="LACT").collect()] == ["geneB", "lactA"]
    assert tables.sorted_tests(rows.drop("product"), search="lact").first().gene == "lactA"


def test_ranked_bars(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.0), ("d", float("nan"))] + [(f"x{k:03}", 0.9) for k in range(500)], "gene string, p double")
    found = assoc.ranked_bars(rows).collect()
    assert len(found) == 400 and found[0][:] == ("c", 300.0) and found[1].gene == "a"


def test_single_contig_gives_its_name(spark):
    contigs = spark.createDataFrame([("chr1", "ACGT")], "contig string, seq string")
    one = spark.createDataFrame([("NC_1", 1), ("NC_1", 2)], "contig string, feature_id long")
    two = spark.createDataFrame([("NC_1", 1), ("NC_2", 2)], "contig string, feature_id long")
    assert {r.contig for r in tables.named_alike(contigs, one).collect()} == {"chr1"}
    assert {r.contig for r in tables.named_alike(contigs, two).collect()} == {"NC_1", "NC_2"}
    assert {r.contig for r in tables.named_alike(contigs.union(contigs), one).collect()} == {"NC_1"}
    assert tables.named_alike(contigs, one.limit(0)).count() == 0 and tables.named_alike(contigs.limit(0), one).count() == 2


def test_lists_are_tops(spark):
    contigs = spark.createDataFrame([(1, "AC" * 100), (2, None)], "contig long, seq string")
    found = explorer.motif_list(contigs, 1, "AC").collect()
    assert len(found) == 100 and [r.start for r in found] == sorted(r.start for r in found)
    assert explorer.motif_list(contigs, 1, "A").count() == 100 and explorer.motif_list(contigs, 1, "N").count() == explorer.MOST_HITS
    features = spark.range(500).selectExpr("1 AS contig", "id AS feature_id", "500 - id AS start", "'CDS' AS type", "concat('t', id) AS tag", "CAST(NULL AS string) AS product")
    assert [r.start for r in explorer.feature_list(features, 1).collect()] == list(range(1, 301))
    assert explorer.feature_list(features, 1, "T49").count() == 11


def test_sql_functions(spark):
    registered.register(spark)
    sql = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert sorted(sql("SELECT * FROM find_motif('ggACGTnn', 'ACGT')")) == [(2, 6, "+", "ACGT"), (2, 6, "-", "ACGT")]
    assert sql("SELECT * FROM find_motif(CAST(NULL AS string), 'A')") == sql("SELECT * FROM find_motif('ACGT', '')") == []
    assert sql("SELECT name, length, parent FROM parse_newick('(a:1,b:2)90:0.5;') ORDER BY node") == [("a", 1.0, 2), ("b", 2.0, 2), (None, 0.5, None)]
    assert sorted(sql("SELECT * FROM parse_gff_attributes('ID=g1;Name=x%20y')")) == [("ID", "g1"), ("Name", "x y")]
    assert sql("SELECT count(*) FROM minimizers('ACGTTGCATGCCGATAGC', 10, 5)")[0][0] > 0
    assert sql("SELECT chi_square_sf1(3.841458820694124D)")[0][0] == pytest.approx(0.05)
