"""Queries that do the whole job: no rows, positions or letters are left out."""

from pyspark.sql import functions as F

from helixloom.operators import qc
from helixloom.plans import catalogue
from helixloom.plans.inputs import features, reads

QUERIES = catalogue.queries()


def test_every_feature_is_inspected(spark, tmp_path):
    """Lines on both sides of 2000, the start from which feature_inspector leaves features out."""
    spark.createDataFrame([(k, "ACGTTGCA" * 900) for k in range(1, 4)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    lines = [(o, 1, part, 1 + o % 3, 20.0, "O", "N") for o, part in enumerate([5, 190, 200, 201, 650, 719, 5000], 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_linestatus string, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.feature_id for r in QUERIES["feature_inspector_all"](spark, str(tmp_path)).collect()}
    assert found == {r.feature_id for r in features(spark, str(tmp_path)).collect()} and len(found) == len(lines)
    assert QUERIES["feature_inspector"](spark, str(tmp_path)).count() == 2


def test_union_takes_whole_sides(spark, sf_dir):
    rows = {r.feature_id: r.contig for r in QUERIES["feature_union_all"](spark, sf_dir).collect()}
    orders = {r.o_orderkey * 10: r.o_custkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    lines = {r.feature_id: r.contig for r in features(spark, sf_dir).collect()}
    kept = {k: c for k, c in orders.items() if c not in set(lines.values())}
    assert kept and rows == lines | kept


def test_every_kmer_and_quality_counts(spark, sf_dir):
    length = {r.read_idx: r.n for r in reads(spark, sf_dir).select("read_idx", F.length("seq").alias("n")).collect()}
    kmers = {r.read_idx: r.kmers for r in QUERIES["fnv_kmer_hashes"](spark, sf_dir).collect()}
    assert kmers == {k: max(0, n - 9) for k, n in length.items()} and max(kmers.values()) > 1
    assert {r.read_idx: r.n for r in QUERIES["phred_totals"](spark, sf_dir).collect()} == {k: n for k, n in length.items() if n}


def test_every_position_and_read_has_a_share(spark):
    rows = spark.createDataFrame([(k, "I" * (3100 if k < 30 else 10)) for k in range(5100)], "read_idx long, qual string")
    found = qc.positional_quality(rows, first_reads=None, positions=None)
    assert found.agg(F.max("pos"), F.max("reads")).first()[:] == (3090, 5100)
    assert qc.positional_quality(rows).agg(F.max("pos"), F.max("reads")).first()[:] == (2990, 5000)


def test_bootstrap_has_100_replicates(spark, sf_dir):
    assert QUERIES["bootstrap_support"](spark, sf_dir).first()["replicates"] == 100
    assert QUERIES["split_tally"](spark, sf_dir).agg(F.max("n")).first()[0] > 20
