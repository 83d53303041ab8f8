"""Filters and checks that no registered query covers, and the table functions on awkward tables."""

import pytest
from pyspark.sql import functions as F

from helixloom.operators import clusters, registered, tables


def test_genes_are_filtered_by_text_and_flags(spark):
    schema = "locus_tag string, start long, length_aa int, rbs_score double, pi double, mw double, protein string, tm_segments array<int>, signal string, partial string"
    rows = [("GE_1", 5, 9, 0.1, 7.0, 1.0, "MKVLAAGGTTPQ", [1], None, None), ("GE_2", 3, 8, 0.2, 6.0, 2.0, "MALWMRLLPLLALL", [], "s", None), ("GE_3", 1, 7, 0.3, 5.0, 3.0, "MKVLAAGGTTPQRR", [1], "s", "5'")]
    genes = spark.createDataFrame(rows, schema)
    of = lambda **k: [r.locus_tag for r in tables.filter_genes(genes, **k).collect()]
    assert of() == ["GE_3", "GE_2", "GE_1"] and of(query=" ge_2 ") == ["GE_2"]
    assert of(query="MKVLAAGGTTPQXXXX", key="mw") == ["GE_1", "GE_3"]  # twelve letters count
    assert of(membrane=True, signal=True) == ["GE_3"] and of(partial=True) == ["GE_3"] and of(most=1) == ["GE_3"]
    with pytest.raises(ValueError):
        tables.filter_genes(genes, key="protein")


def test_protein_like_input(spark):
    of = lambda *seqs: tables.looks_like_protein(spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "ord long, seq string"))
    assert of("MKVLAAGGTTPQRR" * 5) and not of("ACGTACGTAC" * 6) and not of("MKV")
    assert not of(*["ACGT" * 20] * 5, "MKVL" * 400)  # only the first five


def test_traits_that_can_be_tested(spark):
    of = lambda cases, values, **k: tables.runnable(spark.createDataFrame(list(zip(cases, values, strict=True)), "is_case boolean, value double"), **k)
    of([True, True, False, False], [1.0] * 4)
    for cases in ([True] * 4, [True, False, False, False], [True, True, False]):
        with pytest.raises(ValueError):
            of(cases, [1.0] * len(cases))
    of([True] * 4, [1.0, 2.0, 3.0, 4.0], binary=False)
    with pytest.raises(ValueError):
        of([True] * 4, [1.0, float("nan"), 3.0, 4.0], binary=False)


def test_table_functions_equal_data_frames(spark):
    registered.register(spark)
    rows = [("c", k, k * 37 % 500, k * 37 % 500 + 20 + k * 13 % 200, "+-"[k % 2], float(k * 7 % 11), "kept") for k in range(60)] + [("d", 99, 5, 5, "+", 1.0, None)]
    calls = spark.createDataFrame(rows, "contig string, feature_id long, start long, end long, strand string, score double, extra string")
    found = spark.sql("SELECT * FROM resolve_overlaps(TABLE({t}))", t=calls)
    assert found.columns == calls.columns
    assert sorted(found.collect(), key=str) == sorted(clusters.resolved(calls, 60, 25).select(*calls.columns).collect(), key=str)
    lanes = spark.sql("SELECT contig, feature_id, strand, lane FROM pack_lanes(TABLE({t}))", t=calls)
    assert sorted(map(tuple, lanes.collect())) == sorted(map(tuple, clusters.lanes(calls).withColumn("lane", F.col("lane").cast("long")).collect()))
    assert spark.sql("SELECT * FROM pack_lanes(TABLE({t}))", t=calls.limit(0)).count() == 0
    with pytest.raises(Exception, match="score"):
        spark.sql("SELECT * FROM resolve_overlaps(TABLE({t}))", t=calls.drop("score")).count()
