"""Keys that stay unique over files and samples, records by byte range, and tracks whose time grows with the contig."""

import time

import numpy as np

from helixloom.operators import assoc, explorer
from helixloom.sources import fastq, matrices


def write(path, name, n):
    path.joinpath(name).write_text("".join(f"@{name}{k} d\nACGT{'A' * k}\n+\n{'I' * (4 + k)}\n" for k in range(n)))


def test_read_keys_are_unique_over_files_and_ranges(spark, tmp_path):
    fastq.register(spark)
    write(tmp_path, "a.fastq", 40)
    write(tmp_path, "b.fastq", 40)
    for split in ("0", "300"):
        rows = spark.read.format("fastq").option("splitBytes", split).load(str(tmp_path)).collect()
        assert len(rows) == 80 == len({r.read_idx for r in rows})
        assert [r.id for r in sorted(rows, key=lambda r: r.read_idx)] == [f"{f}.fastq{k}" for f in "ab" for k in range(40)]


def test_records_are_fetched_by_range(spark, tmp_path):
    fastq.register(spark)
    write(tmp_path, "a.fastq", 30)
    rows = spark.read.format("fastq").load(str(tmp_path))
    wanted = [r for r in rows.collect() if r.byte_len % 3 == 0]
    places = spark.createDataFrame([(r.file, r.byte_start, r.byte_len) for r in wanted], "file string, byte_start long, byte_len long")
    assert sorted(fastq.fetch(places).collect()) == sorted((r.file, r.byte_start, r.id, r.desc, r.seq, r.qual) for r in wanted)
    assert fastq.fetch(places.limit(0)).count() == 0


def test_later_row_of_a_sample_counts_once(spark, tmp_path):
    tmp_path.joinpath("t.csv").write_text("sample,trait\ns1,case\ns2,control\ns1,control\n")
    rows = matrices.phenotypes(spark, str(tmp_path / "t.csv"))
    traits = rows.selectExpr("sample", "trait = 'case' AS is_case", "1.0 AS value", "'x' AS stratum", "row")
    presence = spark.createDataFrame([("g", "s1", True), ("g", "s2", False)], "gene string, sample string, present boolean")
    assert assoc.contingency(presence, traits).first()[:] == ("g", 0, 1, 0, 1)
    assert assoc.stratified(presence, traits).first()[:] == ("g", "x", 0, 1, 0, 1)
    assert assoc.continuous_scan(presence, traits).select("n_present", "n_absent").first()[:] == (1, 1)


def test_tracks_take_time_by_length(spark):
    rng = np.random.default_rng(1)
    seq = "".join(rng.choice(list("ACGT"), 4_000_000))
    contigs = spark.createDataFrame([("c", seq), ("short", "ACG"), ("none", None)], "contig string, seq string")
    began = time.perf_counter()
    tracks = explorer.skew_tracks(contigs).collect()
    assert explorer.gc_track(contigs).count() > 0 and time.perf_counter() - began < 15
    win = len(seq) // 1400
    assert len(tracks) == (len(seq) - win) // (win // 2) + 1
    for r in tracks[::500]:
        part = seq[r.start : r.start + win]
        g, c = part.count("G"), part.count("C")
        assert abs(r.gc - (g + c) / win) < 1e-12 and abs(r.skew - (g - c) / (g + c)) < 1e-12


def test_display_order(spark):
    rows = [("c", 3, 5, "gene"), ("c", 2, 5, "tRNA"), ("c", 1, 5, "CDS"), ("c", 4, 1, "ncRNA"), ("b", 5, 9, "CDS")]
    features = spark.createDataFrame(rows, "contig string, feature_id long, start long, type string")
    assert [r.feature_id for r in explorer.display_order(features).collect()] == [5, 4, 1, 2, 3]
