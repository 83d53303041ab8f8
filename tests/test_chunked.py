"""Operators over chunk tables against those over whole contigs, at chunk sizes that cut windows, features and motifs."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from helixloom.operators import chunked, explorer, tables
from helixloom.sources import chunks


@pytest.fixture(scope="module")
def contigs(spark):
    rng = random.Random(4)
    seq = lambda n, letters="ACGTN": "".join(rng.choice(letters) for _ in range(n))
    rows = [(1, seq(97)), (2, seq(5000)), (3, "A" * 700 + seq(50) + "A" * 64 * 5), (4, ""), (5, None), (6, "acgt" * 40), (7, seq(46_000, "ACGT")), (8, "AG" * 300), (9, seq(64)), (10, "TA" * 31)]
    return spark.createDataFrame(rows, "contig long, seq string").repartition(3).cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("size", [64, 1000])
def test_tracks(contigs, size):
    table = chunks.cut(contigs, size)
    assert rows(chunked.windows(table, 32, 1400)) == rows(explorer.windows(contigs, 32, 1400))
    assert rows(chunked.windows(table, 33, 7)) == rows(explorer.windows(contigs, 33, 7))
    assert rows(explorer.origin_terminus(chunked.skew_tracks(table))) == rows(explorer.origin_terminus(explorer.skew_tracks(contigs)))
    assert rows(chunked.gc_track(table)) == rows(explorer.gc_track(contigs))


def test_windows_of_whole_contigs_are_plain_counts(contigs):
    seqs = {r.contig: r.seq for r in contigs.collect()}
    found = explorer.windows(contigs, 33, 7).collect()
    assert len(found) > 50
    for r in found:
        part = seqs[r.contig][r.start : r.start + r.win]
        assert (r.G, r.C, r.known) == (part.count("G"), part.count("C"), sum(map(part.count, "ACGT")))


@pytest.mark.parametrize("size", [64, 1000])
def test_slices(spark, contigs, size):
    rng = random.Random(6)
    spans = [(rng.randrange(1, 12), a := rng.randrange(-20, 6000), a + rng.choice([0, 1, 30, 64, 65, 700, 9000])) for _ in range(400)]
    features = spark.createDataFrame([(c, k % 390, a, b, rng.choice("+-"), rng.choice(["CDS", "tRNA"])) for k, (c, a, b) in enumerate(spans)], "contig long, feature_id long, start long, end long, strand string, type string")
    assert rows(chunked.inspect_feature(features, chunks.cut(contigs, size), size)) == rows(tables.inspect_feature(features, contigs.where("seq IS NOT NULL")))


@pytest.mark.parametrize(("motif", "size"), [("GRTAYC", 64), ("AAA", 64), ("ANA", 64), ("RY", 64), ("A", 64), ("AGAG", 64), ("TATATA", 1000), ("", 64), ("NNNNNNNNNNNN", 64)])
def test_motif_hits(contigs, motif, size):
    table = chunks.cut(contigs, size)
    found, whole = chunked.motif_hits(table, motif), explorer.motif_hits(contigs.where("seq IS NOT NULL"), motif) if motif else None
    assert rows(found) == (rows(whole.select(found.columns)) if motif else [])


def test_memory_does_not_grow_with_the_contig():
    """The kernel of one chunk after another, in a process of its own: 50 Mb in chunks take no more than 1 Mb."""
    code = """
import resource, numpy as np, pyarrow as pa
from helixloom.operators import chunked
seq = "ACGTTGCA" * (65536 // 8)
def batches(n):
    for k in range(n):
        yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([n * 65536]), pa.array([k * 65536]), pa.array([seq])], names=["contig", "len", "start", "seq"])
sum(b.num_rows for b in chunked._cells(32, 1400)(batches(16)))
small = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
sum(b.num_rows for b in chunked._cells(32, 1400)(batches(800)))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - small)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 20_000
