"""Files in byte ranges and contigs in chunks give what whole files and whole contigs give."""

import random

import pytest
from pyspark.sql import functions as F

from helixloom.sources import chunks, sequences
from tests.test_sources import GENBANK, GFF


def records(rng, n=12):
    return [(f"c{k} of {k}" if k != 3 else "", "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 7, 300, 1000, 2500])))) for k in range(n)]


def fasta_text(rows, width):
    return "junk\n" + "".join(f">{name}\n" + "".join(f"{seq[k : k + width]}\n" for k in range(0, len(seq), width)) for name, seq in rows)


def joined(table):
    out = {}
    for r in sorted(table.collect(), key=lambda r: (r.contig, r.start)):
        assert r.start == len(out.setdefault(r.contig, ("", r.len))[0])
        out[r.contig] = (out[r.contig][0] + r.seq, r.len)
    assert all(len(s) == n for s, n in out.values())
    return {c: s for c, (s, _) in out.items()}


@pytest.mark.parametrize(("width", "split"), [(60, 100), (60, 7), (10_000, 333), (1, 64), (70, 1 << 20)])
def test_fasta_in_ranges_equals_whole_files(spark, tmp_path, width, split):
    for k in range(2):
        rows = [(f"f{k}_{name}" if name else "", seq) for name, seq in records(random.Random(k))]
        (tmp_path / f"{k}.fa").write_text(fasta_text(rows if k else rows[:3] + rows[4:], width).replace("\n", "\r\n" if k else "\n"))
    found, table = chunks.fasta(spark, str(tmp_path), size=128, split=split)
    whole = sequences.fasta(sequences.texts(spark, str(tmp_path))).collect()
    assert joined(table) == {r.id: r.seq for r in whole}
    assert sorted((r.id, r.desc, r.len) for r in found.collect()) == sorted((r.id, r.desc, len(r.seq)) for r in whole)
    assert all(len(r.seq) <= 128 and r.start % 128 == 0 for r in table.collect())


def test_gff_lines_equal_whole_files(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    (tmp_path / "b.gff").write_text(GFF.replace("##FASTA", "# no FASTA").replace("c1", "c2"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    found = chunks.gff_lines(spark, str(tmp_path))
    whole = sequences.gff_rows(sequences.texts(spark, str(tmp_path)))
    of = lambda rows: sorted(map(str, rows.drop("ord", "file").collect()))
    assert of(found) == of(whole)
    order = [r.start for r in found.where(F.col("contig") == "c1").orderBy("ord").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order == [r.start for r in whole.where(F.col("contig") == "c1").orderBy("ord").collect()]
    assert joined(chunks.fasta(spark, str(tmp_path / "a.gff"), size=4, split=16)[1]) == {"c1": "ACGTNNXX"}


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_genbank_in_ranges_equals_whole_files(spark, tmp_path, split):
    text = "".join(GENBANK.replace("c9", f"c{k}").replace("acgtacgtac gtacgtacgt", "acgt" * k + "\n       21 " + "ttg" * 50 * (k % 3)) for k in range(7))
    (tmp_path / "a.gb").write_text("note\n" + text)
    rows, table = chunks.genbank(spark, str(tmp_path), size=32, split=split)
    whole = sequences.genbank(sequences.texts(spark, str(tmp_path)))
    assert joined(table) == {r.contig: r.seq for r in whole.where("kind = 'record'").collect() if r.seq}
    of = lambda t: sorted(map(str, t.select("kind", "contig", "desc", "type", "start", "end", "strand", "tag", "product").collect()))
    assert of(rows) == of(whole)


def test_cut_rows_join_again(spark):
    rows = [("a", "ACGT" * 100), ("b", ""), ("c", None), ("d", "A" * 64)]
    table = chunks.cut(spark.createDataFrame(rows, "contig string, seq string"), 64)
    assert joined(table) == {c: s for c, s in rows if s is not None}
