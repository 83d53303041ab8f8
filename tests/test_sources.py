"""Readers and writers: round trips and damaged input."""

import gzip

import pytest

from helixloom.operators import explorer
from helixloom.sources import fastq, matrices, samples, sequences, writers
from helixloom.streaming.lengths import drained, length_counts


@pytest.fixture
def folder(tmp_path):
    rows = "".join(f"@{i} {d}\n{s}\n+\n{q}\n" for i, d, s, q in samples.reads(60, 5000, 300))
    (tmp_path / "a.fastq").write_text("junk\n" + rows + "@bad\nACG\n+\nII\n@cut\nAC\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as out:
        out.write(rows.replace("\n", "\r\n"))
    return tmp_path


def test_fastq(spark, folder):
    fastq.register(spark)
    rows = spark.read.format("fastq").load(str(folder)).collect()
    assert len(rows) == 120 and all(len(r.seq) == len(r.qual) for r in rows)
    assert {r.message for r in spark.read.format("fastq").option("issues", "true").load(str(folder)).collect()} == {"expected a header", "bad: 3 bases and 2 qualities"}
    split = spark.read.format("fastq").option("splitBytes", "4000").load(str(folder / "a.fastq"))
    assert sorted(r.id for r in split.collect()) == sorted(r.id for r in rows if r.file.endswith("a.fastq"))
    data = (folder / "a.fastq").read_bytes()
    first = next(r for r in rows if r.file.endswith("a.fastq"))
    assert data[first.byte_start : first.byte_start + first.byte_len].decode().startswith(f"@{first.id} {first.desc}\n{first.seq}\n")
    counts = drained(length_counts(spark.readStream.format("fastq").load(str(folder)))).collect()
    assert sum(r.reads for r in counts) == 120


def test_fastq_written_and_read_again(spark, folder, tmp_path):
    fastq.register(spark)
    rows = spark.read.format("fastq").load(str(folder / "a.fastq"))
    writers.fastq(rows).coalesce(1).write.text(str(tmp_path / "out"))
    again = spark.read.format("fastq").load(str(tmp_path / "out"))
    assert {(r.id, r.desc, r.seq, r.qual) for r in rows.collect()} == {(r.id, r.desc, r.seq, r.qual) for r in again.collect()}


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nacg\nt\n>\nAC GT\n>empty\n>a\nTT\n")
    rows = sequences.fasta(sequences.texts(spark, str(tmp_path / "x.fa"))).orderBy("ord").collect()
    assert [(r.id, r.seq) for r in rows] == [("a", "ACGT"), ("seq_2", "ACGT"), ("a", "TT")]
    clean = sequences.sanitized(sequences.pasted(spark, ">a\nAC-1\n>a\nGG\n>b\n11"))
    assert {(r.id, r.seq) for r in clean.collect()} == {("a", "AC-"), ("a_2", "GG")}
    assert [r.id for r in sequences.pasted(spark, "ACG  TTT").orderBy("ord").collect()] == ["pasted_1", "pasted_2"]
    long = spark.createDataFrame([("s", "A" * 170)], "id string, seq string")
    assert writers.fasta(long).first().value == ">s\n" + "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 10


GFF = """##gff-version 3
##sequence-region c1 1 500
c1\tx\tregion\t1\t500\t.\t+\t.\tID=r;Is_circular=true
c1\tx\tgene\t10\t90\t.\t-\t.\tID=g1;locus_tag=L1;product=a%20b+c;product=second
c1\tx\tCDS\t10\t90\t.\t-\t0\tParent=g1
c1\tx\tgene\t100\t200\t.\t+\t.\tgene_id "G2"; note "hi"
c1\tx\ttRNA\t9\t5\t.\t+\t.\tID=bad
##FASTA
>c1 d
ACGTNNxx
"""
GENBANK = """LOCUS       c9 30 bp
DEFINITION  test
FEATURES             Location/Qualifiers
     source          1..30
     gene            complement(join(3..9,
                     12..20))
                     /locus_tag="T1"
                     /product="long
                     name"
ORIGIN
        1 acgtacgtac gtacgtacgt
//
"""


def test_gff_and_genbank(spark):
    source = spark.createDataFrame([("a", GFF)], "file string, text string")
    rows = sequences.gff_rows(source)
    region = sequences.gff_regions(rows).first()
    assert (region.start, region.end, region.length, region.circular) == (1, 500, 500, True)
    named = explorer.labelled(explorer.resolve_parents(sequences.gff_features(rows))).orderBy("start").collect()
    assert [(r.type, r.locus_tag, r.full_product) for r in named] == [("CDS", "L1", "a b c"), ("gene", "G2", "hi")]
    assert named[1].display_type == "CDS"
    assert sequences.gff_fasta(source).first().seq == "ACGTNNNN"
    found = sequences.genbank(spark.createDataFrame([("b", GENBANK)], "file string, text string")).collect()
    assert found[0].seq == "ACGT" * 5
    assert (found[1].start, found[1].end, found[1].strand, found[1].tag, found[1].product) == (2, 20, "-", "T1", "longname")
    assert [sequences.sniff(x) for x in (GFF, GENBANK, ">a\nAC")] == ["gff", "genbank", "fasta"]


def test_matrix_and_phenotypes(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"Gene","Annotation","s1","s2","s3"\n"g1","x, y","1","0","1"\n"g2","","0","","yes"\n"g1","dup","0","0","0"\n')
    cells = {(r.gene, r.sample): r.present for r in matrices.presence(spark, str(tmp_path / "m.csv")).collect()}
    assert cells == {("g1", "s1"): True, ("g1", "s2"): False, ("g1", "s3"): True, ("g2", "s1"): False, ("g2", "s2"): False, ("g2", "s3"): True}
    (tmp_path / "t.tsv").write_text("Gene\ts1\ts2\ng1\ttag_1\t\ng2\t0\t\n")
    tags = {(r.gene, r.sample): r.present for r in matrices.presence(spark, str(tmp_path / "t.tsv")).collect()}
    assert tags == {("g1", "s1"): True, ("g1", "s2"): False, ("g2", "s1"): True, ("g2", "s2"): False}
    (tmp_path / "p.csv").write_text("n,sample,trait\n1,s1,yes\n2,s2,no\n")
    assert {r["sample"] for r in matrices.phenotypes(spark, str(tmp_path / "p.csv")).collect()} == {"s1", "s2"}
    assert matrices.pick_trait({"a": "text", "b": "numeric", "c": "binary"}) == "c"


def test_alignment_texts():
    text = writers.clustal(["a", "b"], ["ACGT-", "ACAT-"])
    assert text.splitlines()[4].endswith("**:* ")
    assert writers.phylip(["longname_abc", "longname_abd"], ["AC", "AG"]).splitlines()[1:] == ["longname_aAC", "longname01AG"]
    assert "NTAX=1 NCHAR=2" in writers.nexus(["a b"], ["AC"])
    assert writers.fixed(0.125, 2) == "0.13" and writers.fixed(1.005, 2) == "1.00"


def test_genbank_round_trip(spark):
    contigs = spark.createDataFrame([(1, "ACGT" * 40)], "contig long, seq string")
    genes = spark.createDataFrame([(1, 3, 90, "-", "GE_00001", "hypothetical protein", "MKV")], "contig long, start long, end long, strand string, locus_tag string, product string, protein string")
    text = writers.genbank(contigs, genes).select("value").withColumnRenamed("value", "text")
    found = sequences.genbank(text.selectExpr("'f' AS file", "text")).collect()
    assert found[0].seq == "ACGT" * 40 and (found[1].start, found[1].end, found[1].strand, found[1].tag) == (3, 90, "-", "GE_00001")
