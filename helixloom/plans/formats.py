"""Queries that write files from the driver's tables into the shared folder and read them again, and operators over chunks, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions.sequence import quantized
from helixloom.operators import chunked, explorer
from helixloom.plans import explorer as explorer_plans
from helixloom.plans import tables as table_plans
from helixloom.plans.inputs import FEATURES, READS, features, reads, with_views
from helixloom.session import fresh_path
from helixloom.sources import chunks, fastq, writers
from helixloom.streaming.lengths import drained

SIZE, SPLIT = 1 << 12, 1 << 20


def _reads(spark, sf_dir):
    return reads(spark, sf_dir).where("seq <> ''")


def _fastq(spark, sf_dir) -> str:
    path = fresh_path(spark, "fastq")
    writers.fastq(_reads(spark, sf_dir).withColumn("desc", F.concat(F.lit("length="), F.length("seq").cast("string")))).write.text(path)
    fastq.register(spark)
    return path


def _scanned(rows):
    return rows.select("id", "desc", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5"))


def fastq_scan(spark, sf_dir):
    """Written as FASTQ and read again by byte ranges."""
    return _scanned(spark.read.format("fastq").option("splitBytes", str(SPLIT)).load(_fastq(spark, sf_dir)))


def fastq_stream_scan(spark, sf_dir):
    """Written as FASTQ and read as a stream of files."""
    return drained(_scanned(fastq.stream(spark, _fastq(spark, sf_dir))), "append")


def fastq_fetch(spark, sf_dir):
    """Records found by a scan and fetched again by their places."""
    path = _fastq(spark, sf_dir)
    places = spark.read.format("fastq").load(path).where("length(seq) % 3 = 0").select("file", "byte_start", "byte_len")
    return _scanned(fastq.fetch(places))


def _fasta(spark, sf_dir):
    path = fresh_path(spark, "fasta")
    writers.fasta(_reads(spark, sf_dir)).write.text(path)
    return chunks.fasta(spark, path, SIZE, SPLIT)


def fasta_scan(spark, sf_dir):
    """The records of FASTA files read by byte ranges."""
    return _fasta(spark, sf_dir)[0].select("id", "desc", "len")


def fasta_chunks(spark, sf_dir):
    """The chunks of FASTA files read by byte ranges."""
    return _fasta(spark, sf_dir)[1].select("contig", "len", "start", F.md5("seq").alias("seq_md5"))


def gff_scan(spark, sf_dir):
    """Features written as GFF3 and read again by lines."""
    path = fresh_path(spark, "gff")
    writers.feature_gff3(features(spark, sf_dir)).write.text(path)
    rows = chunks.gff_lines(spark, path)
    return rows.select("contig", "start", "end", "strand", "type", F.col("attrs")["locus_tag"].alias("tag"), F.col("attrs")["product"].alias("product"))


def _genbank(spark, sf_dir):
    path = fresh_path(spark, "genbank")
    contigs = _reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq")
    genes = features(spark, sf_dir).select("contig", "start", "end", "strand", F.col("tag").alias("locus_tag"), "product", F.lit("MKV").alias("protein"))
    writers.genbank_lines(contigs, genes).write.text(path, compression="gzip")
    return chunks.genbank(spark, path, SIZE, SPLIT)


def genbank_scan(spark, sf_dir):
    """Contigs with their features written as packed GenBank and read again: the features."""
    return _genbank(spark, sf_dir)[0].where("kind = 'feature'").select("contig", "start", "end", "strand", "tag", "product")


def genbank_chunks(spark, sf_dir):
    return _genbank(spark, sf_dir)[1].select("contig", "len", "start", F.md5("seq").alias("seq_md5"))


def _cut(spark, sf_dir):
    return chunks.cut(reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq"), SIZE)


def chunk_skew_tracks(spark, sf_dir):
    rows = chunked.skew_tracks(_cut(spark, sf_dir))
    return rows.select("contig", "start", quantized(F.col("gc")).alias("gc"), quantized(F.col("skew")).alias("skew"))


def chunk_ori_ter(spark, sf_dir):
    return explorer.origin_terminus(chunked.skew_tracks(_cut(spark, sf_dir)))


def chunk_gc_track(spark, sf_dir):
    return chunked.gc_track(_cut(spark, sf_dir))


def chunk_motif_hits(spark, sf_dir):
    return chunked.motif_hits(_cut(spark, sf_dir), "GRTAYC")


def chunk_feature_inspector(spark, sf_dir):
    rows = chunked.inspect_feature(features(spark, sf_dir), _cut(spark, sf_dir), SIZE)
    return rows.select("feature_id", F.md5("dna").alias("dna_md5"), quantized(F.col("gc")).alias("gc"), F.md5("protein").alias("protein_md5"), "placeholder")


QUERIES = {
    f.__name__: f
    for f in (
        fastq_scan, fastq_stream_scan, fastq_fetch, fasta_scan, fasta_chunks, gff_scan, genbank_scan, genbank_chunks, chunk_skew_tracks, chunk_ori_ter, chunk_gc_track, chunk_motif_hits,
        chunk_feature_inspector,
    )
}

SCAN = "SELECT id, 'length=' || length(seq) AS desc, length(seq) AS length, md5(seq) AS seq_md5, md5(qual) AS qual_md5 FROM v_reads WHERE seq <> ''"
CHUNKS = "SELECT {} AS contig, length(seq) AS len, start, md5(substr(seq, start + 1, " + str(SIZE) + ")) AS seq_md5 FROM (SELECT *, unnest(range(0, length(seq), " + str(SIZE) + ")) AS start FROM v_reads WHERE seq <> '')"
ORACLES = {
    "fastq_scan": with_views(SCAN, READS),
    "fastq_stream_scan": with_views(SCAN, READS),
    "fastq_fetch": with_views(f"{SCAN} AND length(seq) % 3 = 0", READS),
    "fasta_scan": with_views("SELECT id, id AS desc, length(seq) AS len FROM v_reads WHERE seq <> ''", READS),
    "fasta_chunks": with_views(CHUNKS.format("id"), READS),
    "gff_scan": with_views('SELECT contig::VARCHAR AS contig, start, "end", strand, type, tag, product FROM v_features', FEATURES),
    "genbank_scan": with_views("""SELECT contig::VARCHAR AS contig, start, "end", strand, tag, product FROM v_features WHERE contig IN (SELECT read_idx FROM v_reads WHERE seq <> '')""", FEATURES, READS),
    "genbank_chunks": with_views(CHUNKS.format("read_idx::VARCHAR"), READS),
    "chunk_skew_tracks": explorer_plans.ORACLES["gc_skew_tracks"],
    "chunk_ori_ter": explorer_plans.ORACLES["ori_ter"],
    "chunk_gc_track": explorer_plans.ORACLES["gc_track"],
    "chunk_motif_hits": explorer_plans.ORACLES["motif_hits"],
    "chunk_feature_inspector": table_plans.ORACLES["feature_inspector_all"],
}
