"""Queries on gene annotation, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.functions.protein import HYDROPATHY, RESIDUE_MASS, WATER
from helixloom.operators import annotate as N
from helixloom.plans.inputs import READS, reads, with_views
from helixloom.plans.qc import CODE, RC
from helixloom.session import materialize


def _contigs(spark, sf_dir):
    return N.cleaned(reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq"))


def orf_scan(spark, sf_dir):
    rows = N.orf_scan(_contigs(spark, sf_dir), 90)
    return rows.select("contig", "strand", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "partial3", F.md5("orf").alias("orf_md5"))


def hexamer_background(spark, sf_dir):
    return N.hexamers(_contigs(spark, sf_dir))


def codon_usage(spark, sf_dir):
    rows = _contigs(spark, sf_dir).select(F.explode(S.codons(F.col("seq"))).alias("codon"))
    return rows.groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


def training_orfs(spark, sf_dir):
    return N.training_orfs(_contigs(spark, sf_dir)).select("contig", "strand", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _genes(spark, sf_dir):
    return N.annotate(reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq"))


def gene_calls(spark, sf_dir):
    return _genes(spark, sf_dir).drop("dna", "protein")


def annotation_summary(spark, sf_dir):
    return N.annotation_summary(materialize(_genes(spark, sf_dir), "annotated"), _contigs(spark, sf_dir))


def protein_props(spark, sf_dir):
    """Weight, hydropathy and aromatic share of the first frame of each read."""
    proteins = reads(spark, sf_dir).where(F.length("seq") >= 3).select("read_idx", S.translated(F.col("seq")).alias("protein"))
    return N.protein_properties(proteins, "read_idx").select("read_idx", F.col("length_aa").cast("long").alias("length_aa"), S.quantized(F.col("mw"), 1).alias("mw"), S.quantized(F.col("gravy"), 2).alias("gravy"), S.quantized(F.col("aromaticity"), 2).alias("aromaticity"))


def membrane_and_signal(spark, sf_dir):
    proteins = reads(spark, sf_dir).select("read_idx", S.translated(F.col("seq")).alias("protein"))
    return N.protein_properties(proteins, "read_idx").select("read_idx", "pi", "tm_segments", "signal", "localization")


QUERIES = {f.__name__: f for f in (orf_scan, hexamer_background, codon_usage, training_orfs, gene_calls, annotation_summary, protein_props, membrane_and_signal)}
CONTIGS = "v_contig AS (SELECT read_idx AS contig, regexp_replace(upper(seq), '[^ACGTN]', 'N', 'g') AS seq FROM v_reads WHERE length(seq) >= 150)"
ORFS = f"""v_strand AS (SELECT contig, '+' AS strand, seq FROM v_contig UNION ALL SELECT contig, '-', {RC.format("seq")} FROM v_contig),
    v_frame AS (SELECT contig, strand, seq, length(seq) AS len, f FROM v_strand, (VALUES (0), (1), (2)) t(f)),
    v_codon AS (SELECT contig, strand, len, f, k, substr(seq, k + 1, 3) AS codon FROM (SELECT *, unnest(range(f, len - 2, 3)) AS k FROM v_frame)),
    v_stop AS (SELECT contig, strand, len, f, k + 3 AS stop FROM v_codon WHERE codon IN ('TAA', 'TAG', 'TGA')),
    v_part AS (SELECT contig, strand, coalesce(lag(stop) OVER (PARTITION BY contig, strand, f ORDER BY stop), f) AS start, stop AS "end", false AS partial3 FROM v_stop
        UNION ALL SELECT a.contig, a.strand, a.start, a.start + (a.len - a.start) // 3 * 3, true
        FROM (SELECT x.contig, x.strand, x.len, coalesce(max(s.stop), x.f) AS start FROM v_frame x LEFT JOIN v_stop s USING (contig, strand, f) GROUP BY x.contig, x.strand, x.len, x.f) a),
    v_orf AS (SELECT * FROM v_part WHERE "end" - start >= 90)"""


def _sum(table: dict[str, float], other: float) -> str:
    return "(" + " + ".join(f"{v}::DOUBLE * (length(p) - length(replace(p, '{aa}', '')))" for aa, v in table.items()) + (f" + {other}::DOUBLE * length(translate(p, '{''.join(table)}', ''))" if other else "") + ")"


ORACLES = {
    "orf_scan": with_views('SELECT contig, strand, start, "end", partial3, md5(substr(seq, start + 1, "end" - start)) AS orf_md5 FROM v_orf JOIN v_strand USING (contig, strand)', READS, CONTIGS, ORFS),
    "hexamer_background": with_views("WITH h AS (SELECT substr(seq, k, 6) AS hexamer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS k FROM v_contig)) SELECT hexamer, count(*) AS n FROM h WHERE regexp_full_match(hexamer, '[ACGT]+') GROUP BY hexamer", READS, CONTIGS),
    "codon_usage": with_views("WITH c AS (SELECT substr(seq, k, 3) AS codon FROM (SELECT seq, unnest(range(1, length(seq) - 1, 3)) AS k FROM v_contig)) SELECT codon, count(*) AS n FROM c GROUP BY codon", READS, CONTIGS),
    "training_orfs": with_views(
        """WITH m AS (SELECT CASE WHEN count(*) FILTER ("end" - start >= 300) >= 40 THEN 300 WHEN count(*) FILTER ("end" - start >= 180) >= 20 THEN 180 ELSE 120 END AS least FROM v_orf)
        SELECT contig, strand, start, "end" FROM v_orf, m WHERE "end" - start >= least ORDER BY "end" - start DESC, contig, strand, start % 3, start LIMIT 600""",
        READS, CONTIGS, ORFS,
    ),
    "protein_props": with_views(
        f"""WITH t AS (SELECT read_idx, regexp_replace(list_aggregate(list_transform(range(length(seq) // 3), lambda i: coalesce({CODE}[substr(seq, i * 3 + 1, 3)], 'X')), 'string_agg', ''), '\\*$', '') AS p FROM v_reads WHERE length(seq) >= 3),
        m AS (SELECT read_idx, length(p) AS length_aa, floor(({WATER} + {_sum(RESIDUE_MASS, 110.0)}) * 10 + 0.5) / 10 AS mw,
              floor(CASE WHEN p = '' THEN 0 ELSE {_sum(HYDROPATHY, 0)} / length(p) END * 1000 + 0.5) / 1000 AS g, floor(CASE WHEN p = '' THEN 0 ELSE (length(p) - length(translate(p, 'FWY', ''))) / length(p) END * 1000 + 0.5) / 1000 AS a FROM t)
        SELECT read_idx, length_aa, mw, floor(g * 100 + 0.5) / 100 AS gravy, floor(a * 100 + 0.5) / 100 AS aromaticity FROM m""",
        READS,
    ),
}
