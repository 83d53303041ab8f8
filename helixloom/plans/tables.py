"""Queries on table views and scalar functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import alignment as A
from helixloom.operators import assoc, qc
from helixloom.operators import tables as T
from helixloom.plans.assoc import CI, FISHER, TABLES
from helixloom.plans.inputs import ALIGNMENT, FEATURES, PRESENCE, READS, TRAITS, alignment, features, presence, reads, table, traits, with_views
from helixloom.plans.qc import CODE, METRICS, RC


def read_table_page(spark, sf_dir):
    rows = T.read_page(qc.read_metrics(reads(spark, sf_dir)), "length", descending=True, offset=20, rows=50)
    return rows.select("read_idx", F.col("length").cast("long").alias("length"), S.quantized(F.col("gc")).alias("gc"))


def batch_fetch(spark, sf_dir):
    """The reads whose number is an order's customer."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("read_idx"))
    return T.fetch(reads(spark, sf_dir), wanted).select("read_idx", F.md5("qual").alias("qual_md5"))


def effect_sorted_tests(spark, sf_dir):
    rows = assoc.binary_scan(presence(spark, sf_dir), traits(spark, sf_dir), with_strata=False)
    return T.sorted_tests(rows, "odds_ratio", "brand#1", 10).select("gene", *[S.quantized(F.col(c)).alias(c) for c in ("odds_ratio", "ci_lo", "ci_hi")])


def feature_inspector(spark, sf_dir):
    contigs = reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq")
    rows = T.inspect_feature(features(spark, sf_dir).where("start < 2000"), contigs)
    return rows.select("feature_id", F.md5("dna").alias("dna_md5"), S.quantized(F.col("gc")).alias("gc"), F.md5("protein").alias("protein_md5"), "placeholder")


def feature_inspector_all(spark, sf_dir):
    """Every feature, wherever it starts; feature_inspector is held to its SQL, which keeps those before 2000."""
    contigs = reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq")
    rows = T.inspect_feature(features(spark, sf_dir), contigs)
    return rows.select("feature_id", F.md5("dna").alias("dna_md5"), S.quantized(F.col("gc")).alias("gc"), F.md5("protein").alias("protein_md5"), "placeholder")


def conservation_track(spark, sf_dir):
    return T.conservation(A.column_stats(alignment(spark, sf_dir))).select("col", S.quantized(F.col("share")).alias("share"))


def feature_union(spark, sf_dir):
    """Positive and negative features as two sides; contigs of the negative side win."""
    f = features(spark, sf_dir).select("contig", "feature_id", "strand")
    return T.merge_by_contig(f.where("strand = '+'"), f.where("strand = '-' AND contig % 2 = 0"))


def feature_union_all(spark, sf_dir):
    """A feature of each order on its customer, and as the side that wins all features of the order lines; nothing is filtered by id."""
    lines = features(spark, sf_dir).select("contig", "feature_id", "strand")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contig"), (F.col("o_orderkey") * 10).alias("feature_id"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"))
    return T.merge_by_contig(orders, lines)


def phred_functions(spark, sf_dir):
    rows = reads(spark, sf_dir).where(F.length("qual") > 0)
    q = S.phred(F.substring("qual", 1, 1))
    return rows.select("read_idx", q.cast("long").alias("q"), S.quantized(S.error_probability(q), 9).alias("p"), S.quantized(S.quality_of(S.error_probability(q))).alias("back"))


def phred_totals(spark, sf_dir):
    """Every quality character of each read; phred_functions is held to its SQL, which converts the first."""
    return qc.phred_totals(reads(spark, sf_dir))


QUERIES = {f.__name__: f for f in (read_table_page, batch_fetch, effect_sorted_tests, feature_inspector, feature_inspector_all, conservation_track, feature_union, feature_union_all, phred_functions, phred_totals)}


def _q(x: str, digits: int = 6) -> str:
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


ORACLES = {
    "read_table_page": with_views(f"SELECT read_idx, length, {_q('gc')} AS gc FROM v_metrics ORDER BY length DESC, read_idx LIMIT 50 OFFSET 20", READS, METRICS),
    "batch_fetch": with_views("SELECT read_idx, md5(qual) AS qual_md5 FROM v_reads WHERE read_idx IN (SELECT o_custkey FROM orders)", READS),
    "effect_sorted_tests": with_views(f"SELECT gene, {CI} FROM v_or WHERE contains(lower(gene), 'brand#1') ORDER BY abs(lor) DESC, gene LIMIT 10", PRESENCE, TRAITS, TABLES, FISHER),
    "feature_inspector": with_views(
        f"""WITH m AS (SELECT f.*, substr(seq, greatest(0, start) + 1, greatest(0, least(length(seq), "end") - greatest(0, start))) AS part FROM v_features f JOIN v_reads ON read_idx = contig WHERE start < 2000),
        d AS (SELECT *, CASE WHEN strand = '-' THEN {RC.format("part")} ELSE part END AS dna FROM m)
        SELECT feature_id, md5(dna) AS dna_md5, {_q("CASE WHEN length(replace(dna, '-', '')) > 0 THEN (length(dna) - length(translate(dna, 'GCgc', ''))) * 100.0::DOUBLE / length(replace(dna, '-', '')) ELSE 0 END")} AS gc,
               CASE WHEN type IN ('CDS', 'gene') THEN md5(regexp_replace(coalesce(list_aggregate(list_transform(range(length(dna) // 3), lambda i: coalesce({CODE}[substr(dna, i * 3 + 1, 3)], 'X')), 'string_agg', ''), ''), '\\*$', '')) END AS protein_md5,
               length(replace(dna, 'N', '')) = 0 AS placeholder FROM d""",
        FEATURES, READS,
    ),
    "feature_inspector_all": with_views(
        f"""WITH m AS (SELECT f.*, substr(seq, greatest(0, start) + 1, greatest(0, least(length(seq), "end") - greatest(0, start))) AS part FROM v_features f JOIN v_reads ON read_idx = contig),
        d AS (SELECT *, CASE WHEN strand = '-' THEN {RC.format("part")} ELSE part END AS dna FROM m)
        SELECT feature_id, md5(dna) AS dna_md5, {_q("CASE WHEN length(replace(dna, '-', '')) > 0 THEN (length(dna) - length(translate(dna, 'GCgc', ''))) * 100.0::DOUBLE / length(replace(dna, '-', '')) ELSE 0 END")} AS gc,
               CASE WHEN type IN ('CDS', 'gene') THEN md5(regexp_replace(coalesce(list_aggregate(list_transform(range(length(dna) // 3), lambda i: coalesce({CODE}[substr(dna, i * 3 + 1, 3)], 'X')), 'string_agg', ''), ''), '\\*$', '')) END AS protein_md5,
               length(replace(dna, 'N', '')) = 0 AS placeholder FROM d""",
        FEATURES, READS,
    ),
    "conservation_track": with_views(f"SELECT col, {_q('greatest(count(*) FILTER (base = chr(65)), count(*) FILTER (base = chr(67)), count(*) FILTER (base = chr(71)), count(*) FILTER (base = chr(84))) / count(*)')} AS share FROM v_aln GROUP BY col", ALIGNMENT),
    "feature_union": with_views(
        """WITH r AS (SELECT contig, feature_id, strand FROM v_features WHERE strand = '-' AND contig % 2 = 0)
        SELECT contig, feature_id, strand FROM v_features WHERE strand = '+' AND contig NOT IN (SELECT contig FROM r) UNION ALL SELECT * FROM r""",
        FEATURES,
    ),
    "feature_union_all": with_views(
        """WITH l AS (SELECT o_custkey AS contig, o_orderkey * 10 AS feature_id, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand FROM orders)
        SELECT * FROM l WHERE contig NOT IN (SELECT contig FROM v_features) UNION ALL SELECT contig, feature_id, strand FROM v_features""",
        FEATURES,
    ),
    "phred_functions": with_views(
        f"SELECT read_idx, (ascii(qual) - 33)::BIGINT AS q, {_q('pow(10.0::DOUBLE, -(ascii(qual) - 33) / 10.0::DOUBLE)', 9)} AS p, {_q('(-10 * log10(greatest(pow(10.0::DOUBLE, -(ascii(qual) - 33) / 10.0::DOUBLE), 1e-12)))')} AS back FROM v_reads WHERE qual <> ''", READS
    ),
    "phred_totals": with_views(
        f"""WITH c AS (SELECT read_idx, list_transform(string_split(qual, ''), lambda c: (ascii(c) - 33)::BIGINT) AS q FROM v_reads WHERE qual <> ''),
        p AS (SELECT *, list_transform(q, lambda x: pow(10.0::DOUBLE, -x / 10.0::DOUBLE)) AS p FROM c)
        SELECT read_idx, len(q)::BIGINT AS n, list_min(q) AS min_q, list_max(q) AS max_q, list_sum(q)::BIGINT AS sum_q, {_q("list_sum(p)")} AS sum_p,
               {_q("list_sum(list_transform(p, lambda x: -10 * log10(greatest(x, 1e-12))))")} AS sum_back FROM p""",
        READS,
    ),
}
