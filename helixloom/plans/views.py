"""Queries on the lists that a reader is shown (tops, labels, marks) and on the SQL functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions.sequence import bin_label, quantized
from helixloom.operators import alignment as A
from helixloom.operators import assoc, explorer, qc, registered
from helixloom.plans import alignment as alignment_plans
from helixloom.plans import assoc as assoc_plans
from helixloom.plans import explorer as explorer_plans
from helixloom.plans import qc as qc_plans
from helixloom.plans.inputs import FEATURES, READS, alignment, features, presence, reads, traits, with_views


def _contigs(spark, sf_dir):
    return reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq")


def yield_n50_point(spark, sf_dir):
    return qc.n50_point(qc.read_metrics(reads(spark, sf_dir)))


def length_histogram_labels(spark, sf_dir):
    bins = qc.length_histogram(qc.read_metrics(reads(spark, sf_dir)))
    return bins.select(F.col("bin").cast("long").alias("bin"), bin_label(F.col("range_start")).alias("label"), F.col("count").cast("long").alias("count"))


def ranked_bars(spark, sf_dir):
    rows = assoc.binary_scan(presence(spark, sf_dir), traits(spark, sf_dir), with_strata=False)
    return assoc.ranked_bars(rows).select("gene", quantized(F.col("y")).alias("y"))


def feature_list(spark, sf_dir):
    return explorer.feature_list(features(spark, sf_dir), 7).select("feature_id", "start", "type")


def feature_search_top(spark, sf_dir):
    return explorer.display_order(explorer.search(features(spark, sf_dir), "protein 12")).limit(explorer.MOST_FOUND).select("contig", "feature_id", "start", "type")


def motif_list(spark, sf_dir):
    return explorer.motif_list(_contigs(spark, sf_dir), 7, "RY")


def variant_list(spark, sf_dir):
    return A.variant_list(A.variable_sites(A.column_stats(alignment(spark, sf_dir)))).select("pos", "consensus", "total")


def find_motif_sql(spark, sf_dir):
    registered.register(spark)
    return spark.sql("SELECT d.contig, m.* FROM {rows} d, LATERAL find_motif(d.seq, 'GRTAYC') m", rows=_contigs(spark, sf_dir))


def lanes_sql(spark, sf_dir):
    registered.register(spark)
    return spark.sql("SELECT contig, feature_id, strand, lane FROM pack_lanes(TABLE({rows}))", rows=features(spark, sf_dir))


def resolved_sql(spark, sf_dir):
    """Features as calls, the longest best."""
    registered.register(spark)
    rows = features(spark, sf_dir).withColumn("score", (F.col("end") - F.col("start")).cast("double") + F.col("feature_id") / 1e9)
    return spark.sql("SELECT contig, feature_id, start, end, strand FROM resolve_overlaps(TABLE({rows}))", rows=rows)


def circular_ori_ter(spark, sf_dir):
    """Origin and terminus of contigs that begin and end with one letter, as a mark of circular ones."""
    contigs = _contigs(spark, sf_dir).withColumn("circular", F.substring("seq", 1, 1) == F.substring("seq", -1, 1))
    return explorer.circular_tracks(contigs)[1]


QUERIES = {f.__name__: f for f in (lanes_sql, resolved_sql, circular_ori_ter, yield_n50_point, length_histogram_labels, ranked_bars, feature_list, feature_search_top, motif_list, variant_list, find_motif_sql)}

RANK = "CASE type WHEN 'CDS' THEN 0 WHEN 'tRNA' THEN 1 WHEN 'rRNA' THEN 2 WHEN 'tmRNA' THEN 3 WHEN 'ncRNA' THEN 4 ELSE 5 END"


ORACLES = {
    "yield_n50_point": with_views(
        """WITH o AS (SELECT length, sum(length) OVER (ORDER BY length DESC, read_idx ROWS UNBOUNDED PRECEDING) AS upto FROM v_metrics)
        SELECT n50::BIGINT AS n50, min(upto)::BIGINT AS n50_cumulative_bases FROM o, v_summary WHERE length <= n50 GROUP BY n50""",
        READS, qc_plans.METRICS, qc_plans.SUMMARY,
    ),
    "length_histogram_labels": f"""SELECT bin, CASE WHEN range_start < 1000 THEN range_start::VARCHAR WHEN range_start % 1000 = 0 THEN (range_start // 1000) || 'k'
        ELSE ((range_start + 50) // 1000) || '.' || ((range_start + 50) // 100 % 10) || 'k' END AS label, count FROM ({qc_plans.ORACLES["length_histogram"]})""",
    "ranked_bars": with_views(f"SELECT gene, {assoc_plans._q('(-log10(greatest(p, 1e-300)))')} AS y FROM v_fisher ORDER BY p, gene LIMIT 400", *assoc_plans.V, assoc_plans.FISHER),
    "feature_list": with_views(f"SELECT feature_id, start, type FROM v_features WHERE contig = 7 ORDER BY start, {RANK}, feature_id LIMIT 300", FEATURES),
    "feature_search_top": with_views(
        f"""SELECT contig, feature_id, start, type FROM v_features WHERE contains(lower(tag), 'protein 12') OR contains(lower(product), 'protein 12') OR lower(type) = 'protein 12'
        ORDER BY contig, start, {RANK}, feature_id LIMIT 60""",
        FEATURES,
    ),
    "motif_list": with_views(
        """WITH b AS (SELECT length(seq) AS len, seq FROM v_reads WHERE read_idx = 7),
        s AS (SELECT len, '+' AS strand, regexp_replace(seq, '([AG][CT])', chr(1) || '\\1' || chr(1), 'g') AS s FROM b
              UNION ALL SELECT len, '-', regexp_replace(reverse(translate(seq, 'ACGT', 'TGCA')), '([AG][CT])', chr(1) || '\\1' || chr(1), 'g') FROM b),
        e AS (SELECT len, strand, unnest(range(len(string_split(s, chr(1))))) AS k, unnest(string_split(s, chr(1))) AS piece FROM s),
        c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY strand ORDER BY k) AS stop FROM e)
        SELECT 7::BIGINT AS contig, CASE WHEN strand = '+' THEN stop - 2 ELSE len - stop END::BIGINT AS start, CASE WHEN strand = '+' THEN stop ELSE len - stop + 2 END::BIGINT AS "end", strand,
               CASE WHEN strand = '+' THEN piece ELSE reverse(translate(piece, 'ACGT', 'TGCA')) END AS match FROM c WHERE k % 2 = 1 ORDER BY start, strand LIMIT 120""",
        READS,
    ),
    "variant_list": f"""WITH v AS ({alignment_plans.ORACLES["variable_sites"]}) SELECT pos, consensus, (SELECT count(*) FROM v) AS total FROM v ORDER BY pos LIMIT 5000""",
    "lanes_sql": explorer_plans.ORACLES["lane_packing"],
    "resolved_sql": f"""WITH RECURSIVE {FEATURES},
        o AS (SELECT contig, feature_id, start, "end" AS stop, strand, row_number() OVER (PARTITION BY contig ORDER BY ("end" - start)::DOUBLE + feature_id / 1e9 DESC, strand, start) AS k FROM v_features),
        r AS (SELECT contig, k, [{{'f': feature_id, 'a': start, 'b': stop, 's': strand}}] AS taken FROM o WHERE k = 1 UNION ALL
            SELECT o.contig, o.k, CASE WHEN len(list_filter(r.taken, lambda t: least(t.b, o.stop) - greatest(t.a, o.start) > CASE WHEN t.s = o.strand THEN 60 ELSE 25 END)) = 0
                THEN list_append(r.taken, {{'f': o.feature_id, 'a': o.start, 'b': o.stop, 's': o.strand}}) ELSE r.taken END FROM r JOIN o ON o.contig = r.contig AND o.k = r.k + 1),
        e AS (SELECT contig, unnest(taken) AS t FROM (SELECT contig, arg_max(taken, k) AS taken FROM r GROUP BY contig))
        SELECT contig, t.f AS feature_id, t.a AS start, t.b AS "end", t.s AS strand FROM e""",
    "circular_ori_ter": explorer_plans.ORACLES["ori_ter"].replace("v_reads AS (", "v_all AS (", 1).replace("v_sized AS (", "v_reads AS (SELECT * FROM v_all WHERE left(seq, 1) = right(seq, 1)),\n    v_sized AS (", 1),
    "find_motif_sql": explorer_plans.ORACLES["motif_hits"],
}
