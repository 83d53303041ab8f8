"""Queries on intervals, tracks and motifs, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions.sequence import quantized
from helixloom.operators import explorer
from helixloom.plans.inputs import FEATURES, READS, features, reads, with_views
from helixloom.plans.qc import RC


def _contigs(spark, sf_dir):
    return reads(spark, sf_dir).select(F.col("read_idx").alias("contig"), "seq")


def feature_viewport(spark, sf_dir):
    return explorer.viewport(features(spark, sf_dir), 7, 1000, 9000).select("feature_id", "start", "end", "strand")


def stabbing(spark, sf_dir):
    return explorer.stabbing(features(spark, sf_dir), 7, 5020).select("feature_id", "start", "end", "strand")


def interval_overlaps(spark, sf_dir):
    return explorer.overlaps(features(spark, sf_dir))


def gc_skew_tracks(spark, sf_dir):
    rows = explorer.skew_tracks(_contigs(spark, sf_dir))
    return rows.select("contig", "start", quantized(F.col("gc")).alias("gc"), quantized(F.col("skew")).alias("skew"))


def ori_ter(spark, sf_dir):
    return explorer.origin_terminus(explorer.skew_tracks(_contigs(spark, sf_dir)))


def gc_track(spark, sf_dir):
    return explorer.gc_track(_contigs(spark, sf_dir))


def motif_hits(spark, sf_dir):
    return explorer.motif_hits(_contigs(spark, sf_dir), "GRTAYC")


def feature_search(spark, sf_dir):
    return explorer.search(features(spark, sf_dir), " protein 12 ").select("feature_id", "tag", "product")


def _annotated(spark, sf_dir):
    """Genes and other features with ids, parents and tags that partly agree."""
    f = features(spark, sf_dir)
    gene = F.col("type") == "gene"
    order = F.floor(F.col("feature_id") / 10)
    return f.select(
        "contig", "start", "end", "strand", "type", F.col("feature_id").alias("ord"), F.when(gene, F.concat(F.lit("g"), order.cast("string"))).alias("id"),
        F.when(~gene & (F.col("feature_id") % 3 == 0), F.concat(F.lit("g"), order.cast("string"))).alias("parent"), F.when(F.col("feature_id") % 2 == 0, F.col("tag")).alias("tag"),
        F.when(F.col("feature_id") % 5 == 0, F.concat(F.lit("n"), order.cast("string"))).alias("name"), F.when(F.col("feature_id") % 7 == 0, F.col("product")).alias("product"), (F.col("feature_id") % 11 == 0).alias("is_pseudo"),
    )


def parent_gene_resolution(spark, sf_dir):
    return explorer.labelled(explorer.resolve_parents(_annotated(spark, sf_dir)), "ord", "contig").select("ord", "contig", "display_type", "locus_tag", "full_product")


def locus_tags(spark, sf_dir):
    return explorer.locus_tags(features(spark, sf_dir)).select("feature_id", "locus_tag")


def lane_packing(spark, sf_dir):
    return explorer.lane_packing(features(spark, sf_dir)).withColumn("lane", F.col("lane").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (feature_viewport, stabbing, interval_overlaps, gc_skew_tracks, ori_ter, gc_track, motif_hits, feature_search, parent_gene_resolution, locus_tags, lane_packing)
}


def _q(x: str, digits: int = 6) -> str:
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


def _n(letters: str) -> str:
    return f"(length(part) - length(translate(part, '{letters}', '')))"


WINDOWS = """v_sized AS (SELECT read_idx AS contig, seq, length(seq) AS len, greatest(32, length(seq) // 1400) AS win FROM v_reads),
    v_windows AS (SELECT contig, win, start, substr(seq, start + 1, win) AS part FROM (SELECT *, unnest(range(0, len - win + 1, greatest(1, win // 2))) AS start FROM v_sized WHERE len >= win)),
    v_counted AS (SELECT contig, win, start, length(part) - length(replace(part, 'G', '')) AS g, length(part) - length(replace(part, 'C', '')) AS c, length(part) - length(translate(part, 'ACGT', '')) AS known FROM v_windows),
    v_tracks AS (SELECT contig, start, (g + c) / known AS gc, CASE WHEN g + c > 0 THEN (g - c) / (g + c) ELSE 0 END AS skew FROM v_counted WHERE known >= win * 0.5)"""
ANNOTATED = """v_ann AS (SELECT contig, start, "end", strand, type, feature_id AS ord, CASE WHEN type = 'gene' THEN 'g' || feature_id // 10 END AS id,
    CASE WHEN type <> 'gene' AND feature_id % 3 = 0 THEN 'g' || feature_id // 10 END AS parent, CASE WHEN feature_id % 2 = 0 THEN tag END AS tag,
    CASE WHEN feature_id % 5 = 0 THEN 'n' || feature_id // 10 END AS name, CASE WHEN feature_id % 7 = 0 THEN product END AS product, feature_id % 11 = 0 AS is_pseudo,
    concat_ws(':', contig, start, "end", strand) AS span FROM v_features)"""
ORACLES = {
    "feature_viewport": with_views('SELECT feature_id, start, "end", strand FROM v_features WHERE contig = 7 AND "end" > 1000 AND start < 9000', FEATURES),
    "stabbing": with_views('SELECT feature_id, start, "end", strand FROM v_features WHERE contig = 7 AND start <= 5020 AND "end" >= 5020', FEATURES),
    "interval_overlaps": with_views(
        """SELECT x.contig, x.feature_id AS a, y.feature_id AS b, least(x."end", y."end") - greatest(x.start, y.start) AS overlap FROM v_features x JOIN v_features y ON x.contig = y.contig AND x.feature_id < y.feature_id
        WHERE least(x."end", y."end") - greatest(x.start, y.start) > CASE WHEN x.strand = y.strand THEN 60 ELSE 25 END""",
        FEATURES,
    ),
    "gc_skew_tracks": with_views(f"SELECT contig, start, {_q('gc')} AS gc, {_q('skew')} AS skew FROM v_tracks", READS, WINDOWS),
    "ori_ter": with_views(
        f"""WITH c AS (SELECT contig, start, {_q("sum(skew) OVER (PARTITION BY contig ORDER BY start ROWS UNBOUNDED PRECEDING)", 9)} AS cum FROM v_tracks)
        SELECT contig, first(start ORDER BY cum, start) AS origin, first(start ORDER BY cum DESC, start) AS terminus FROM c GROUP BY contig""",
        READS, WINDOWS,
    ),
    "gc_track": with_views(
        f"""WITH s AS (SELECT read_idx AS contig, seq, length(seq) AS len, greatest(200, length(seq) // 400) AS win FROM v_reads),
        w AS (SELECT contig, win, start, substr(seq, start + 1, win) AS part FROM (SELECT *, unnest(range(0, len - win + 1, win // 2)) AS start FROM s WHERE len >= win))
        SELECT contig, start + win // 2 AS pos, {_q(_n("GC") + " / win * 100", 2)} AS gc FROM w""",
        READS,
    ),
    "motif_hits": with_views(
        f"""WITH b AS (SELECT read_idx AS contig, length(seq) AS len, '+' AS strand, upper(seq) AS s FROM v_reads UNION ALL SELECT read_idx, length(seq), '-', {RC.format("upper(seq)")} FROM v_reads),
        p AS (SELECT contig, len, strand, string_split(regexp_replace(s, '([G][AG][T][A][CT][C])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM b),
        e AS (SELECT contig, len, strand, unnest(range(len(parts))) AS k, unnest(parts) AS piece FROM p),
        c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY contig, strand ORDER BY k) AS stop FROM e),
        h AS (SELECT *, stop - length(piece) AS begin FROM c WHERE k % 2 = 1)
        SELECT contig, CASE WHEN strand = '+' THEN begin ELSE len - stop END::BIGINT AS start, CASE WHEN strand = '+' THEN stop ELSE len - begin END::BIGINT AS "end", strand,
               CASE WHEN strand = '+' THEN piece ELSE {RC.format("piece")} END AS match FROM h""",
        READS,
    ),
    "feature_search": with_views("SELECT feature_id, tag, product FROM v_features WHERE contains(lower(tag), 'protein 12') OR contains(lower(product), 'protein 12') OR lower(type) = 'protein 12'", FEATURES),
    "parent_gene_resolution": with_views(
        """WITH g AS (SELECT * FROM v_ann WHERE type = 'gene'),
        bi AS (SELECT id AS k, max(ord) AS o FROM g WHERE id IS NOT NULL GROUP BY id), bt AS (SELECT tag AS k, max(ord) AS o FROM g WHERE tag IS NOT NULL GROUP BY tag), bs AS (SELECT span AS k, max(ord) AS o FROM g GROUP BY span),
        l AS (SELECT a.*, coalesce(bi.o, bt.o, bs.o) AS gene FROM v_ann a LEFT JOIN bi ON a.parent = bi.k LEFT JOIN bt ON a.tag = bt.k LEFT JOIN bs ON a.span = bs.k),
        r AS (SELECT l.*, x.tag AS gt, x.name AS gn, x.product AS gp FROM l LEFT JOIN v_ann x ON x.ord = l.gene WHERE l.ord NOT IN (SELECT gene FROM l WHERE type <> 'gene' AND type <> 'region' AND gene IS NOT NULL)),
        n AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY ord) AS k, coalesce(product, gp, 'gene ' || name, '') AS full_product FROM r)
        SELECT ord, contig, CASE WHEN is_pseudo THEN 'pseudogene' WHEN type = 'gene' AND full_product <> '' THEN 'CDS' ELSE type END AS display_type, coalesce(tag, gt, name, gn, id, 'feat_' || k) AS locus_tag, full_product FROM n""",
        FEATURES, ANNOTATED,
    ),
    "lane_packing": f"""WITH RECURSIVE {FEATURES},
        o AS (SELECT contig, strand, feature_id, start, "end" AS stop, row_number() OVER (PARTITION BY contig, strand ORDER BY start, feature_id) AS k FROM v_features),
        r AS (SELECT contig, strand, k, feature_id, 0::BIGINT AS lane, [stop] AS ends FROM o WHERE k = 1 UNION ALL
            SELECT contig, strand, k, feature_id, lane, list_concat(list_concat(ends[1:lane], [stop]), ends[lane + 2:]) FROM (
                SELECT o.*, r.ends, coalesce(list_position(list_transform(r.ends, lambda e: o.start >= e), true), len(r.ends) + 1)::BIGINT - 1 AS lane FROM r JOIN o ON o.contig = r.contig AND o.strand = r.strand AND o.k = r.k + 1))
        SELECT contig, feature_id, strand, lane FROM r""",
    "locus_tags": with_views("SELECT feature_id, 'GE_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS locus_tag FROM (SELECT feature_id, row_number() OVER (ORDER BY contig, start, feature_id) AS n FROM v_features)", FEATURES),
}
