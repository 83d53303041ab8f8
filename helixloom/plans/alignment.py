"""Queries on alignments and distances, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions.sequence import quantized
from helixloom.operators import alignment as A
from helixloom.plans.inputs import ALIGNMENT, READS, alignment, reads, with_views
from helixloom.plans.qc import _mul


def column_stats(spark, sf_dir):
    return A.column_stats(alignment(spark, sf_dir))


def alignment_summary(spark, sf_dir):
    s = A.summary(A.column_stats(alignment(spark, sf_dir)))
    return s.withColumn("gap_fraction", quantized(F.col("gap_fraction")))


def variable_sites(spark, sf_dir):
    sites = A.variable_sites(A.column_stats(alignment(spark, sf_dir)))
    return sites.withColumn("alleles", F.array_join("alleles", " "))


def gap_stats(spark, sf_dir):
    return A.gap_stats(alignment(spark, sf_dir)).select("seq_idx", quantized(F.col("gap_share")).alias("gap_share"))


def column_inspector(spark, sf_dir):
    return A.column_inspector(alignment(spark, sf_dir), 101)


def pair_identity(spark, sf_dir):
    rows = A.pairs(alignment(spark, sf_dir))
    return rows.select("i", "j", quantized(F.when(F.col("comp") > 0, (F.col("comp") - F.col("diffs")) / F.col("comp")).otherwise(0.0)).alias("identity"))


def _distances(model, complete=False):
    def query(spark, sf_dir):
        rows = alignment(spark, sf_dir)
        found = A.distances(A.pairs(A.complete_columns(rows) if complete else rows), model)
        return found.withColumn("d", quantized(F.col("d"), 8))

    return query


def distance_summary(spark, sf_dir):
    s = A.distance_summary(A.distances(A.pairs(alignment(spark, sf_dir)), "jc"))
    return s.withColumns({c: quantized(F.col(c)) for c in ("mean", "ti_tv")})


def kmer_counts(spark, sf_dir):
    return A.kmer_totals(reads(spark, sf_dir), 6, "read_idx")


def kmer_distance(spark, sf_dir):
    seqs = A.rows_of(alignment(spark, sf_dir)).select("seq_idx", F.replace("row", F.lit("-"), F.lit("")).alias("seq"))
    return A.kmer_distances(A.kmers(seqs, 6)).withColumn("d", quantized(F.col("d"), 8))


def bootstrap_columns(spark, sf_dir):
    return A.bootstrap_columns(alignment(spark, sf_dir).select("col").distinct(), 10)


QUERIES = {
    f.__name__: f for f in (column_stats, alignment_summary, variable_sites, gap_stats, column_inspector, pair_identity, distance_summary, kmer_counts, kmer_distance, bootstrap_columns)
} | {"p_distance": _distances("p"), "jc_distance": _distances("jc"), "k2p_distance": _distances("k2p"), "complete_deletion": _distances("p", complete=True)}


def _q(x: str, digits: int = 6) -> str:
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


COLUMNS = """v_cnt AS (SELECT col, count(*) FILTER (base = 'A') AS n_A, count(*) FILTER (base = 'C') AS n_C, count(*) FILTER (base = 'G') AS n_G, count(*) FILTER (base = 'T') AS n_T, count(*) AS n FROM v_aln GROUP BY col),
    v_top AS (SELECT *, n_A + n_C + n_G + n_T AS known, greatest(n_A, n_C, n_G, n_T) AS top, (n_A > 0)::INT + (n_C > 0)::INT + (n_G > 0)::INT + (n_T > 0)::INT AS states,
              (n_A > 1)::INT + (n_C > 1)::INT + (n_G > 1)::INT + (n_T > 1)::INT AS strong FROM v_cnt),
    v_cols AS (SELECT col, n_A, n_C, n_G, n_T, n - known AS gaps, CASE WHEN top = 0 THEN '-' WHEN n_A = top THEN 'A' WHEN n_C = top THEN 'C' WHEN n_G = top THEN 'G' ELSE 'T' END AS plurality, top / n >= 0.5 AS firm,
              CASE WHEN known = 0 THEN 16 WHEN states = 1 AND known = n THEN 1 WHEN strong >= 2 THEN 6 ELSE 10 END::BIGINT AS class_bits FROM v_top)"""


def _pairs(source: str = "v_aln") -> str:
    return f"""v_pairs AS (SELECT x.seq_idx AS i, y.seq_idx AS j, count(*) AS comp, count(*) FILTER (x.base <> y.base) AS diffs,
        count(*) FILTER (x.base <> y.base AND (least(x.base, y.base) || greatest(x.base, y.base)) IN ('AG', 'CT')) AS ti,
        count(*) FILTER (x.base <> y.base AND (least(x.base, y.base) || greatest(x.base, y.base)) NOT IN ('AG', 'CT')) AS tv
        FROM {source} x JOIN {source} y ON x.col = y.col AND x.seq_idx < y.seq_idx WHERE x.base <> '-' AND y.base <> '-' GROUP BY ALL)"""


JC = "CASE WHEN diffs / comp >= 0.75 THEN 1.5 WHEN diffs > 0 THEN " + _q("(-0.75 * ln(1 - 4.0::DOUBLE * (diffs / comp) / 3))", 9) + " ELSE 0 END"
K2P = "CASE WHEN 1 - 2 * (ti / comp) - tv / comp <= 0 OR 1 - 2 * (tv / comp) <= 0 THEN 1.5 WHEN diffs > 0 THEN " + _q("(-0.5 * ln(1 - 2 * (ti / comp) - tv / comp) - 0.25 * ln(1 - 2 * (tv / comp)))", 9) + " ELSE 0 END"
SAT = {"p": "false", "jc": "diffs / comp >= 0.75", "k2p": "(1 - 2 * (ti / comp) - tv / comp <= 0 OR 1 - 2 * (tv / comp) <= 0)"}


def _distance(d: str, model: str, *views: str) -> str:
    return with_views(f"SELECT i, j, {_q('(' + d + ')', 8)} AS d, ti, tv, comp, {SAT[model]} AS saturated FROM v_pairs", ALIGNMENT, *views)


ORACLES = {
    "column_stats": with_views("SELECT col, n_A, n_C, n_G, n_T, gaps, CASE WHEN firm THEN plurality ELSE '-' END AS consensus, plurality, class_bits FROM v_cols", ALIGNMENT, COLUMNS),
    "alignment_summary": with_views(
        f"""SELECT count(*) AS columns, count(*) FILTER (class_bits & 1 > 0) AS conserved, count(*) FILTER (class_bits & 2 > 0) AS variable, count(*) FILTER (class_bits & 4 > 0) AS informative,
        count(*) FILTER (class_bits & 8 > 0) AS singleton, count(*) FILTER (class_bits & 16 > 0) AS gap_only, {_q("(sum(gaps) / sum(gaps + n_A + n_C + n_G + n_T))")} AS gap_fraction FROM v_cols""",
        ALIGNMENT, COLUMNS,
    ),
    "variable_sites": with_views(
        """SELECT col AS pos, plurality AS consensus, concat_ws(' ', CASE WHEN n_A > 0 THEN 'A:' || n_A END, CASE WHEN n_C > 0 THEN 'C:' || n_C END, CASE WHEN n_G > 0 THEN 'G:' || n_G END, CASE WHEN n_T > 0 THEN 'T:' || n_T END) AS alleles,
        class_bits & 4 > 0 AS informative, gaps > 0 AS indel FROM v_cols WHERE class_bits & 2 > 0""",
        ALIGNMENT, COLUMNS,
    ),
    "gap_stats": with_views(f"SELECT seq_idx, {_q('avg((base = chr(45))::INT)')} AS gap_share FROM v_aln GROUP BY seq_idx", ALIGNMENT),
    "column_inspector": with_views(
        """WITH h AS (SELECT * FROM v_aln WHERE col = 101), t AS (SELECT base AS majority FROM h GROUP BY base ORDER BY count(*) DESC, ascii(base) LIMIT 1),
        u AS (SELECT seq_idx, count(*) FILTER (base <> '-') AS ungapped_pos FROM v_aln WHERE col <= 101 GROUP BY seq_idx)
        SELECT seq_idx, base, base <> majority AS differs, ungapped_pos FROM h, t JOIN u USING (seq_idx)""".replace("FROM h, t JOIN u USING (seq_idx)", "FROM h JOIN u USING (seq_idx) CROSS JOIN t"),
        ALIGNMENT,
    ),
    "pair_identity": with_views(f"SELECT i, j, {_q('((comp - diffs) / comp)')} AS identity FROM v_pairs", ALIGNMENT, _pairs()),
    "p_distance": _distance("diffs / comp", "p", _pairs()),
    "jc_distance": _distance(JC, "jc", _pairs()),
    "k2p_distance": _distance(K2P, "k2p", _pairs()),
    "complete_deletion": _distance("diffs / comp", "p", "v_full AS (SELECT * FROM v_aln WHERE col NOT IN (SELECT col FROM v_aln WHERE base = '-'))", _pairs("v_full")),
    "distance_summary": with_views(
        f"""WITH d AS (SELECT *, {JC} AS d FROM v_pairs)
        SELECT {_q("avg(d)")} AS mean, first(i ORDER BY d, i, j) AS near_i, first(j ORDER BY d, i, j) AS near_j, first(i ORDER BY d DESC, i, j) AS far_i, first(j ORDER BY d DESC, i, j) AS far_j,
               {_q("(sum(ti) / sum(tv))")} AS ti_tv, count(*) FILTER (diffs / comp >= 0.75) AS saturated, count(*) FILTER (comp = 0) AS no_data FROM d""",
        ALIGNMENT, _pairs(),
    ),
    "kmer_counts": with_views(
        """WITH k AS (SELECT read_idx, substr(seq, i, 6) AS kmer FROM (SELECT read_idx, seq, unnest(range(1, length(seq) - 4)) AS i FROM v_reads)),
        c AS (SELECT read_idx, kmer, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY ALL) SELECT kmer, sum(n)::BIGINT AS n, count(*) AS reads FROM c GROUP BY kmer""",
        READS,
    ),
    "kmer_distance": with_views(
        f"""WITH s AS (SELECT seq_idx, replace(string_agg(base, '' ORDER BY col), '-', '') AS seq FROM v_aln GROUP BY seq_idx),
        k AS (SELECT seq_idx, substr(seq, i, 6) AS kmer, count(*) AS n FROM (SELECT seq_idx, seq, unnest(range(1, length(seq) - 4)) AS i FROM s) GROUP BY ALL),
        t AS (SELECT seq_idx, sum(n) AS total FROM k GROUP BY seq_idx),
        p AS (SELECT x.seq_idx AS i, y.seq_idx AS j, sum(least(x.n, y.n)) AS inter FROM k x JOIN k y ON x.kmer = y.kmer AND x.seq_idx < y.seq_idx GROUP BY ALL),
        j AS (SELECT a.seq_idx AS i, b.seq_idx AS j, 1 - coalesce(inter, 0) / (a.total + b.total - coalesce(inter, 0)) AS p FROM t a JOIN t b ON a.seq_idx < b.seq_idx LEFT JOIN p ON p.i = a.seq_idx AND p.j = b.seq_idx)
        SELECT i, j, {_q("(CASE WHEN p <= 0 THEN 0 WHEN p >= 0.75 THEN 3 ELSE " + _q("(-0.75 * ln(1 - 4 * p / 3))", 9) + " END)", 8)} AS d FROM j""",
        ALIGNMENT,
    ),
    "bootstrap_columns": with_views(
        """WITH c AS (SELECT col, row_number() OVER (ORDER BY col) - 1 AS k FROM (SELECT DISTINCT col FROM v_aln)), n AS (SELECT count(*) AS n FROM c),
        r AS (SELECT unnest(range(0, 10 * n)) AS id, n FROM n), a AS (SELECT id, n, (42 + (id + 1) * 1831565813) % 4294967296 AS a FROM r),
        b AS (SELECT id, n, MUL1 AS t FROM a), d AS (SELECT id, n, xor((t + MUL2) % 4294967296, t) AS t FROM b),
        e AS (SELECT id // n AS rep, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * n)::BIGINT AS k FROM d)
        SELECT rep, col, count(*) AS w FROM e JOIN c USING (k) GROUP BY rep, col""",
        ALIGNMENT,
    ),
}
ORACLES["bootstrap_columns"] = ORACLES["bootstrap_columns"].replace("MUL1", _mul("xor(a, a >> 15)", "a | 1")).replace("MUL2", _mul("xor(t, t >> 7)", "t | 61"))
