"""Queries on read quality, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions.sequence import AMINO_ACIDS, CODE_ORDER, canonical_hash, encoded, formatted_bases, fnv1a, mulberry32, quantized, reverse_complement, translated
from helixloom.operators import qc
from helixloom.plans.inputs import READS, reads, with_views


def _metrics(spark, sf_dir):
    return qc.read_metrics(reads(spark, sf_dir))


def _rounded(df, *columns):
    return df.select(*[quantized(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _longs(df, *columns):
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])


def read_metrics(spark, sf_dir):
    return _rounded(_longs(_metrics(spark, sf_dir).drop("err"), "length"), "mean_q", "gc")


def qc_summary(spark, sf_dir):
    return _rounded(qc.summary(reads(spark, sf_dir)), "mean_length", "mean_q", "gc")


def n50_n90(spark, sf_dir):
    return qc.n_statistics(_metrics(spark, sf_dir), {"n50": 0.5, "n90": 0.9})


def length_histogram(spark, sf_dir):
    return _longs(qc.length_histogram(_metrics(spark, sf_dir)), "bin", "range_start", "range_end", "count")


def quality_histogram(spark, sf_dir):
    return _longs(qc.quality_histogram(_metrics(spark, sf_dir)), "bin", "range_start", "range_end", "count")


def gc_histogram(spark, sf_dir):
    return _longs(qc.gc_histogram(_metrics(spark, sf_dir)), "bin", "range_start", "range_end", "count")


def yield_by_length(spark, sf_dir):
    return _longs(qc.yield_by_length(_metrics(spark, sf_dir)), "reads", "length", "cumulative_bases")


def positional_quality(spark, sf_dir):
    return _rounded(_longs(qc.positional_quality(reads(spark, sf_dir)), "pos", "reads"), "mean_q")


def positional_quality_all(spark, sf_dir):
    return _rounded(_longs(qc.positional_quality(reads(spark, sf_dir), first_reads=None, positions=None), "pos", "reads"), "mean_q")


def base_composition(spark, sf_dir):
    return qc.base_composition(reads(spark, sf_dir))


def read_filter_pass(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    ok = qc.passes(min_q=18.5, min_length=500, max_length=5000)
    return m.agg(F.count(F.lit(1)).alias("reads"), F.count_if(ok).alias("passing"), F.sum(F.when(ok, F.col("length"))).alias("passing_bases"), quantized(F.avg(ok.cast("int")) * 100).alias("pass_percent"))


def qc_verdict(spark, sf_dir):
    return _rounded(qc.verdicts(qc.summary(reads(spark, sf_dir))), "value")


def assembly_read_selection(spark, sf_dir):
    return _rounded(_longs(qc.assembly_selection(_metrics(spark, sf_dir)).select("read_idx", "length", "mean_q"), "length"), "mean_q")


def scatter_sample(spark, sf_dir):
    return _rounded(_longs(qc.scatter_sample(_metrics(spark, sf_dir), points=300).select("read_idx", "length", "mean_q"), "length"), "mean_q")


def read_search(spark, sf_dir):
    return reads(spark, sf_dir).where(F.contains(F.lower("id"), F.lower(F.lit("READ_1")))).select("read_idx", "id")


def revcomp(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", F.md5(reverse_complement(F.col("seq"))).alias("rc_md5"), F.md5(encoded(reverse_complement(F.col("seq")))).alias("encoded_md5"))


def translate_frames(spark, sf_dir):
    frames = reads(spark, sf_dir).select("read_idx", "seq", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("frame"))
    protein = translated(F.substring("seq", F.col("frame") + 1, F.length("seq")))
    return frames.select("read_idx", F.col("frame").cast("long").alias("frame"), F.length(protein).cast("long").alias("aa"), F.md5(protein).alias("protein_md5"))


def fnv_kmer_hash(spark, sf_dir):
    kmer = reads(spark, sf_dir).where(F.length("seq") >= 10).select("read_idx", F.substring("seq", 1, 10).alias("kmer"))
    best = canonical_hash(F.col("kmer"))
    return kmer.select("read_idx", "kmer", fnv1a(F.col("kmer")).alias("fnv"), best["hash"].alias("canonical"), best["strand"].cast("long").alias("strand"))


def fnv_kmer_hashes(spark, sf_dir):
    """Every k-mer of each read; fnv_kmer_hash is held to its SQL, which hashes the first."""
    return qc.kmer_hash_totals(reads(spark, sf_dir), 10)


def mulberry_draws(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", quantized(mulberry32(42, F.col("read_idx")), 9).alias("draw"))


def format_bases(spark, sf_dir):
    return reads(spark, sf_dir).select("read_idx", formatted_bases(F.length("seq")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        read_metrics, qc_summary, n50_n90, length_histogram, quality_histogram, gc_histogram, yield_by_length, positional_quality, positional_quality_all, base_composition, read_filter_pass,
        qc_verdict, assembly_read_selection, scatter_sample, read_search, revcomp, translate_frames, fnv_kmer_hash, fnv_kmer_hashes, mulberry_draws, format_bases,
    )
}


def _count(letters: str) -> str:
    return f"(length(seq) - length(translate(seq, '{letters}', '')))"


METRICS = f"""v_metrics AS (
    SELECT read_idx, id, length(seq) AS length, err, CASE WHEN length(seq) > 0 THEN -10 * log10(greatest(err / length(seq), 1e-12)) ELSE 120.0 END AS mean_q,
           CASE WHEN acgt > 0 THEN gc * 100.0::DOUBLE / acgt ELSE 0 END AS gc
    FROM (SELECT *, {_count("GC")} AS gc, {_count("ACGT")} AS acgt,
                 coalesce(list_sum(list_transform(string_split(CASE WHEN qual = '' THEN NULL ELSE qual END, ''), lambda c: pow(10.0::DOUBLE, -(ascii(c) - 33) / 10.0::DOUBLE))), 0) AS err FROM v_reads))"""
SUMMARY = f"""v_summary AS (
    SELECT *, coalesce((n_G + n_C) * 100.0::DOUBLE / nullif(n_A + n_C + n_G + n_T, 0), 0) AS gc FROM
    (SELECT count(*) AS reads, sum(length)::BIGINT AS bases, min(length) AS min_length, max(length) AS max_length, avg(length) AS mean_length, median(length) AS median_length,
            -10 * log10(greatest(sum(err) / sum(length), 1e-12)) AS mean_q FROM v_metrics),
    (SELECT sum({_count("A")})::BIGINT AS n_A, sum({_count("C")})::BIGINT AS n_C, sum({_count("G")})::BIGINT AS n_G, sum({_count("T")})::BIGINT AS n_T,
            sum(length(seq) - {_count("ACGT")})::BIGINT AS n_N FROM v_reads),
    (SELECT max(length) FILTER (upto >= 0.5 * total) AS n50, max(length) FILTER (upto >= 0.9 * total) AS n90
     FROM (SELECT length, sum(length) OVER (ORDER BY length DESC) AS upto, sum(length) OVER () AS total FROM v_metrics)))"""


def _q(x: str, digits: int = 6) -> str:
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


def _histogram(value: str, edges: str) -> str:
    return with_views(
        f"""WITH e AS (SELECT {edges} AS edges FROM v_metrics),
        bins AS (SELECT i AS bin, edges[i] AS range_start, edges[i + 1] AS range_end FROM (SELECT edges, unnest(range(1, len(edges))) AS i FROM e)),
        hit AS (SELECT greatest(1, least(len(edges) - 1, len(list_filter(edges, lambda x: x <= {value})))) AS bin FROM v_metrics, e)
        SELECT bin::BIGINT AS bin, range_start::BIGINT AS range_start, range_end::BIGINT AS range_end, count(hit.bin) AS count
        FROM bins LEFT JOIN hit USING (bin) GROUP BY ALL""",
        READS,
        METRICS,
    )


CODE = "map {" + ", ".join(f"'{a + b + c}': '{AMINO_ACIDS[16 * i + 4 * j + k]}'" for i, a in enumerate(CODE_ORDER) for j, b in enumerate(CODE_ORDER) for k, c in enumerate(CODE_ORDER)) + "}"
RC = "reverse(translate(regexp_replace({0}, '[^ACGTacgtNn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca'))"
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


def _mul(a: str, b: str) -> str:
    return f"((({a}) * (({b}) & 65535) + (({a}) * (({b}) >> 16)) % 4294967296 * 65536 % 4294967296) % 4294967296)"


ORACLES = {
    "read_metrics": with_views(f"SELECT read_idx, id, length, {_q('mean_q')} AS mean_q, {_q('gc')} AS gc FROM v_metrics", READS, METRICS),
    "qc_summary": with_views(
        f"SELECT reads, bases, min_length, max_length, {_q('mean_length')} AS mean_length, median_length, {_q('mean_q')} AS mean_q, n_A, n_C, n_G, n_T, n_N, {_q('gc')} AS gc, n50, n90 FROM v_summary", READS, METRICS, SUMMARY
    ),
    "n50_n90": with_views("SELECT n50, n90 FROM v_summary", READS, METRICS, SUMMARY),
    "length_histogram": _histogram(
        "length",
        "list_append(list_filter([0, 200, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 30000, 50000], lambda x: x <= greatest(max(length), 200)), "
        "CASE WHEN max(length) > list_max(list_filter([0, 200, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 30000, 50000], lambda x: x <= greatest(max(length), 200))) THEN (ceil(max(length) / 1000.0) * 1000 + 1)::INT "
        "ELSE list_max(list_filter([0, 200, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 30000, 50000], lambda x: x <= greatest(max(length), 200))) + 1 END)",
    ),
    "quality_histogram": _histogram("mean_q", "range(0, (floor(greatest(max(mean_q), 30.0) / 2)::INT + 1) * 2 + 1, 2)"),
    "gc_histogram": _histogram("gc", "list_append(range(0, 100, 5), 101 + 0 * count(*))"),
    "yield_by_length": with_views(
        """WITH o AS (SELECT length, row_number() OVER w AS reads, sum(length) OVER w AS cumulative_bases, count(*) OVER () AS n FROM v_metrics WINDOW w AS (ORDER BY length DESC, read_idx))
        SELECT reads, length, cumulative_bases::BIGINT AS cumulative_bases FROM o WHERE (reads - 1) % greatest(1, n // 400) = 0 OR reads = n""",
        READS, METRICS,
    ),
    "positional_quality": with_views(
        f"""WITH c AS (SELECT unnest(range(least(length(qual), 3000))) AS pos, unnest(string_split(substr(qual, 1, 3000), '')) AS ch FROM (SELECT * FROM v_reads ORDER BY read_idx LIMIT 5000) WHERE qual <> ''),
        b AS (SELECT pos, -10 * log10(greatest(avg(pow(10.0::DOUBLE, -(ascii(ch) - 33) / 10.0::DOUBLE)), 1e-12)) AS mean_q, count(*) AS reads FROM c GROUP BY pos HAVING count(*) >= 20),
        k AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS n FROM b)
        SELECT pos::BIGINT AS pos, {_q("mean_q")} AS mean_q, reads FROM k WHERE k % greatest(1, n // 300) = 0""",
        READS,
    ),
    "positional_quality_all": with_views(
        f"""WITH c AS (SELECT unnest(range(length(qual))) AS pos, unnest(string_split(qual, '')) AS ch FROM v_reads WHERE qual <> ''),
        b AS (SELECT pos, -10 * log10(greatest(avg(pow(10.0::DOUBLE, -(ascii(ch) - 33) / 10.0::DOUBLE)), 1e-12)) AS mean_q, count(*) AS reads FROM c GROUP BY pos HAVING count(*) >= 20),
        k AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS n FROM b)
        SELECT pos::BIGINT AS pos, {_q("mean_q")} AS mean_q, reads FROM k WHERE k % greatest(1, n // 300) = 0""",
        READS,
    ),
    "base_composition": with_views("SELECT n_A, n_C, n_G, n_T, n_N FROM v_summary", READS, METRICS, SUMMARY),
    "read_filter_pass": with_views(
        f"""WITH p AS (SELECT length, mean_q::FLOAT >= 18.5::FLOAT AND length >= 500 AND length <= 5000 AS ok FROM v_metrics)
        SELECT count(*) AS reads, count(*) FILTER (ok) AS passing, sum(length) FILTER (ok)::BIGINT AS passing_bases, {_q("avg(ok::INT) * 100")} AS pass_percent FROM p""",
        READS, METRICS,
    ),
    "qc_verdict": with_views(
        f"""WITH r AS (
            SELECT 'n50' AS "check", n50::DOUBLE AS value, CASE WHEN n50 >= 3000 THEN 'good' WHEN n50 >= 1000 THEN 'warn' ELSE 'bad' END AS verdict FROM v_summary
            UNION ALL SELECT 'mean_quality', mean_q, CASE WHEN mean_q >= 15 THEN 'good' WHEN mean_q >= 10 THEN 'warn' ELSE 'bad' END FROM v_summary
            UNION ALL SELECT 'yield', bases, CASE WHEN bases >= 3e8 THEN 'good' WHEN bases >= 5e7 THEN 'warn' ELSE 'bad' END FROM v_summary
            UNION ALL SELECT 'gc', gc, CASE WHEN abs(gc - 50) < 15 THEN 'good' WHEN abs(gc - 50) < 25 THEN 'warn' ELSE 'bad' END FROM v_summary
            UNION ALL SELECT 'n_content', n_N * 100.0::DOUBLE / bases, CASE WHEN n_N * 100.0::DOUBLE / bases < 0.5 THEN 'good' WHEN n_N * 100.0::DOUBLE / bases < 2 THEN 'warn' ELSE 'bad' END FROM v_summary WHERE n_N > 0)
        SELECT "check", {_q("value")} AS value, verdict FROM r""",
        READS, METRICS, SUMMARY,
    ),
    "assembly_read_selection": with_views(f"SELECT read_idx, length, {_q('mean_q')} AS mean_q FROM v_metrics WHERE mean_q::FLOAT >= 9::FLOAT AND length >= 1000 ORDER BY length DESC, read_idx LIMIT 150", READS, METRICS),
    "scatter_sample": with_views(f"SELECT read_idx, length, {_q('mean_q')} AS mean_q FROM v_metrics WHERE read_idx % (SELECT greatest(1, count(*) // 300) FROM v_metrics) = 0", READS, METRICS),
    "read_search": with_views("SELECT read_idx, id FROM v_reads WHERE contains(lower(id), 'read_1')", READS),
    "revcomp": with_views(f"SELECT read_idx, md5({RC.format('seq')}) AS rc_md5, md5(regexp_replace({RC.format('seq')}, '[^ACGT]', '-', 'g')) AS encoded_md5 FROM v_reads", READS),
    "translate_frames": with_views(
        f"""WITH f AS (SELECT read_idx, frame, substr(seq, frame + 1) AS s FROM v_reads, (VALUES (0), (1), (2)) t(frame)),
        p AS (SELECT read_idx, frame, regexp_replace(coalesce(list_aggregate(list_transform(range(length(s) // 3), lambda i: coalesce({CODE}[substr(s, i * 3 + 1, 3)], 'X')), 'string_agg', ''), ''), '\\*$', '') AS protein FROM f)
        SELECT read_idx, frame::BIGINT AS frame, length(protein) AS aa, md5(protein) AS protein_md5 FROM p""",
        READS,
    ),
    "fnv_kmer_hash": with_views(
        f"""WITH k AS (SELECT read_idx, substr(seq, 1, 10) AS kmer FROM v_reads WHERE length(seq) >= 10),
        h AS (SELECT *, {FNV.format("kmer")} AS f, {FNV.format(RC.format("kmer"))} AS r FROM k)
        SELECT read_idx, kmer, f AS fnv, least(f, r) AS canonical, CASE WHEN f <= r THEN 1 ELSE -1 END::BIGINT AS strand FROM h""",
        READS,
    ),
    "fnv_kmer_hashes": with_views(
        f"""WITH k AS (SELECT read_idx, substr(seq, unnest(range(1, length(seq) - 8)), 10) AS kmer FROM v_reads WHERE length(seq) >= 10),
        d AS (SELECT DISTINCT kmer FROM k),
        h AS (SELECT kmer, {FNV.format("kmer")} AS f, {FNV.format(RC.format("kmer"))} AS r FROM d),
        t AS (SELECT read_idx, count(*) AS kmers, bit_xor(f) AS fnv_xor, min(least(f, r)) AS canonical_min, sum(least(f, r))::BIGINT AS canonical_sum, count(*) FILTER (f <= r) AS forward FROM k JOIN h USING (kmer) GROUP BY read_idx)
        SELECT read_idx, coalesce(kmers, 0) AS kmers, coalesce(fnv_xor, 0) AS fnv_xor, canonical_min, coalesce(canonical_sum, 0) AS canonical_sum, coalesce(forward, 0) AS forward FROM v_reads LEFT JOIN t USING (read_idx)""",
        READS,
    ),
    "mulberry_draws": with_views(
        f"""WITH a AS (SELECT read_idx, (42 + (read_idx + 1) * 1831565813) % 4294967296 AS a FROM v_reads),
        b AS (SELECT read_idx, {_mul("xor(a, a >> 15)", "a | 1")} AS t FROM a),
        c AS (SELECT read_idx, xor((t + {_mul("xor(t, t >> 7)", "t | 61")}) % 4294967296, t) AS t FROM b)
        SELECT read_idx, {_q("xor(t, t >> 14) / 4294967296.0::DOUBLE", 9)} AS draw FROM c""",
        READS,
    ),
    "format_bases": with_views(
        """SELECT read_idx, CASE WHEN length(seq) >= 1000000 THEN ((length(seq) + 5000) // 1000000) || '.' || lpad(((length(seq) + 5000) // 10000 % 100)::VARCHAR, 2, '0') || ' Mb'
        WHEN length(seq) >= 1000 THEN ((length(seq) + 50) // 1000) || '.' || ((length(seq) + 50) // 100 % 10) || ' kb' ELSE length(seq) || ' bp' END AS label FROM v_reads""",
        READS,
    ),
}
