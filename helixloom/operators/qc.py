"""Read quality control: per-read metrics, dataset summary, histograms, filters and verdicts.

Tables: reads (read_idx, id, seq, qual); metrics (read_idx, id, length, mean_q, gc, err).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions import sequence as S

#: The inner edges of the read-length histogram.
LENGTH_EDGES = [0, 200, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 30000, 50000]


def read_metrics(reads: DataFrame) -> DataFrame:
    """Length, mean quality, GC and summed error of each read; nothing is shuffled."""
    return reads.select(
        "read_idx", "id", F.length("seq").alias("length"), S.mean_quality(F.col("qual")).alias("mean_q"), S.gc_percent(F.col("seq")).alias("gc"), S.error_sum(F.col("qual")).alias("err")
    )


def base_composition(reads: DataFrame) -> DataFrame:
    """One row: bases by letter in either case; all others count as N."""
    counts = {b: F.sum(S.count_of(F.col("seq"), b + b.lower())) for b in "ACGT"}
    rest = F.sum(F.length("seq")) - sum(counts.values())
    zero = F.lit(0).cast("long")
    return reads.agg(*[F.coalesce(c, zero).alias(f"n_{b}") for b, c in counts.items()], F.coalesce(rest, zero).alias("n_N"))


def n_statistics(lengths: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """For each name, the length at which the longest reads reach that fraction of all bases (0 if there are none).

    Lengths are counted first, so the running sum is over distinct lengths only.
    """
    counted = lengths.groupBy("length").agg((F.count(F.lit(1)) * F.col("length")).alias("bases"))
    running = counted.select("length", F.sum("bases").over(Window.orderBy(F.desc("length"))).alias("upto"), F.sum("bases").over(Window.partitionBy()).alias("total"))
    return running.agg(*[F.coalesce(F.max(F.when(F.col("upto") >= F.col("total") * f, F.col("length"))), F.lit(0)).cast("long").alias(name) for name, f in fractions.items()])


def summary(reads: DataFrame) -> DataFrame:
    """One row: reads, bases, lengths, quality, composition and N-statistics."""
    m = read_metrics(reads)
    totals = m.agg(
        F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"), F.min("length").cast("long").alias("min_length"), F.max("length").cast("long").alias("max_length"),
        F.avg("length").alias("mean_length"), F.median("length").alias("median_length"), S.quality_of(F.sum("err") / F.sum("length")).alias("mean_q"),
    )
    composition = base_composition(reads)
    gc = F.col("n_G") + F.col("n_C")
    with_gc = composition.withColumn("gc", F.coalesce(F.try_divide(gc * 100.0, gc + F.col("n_A") + F.col("n_T")), F.lit(0.0)))
    return totals.crossJoin(with_gc).crossJoin(n_statistics(m, {"n50": 0.5, "n90": 0.9}))  # one row each


def _binned(values: DataFrame, value: str, edges: DataFrame) -> DataFrame:
    """Counts in the bins of ``edges`` (one row, array ``edges``), values outside being in the first or last bin; empty bins stay."""
    last = F.size("edges") - 1
    bins = edges.select(F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(i.alias("bin"), F.element_at("edges", i).alias("range_start"), F.element_at("edges", i + 1).alias("range_end")))).alias("b")).select("b.*")
    at = F.greatest(F.lit(1), F.least(last, F.size(F.filter("edges", lambda e: e <= F.col(value)))))
    counts = values.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return bins.join(counts, "bin", "left").select("bin", "range_start", "range_end", F.coalesce("count", F.lit(0)).alias("count"))


def length_histogram(metrics: DataFrame) -> DataFrame:
    """Fixed edges up to the longest read (at least 200), and one beyond it: the next full thousand, or just past the last."""
    longest = metrics.agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest"))
    inner = longest.select("longest", F.filter(F.array(*[F.lit(e) for e in LENGTH_EDGES]), lambda e: e <= F.greatest("longest", F.lit(200))).alias("inner"))
    last = F.element_at("inner", -1)
    tail = F.when(F.col("longest") > last, (F.ceil(F.col("longest") / 1000) * 1000 + 1).cast("int")).otherwise(last + 1)
    return _binned(metrics, "length", inner.select(F.array_append("inner", tail).alias("edges")))


def quality_histogram(metrics: DataFrame, step: int = 2, least_top: int = 30) -> DataFrame:
    """Even edges up to the best read (at least 30), and one beyond them."""
    top = metrics.agg(F.floor(F.greatest(F.coalesce(F.max("mean_q"), F.lit(0.0)), F.lit(float(least_top))) / step).cast("int").alias("top"))
    return _binned(metrics, "mean_q", top.select(F.sequence(F.lit(0), (F.col("top") + 1) * step, F.lit(step)).alias("edges")))


def gc_histogram(metrics: DataFrame, step: int = 5) -> DataFrame:
    edges = [*range(0, 100, step), 101]
    return _binned(metrics, "gc", metrics.sparkSession.range(1).select(F.array(*[F.lit(e) for e in edges]).alias("edges")))


def n50_point(metrics: DataFrame) -> DataFrame:
    """n50, n50_cumulative_bases: the bases of the reads up to and with the first that is no longer than N50, longest first."""
    at = n_statistics(metrics, {"n50": 0.5})
    met = metrics.select("length").crossJoin(F.broadcast(at))  # one row
    longer, first = F.sum(F.when(F.col("length") > F.col("n50"), F.col("length"))), F.max(F.when(F.col("length") <= F.col("n50"), F.col("length")))
    return met.agg(F.max("n50").cast("long").alias("n50"), (F.coalesce(longer, F.lit(0)) + F.coalesce(first, F.lit(0))).cast("long").alias("n50_cumulative_bases"))


def yield_by_length(metrics: DataFrame, points: int = 400) -> DataFrame:
    """Bases in the reads at least as long as each sampled read, longest first, ties by read.

    Places and sums before each length come from the counted lengths; only within one
    length are reads numbered, so no window holds all reads.
    """
    counted = metrics.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("n_before"), F.coalesce(F.sum(F.col("n") * F.col("length")).over(longer), F.lit(0)).alias("bases_before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = F.row_number().over(Window.partitionBy("length").orderBy("read_idx"))
    placed = metrics.select("read_idx", "length", within.alias("k")).join(before, "length")
    rank = F.col("n_before") + F.col("k")
    stride = F.greatest(F.lit(1), F.floor(F.col("total") / points))
    sampled = placed.where(((rank - 1) % stride == 0) | (rank == F.col("total")))
    return sampled.select(rank.alias("reads"), F.col("length").cast("long").alias("length"), (F.col("bases_before") + F.col("k") * F.col("length")).alias("cumulative_bases"))


def positional_quality(reads: DataFrame, first_reads: int | None = 5000, positions: int | None = 3000, least_reads: int = 20, points: int = 300) -> DataFrame:
    """Quality of the mean error at each position, strided to about ``points`` rows; of the first reads and positions, or of all where those are None."""
    chosen = reads if first_reads is None else reads.orderBy("read_idx").limit(first_reads)
    qual = F.col("qual") if positions is None else F.substring("qual", 1, positions)
    chars = chosen.select(F.posexplode(F.split(qual, "")).alias("pos", "c")).where("c <> ''")
    by = chars.groupBy("pos").agg(S.quality_of(F.avg(S.error_probability(S.phred(F.col("c"))))).alias("mean_q"), F.count(F.lit(1)).alias("reads")).where(F.col("reads") >= least_reads)
    numbered = by.select("pos", "mean_q", "reads", (F.row_number().over(Window.orderBy("pos")) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))  # a row for each position
    return numbered.where(F.col("k") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0).select("pos", "mean_q", "reads")


def passes(min_q: float = 9, min_length: int = 0, max_length: int = 0) -> Column:
    """The read filter, on mean quality in single precision; a maximum of 0 is none."""
    ok = (F.col("mean_q").cast("float") >= F.lit(min_q).cast("float")) & (F.col("length") >= min_length)
    return ok & (F.col("length") <= max_length) if max_length else ok


def assembly_selection(metrics: DataFrame, min_length: int = 1000, min_q: float = 9, most: int = 150) -> DataFrame:
    """The longest reads that pass, ties by read: a top-k."""
    return metrics.where(passes(min_q, min_length)).orderBy(F.desc("length"), "read_idx").limit(most)


def verdicts(summary_row: DataFrame) -> DataFrame:
    """Rows (check, value, verdict) for the rules on N50, quality, yield, GC and N."""

    def graded(value: Column, good: Column, fair: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), F.when(good, "good").when(fair, "warn").otherwise("bad").alias("verdict"))

    n50, q, bases, gc = F.col("n50"), F.col("mean_q"), F.col("bases"), F.col("gc")
    off, n_share = F.abs(gc - 50), F.coalesce(F.try_divide(F.col("n_N") * 100.0, bases), F.lit(0.0))
    rules = {
        "n50": graded(n50, n50 >= 3000, n50 >= 1000),
        "mean_quality": graded(q, q >= 15, q >= 10),
        "yield": graded(bases, bases >= 300_000_000, bases >= 50_000_000),
        "gc": graded(gc, off < 15, off < 25),
        "n_content": F.when(F.col("n_N") > 0, graded(n_share, n_share < 0.5, n_share < 2)),
    }
    rows = F.array_compact(F.array(*[F.when(rule.isNotNull(), F.struct(F.lit(name).alias("check"), rule.alias("r"))) for name, rule in rules.items()]))
    return summary_row.select(F.explode(rows).alias("x")).select("x.check", "x.r.value", "x.r.verdict")


def scatter_sample(metrics: DataFrame, points: int = 3000) -> DataFrame:
    """Every n-th read by index, about ``points`` of them: the sampling operator of the scatter plot."""
    step = metrics.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / points)).alias("step"))
    return metrics.crossJoin(F.broadcast(step)).where(F.col("read_idx") % F.col("step") == 0).drop("step")


def kmer_hash_totals(reads: DataFrame, k: int) -> DataFrame:
    """Over all k-mers of each read: how many, exclusive-or of the FNV hashes, least and sum of the canonical ones, and how many are forward.

    The sequences are ASCII. A read shorter than k has none: 0, and null for the least.
    """
    other = np.frombuffer(bytes(range(256)), np.uint8).copy()
    other[:] = ord("N")
    for base, complement in zip(S.BASES + "n", S.COMPLEMENTS + "n"):
        other[ord(base)] = ord(complement)

    def totals(seq: str) -> tuple:
        raw = np.frombuffer(seq.encode("ascii"), np.uint8)
        n = len(raw) - k + 1
        if n <= 0:
            return 0, 0, None, 0, 0
        forward = np.full(n, S.FNV_OFFSET, np.uint32)
        backward, paired = forward.copy(), other[raw]
        for j in range(k):  # products in 32 bits wrap
            forward = (forward ^ raw[j : j + n]) * np.uint32(S.FNV_PRIME)
            backward = (backward ^ paired[k - 1 - j : k - 1 - j + n]) * np.uint32(S.FNV_PRIME)
        least = np.minimum(forward, backward)
        return n, int(np.bitwise_xor.reduce(forward)), int(least.min()), int(least.sum(dtype=np.int64)), int((forward <= backward).sum())

    def batches(parts):
        for part in parts:
            rows = [totals(seq) for seq in part.column("seq").to_pylist()]
            columns = [part.column("read_idx"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))]
            yield pa.RecordBatch.from_arrays(columns, names=["read_idx", "kmers", "fnv_xor", "canonical_min", "canonical_sum", "forward"])

    return reads.select(F.col("read_idx").cast("long").alias("read_idx"), "seq").mapInArrow(batches, "read_idx long, kmers long, fnv_xor long, canonical_min long, canonical_sum long, forward long")


def phred_totals(reads: DataFrame) -> DataFrame:
    """Over all quality characters of each read with any: how many, least, greatest and summed quality, summed error and the qualities summed back from the errors."""
    chars = F.filter(F.split("qual", ""), lambda c: c != "")
    q = reads.where(F.length("qual") > 0).select("read_idx", F.transform(chars, S.phred).alias("q"))
    p = q.select("read_idx", "q", F.transform("q", S.error_probability).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda t, x: t + x)
    back = F.aggregate("p", F.lit(0.0), lambda t, x: t + S.quality_of(x))
    sum_q = F.aggregate("q", F.lit(0).cast("long"), lambda t, x: t + x)
    return p.select("read_idx", F.size("q").cast("long").alias("n"), F.array_min("q").cast("long").alias("min_q"), F.array_max("q").cast("long").alias("max_q"), sum_q.alias("sum_q"), S.quantized(total).alias("sum_p"), S.quantized(back).alias("sum_back"))
