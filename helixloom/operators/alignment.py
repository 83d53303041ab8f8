"""Alignment statistics and pair distances in relational form.

Table: alignment (seq_idx, col, base); any base other than A, C, G and T is a gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions.sequence import mulberry32, quantized
from helixloom.operators.tables import repeated

SATURATED = 1.5
COLUMNS = 1 << 14  # values of a range in which columns are numbered
MIN_VALUE = 5e-324
ADDED, WRITTEN = 1 << 20, 1 << 16  # k-mers that a task adds up before it writes, and those of a batch that it writes
LETTER = np.full(256, 4, np.uint8)
LETTER[[ord(c) for c in "ACGT"]] = range(4)


def column_stats(alignment: DataFrame) -> DataFrame:
    """col, n_A, n_C, n_G, n_T, gaps, consensus, plurality, class_bits (1 conserved, 2 variable, 4 informative, 8 singleton, 16 gaps only)."""
    counts = alignment.groupBy("col").agg(*[F.count_if(F.col("base") == b).alias(f"n_{b}") for b in "ACGT"], F.count(F.lit(1)).alias("n"))
    each = [F.col(f"n_{b}") for b in "ACGT"]
    known, top = sum(each[1:], each[0]), F.greatest(*each)
    best = F.coalesce(*[F.when((c == top) & (top > 0), b) for c, b in zip(each, "ACGT", strict=True)], F.lit("-"))
    states, strong = (sum((F.when(c >= k, 1).otherwise(0) for c in each[1:]), F.when(each[0] >= k, 1).otherwise(0)) for k in (1, 2))
    conserved = (states == 1) & (known == F.col("n"))
    bits = F.when(known == 0, 16).when(conserved, 1).when(strong >= 2, 6).otherwise(10)
    return counts.select("col", *[f"n_{b}" for b in "ACGT"], (F.col("n") - known).alias("gaps"), F.when(top / F.col("n") >= 0.5, best).otherwise("-").alias("consensus"), best.alias("plurality"), bits.cast("long").alias("class_bits"))


def summary(stats: DataFrame) -> DataFrame:
    n = F.col("gaps") + F.col("n_A") + F.col("n_C") + F.col("n_G") + F.col("n_T")
    flags = {"conserved": 1, "variable": 2, "informative": 4, "singleton": 8, "gap_only": 16}
    return stats.agg(F.count(F.lit(1)).alias("columns"), *[F.count_if(F.col("class_bits").bitwiseAND(b) > 0).alias(k) for k, b in flags.items()], (F.sum("gaps") / F.sum(n)).alias("gap_fraction"))


def variable_sites(stats: DataFrame) -> DataFrame:
    """pos, consensus (plurality), alleles ("A:3"), informative, indel."""
    alleles = F.array_compact(F.array(*[F.when(F.col(f"n_{b}") > 0, F.concat(F.lit(f"{b}:"), F.col(f"n_{b}").cast("string"))) for b in "ACGT"]))
    return stats.where("class_bits & 2 > 0").select(F.col("col").alias("pos"), F.col("plurality").alias("consensus"), alleles.alias("alleles"), (F.col("class_bits").bitwiseAND(4) > 0).alias("informative"), (F.col("gaps") > 0).alias("indel"))


def variant_list(sites: DataFrame, most: int = 5000) -> DataFrame:
    """The first variable sites by column, with the total of all: a top-k."""
    total = sites.agg(F.count(F.lit(1)).alias("total"))
    return sites.orderBy("pos").limit(most).crossJoin(F.broadcast(total))  # one row


def gap_stats(alignment: DataFrame) -> DataFrame:
    return alignment.groupBy("seq_idx").agg(F.avg((~F.col("base").isin(*"ACGT")).cast("int")).alias("gap_share"))


def column_inspector(alignment: DataFrame, col: int) -> DataFrame:
    """seq_idx, base, differs from the majority (gaps included), and the position in the ungapped sequence."""
    upto = alignment.where(F.col("col") <= col).groupBy("seq_idx").agg(F.count_if(F.col("base") != "-").alias("ungapped_pos"))
    here = alignment.where(F.col("col") == col)
    top = here.groupBy("base").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("base", F.struct("n", -F.ascii("base"))).alias("majority"))
    return here.crossJoin(F.broadcast(top)).join(upto, "seq_idx").select("seq_idx", "base", (F.col("base") != F.col("majority")).alias("differs"), "ungapped_pos")


def complete_columns(alignment: DataFrame) -> DataFrame:
    """The alignment without columns in which any sequence has a gap."""
    gapped = alignment.where(~F.col("base").isin(*"ACGT")).select("col").distinct()
    return alignment.join(gapped, "col", "left_anti")


def pairs(alignment: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """i, j, comp, diffs, ti, tv: columns in which both have a base; with weights (col, w) each column counts w times.

    Sequences meet on the column; sums are partial before they are shuffled by pair.
    """
    known = alignment.where(F.col("base").isin(*"ACGT"))
    known = known.join(weights, "col") if weights is not None else known.withColumn("w", F.lit(1))
    a = known.select("col", "w", F.col("seq_idx").alias("i"), F.col("base").alias("x"))
    b = known.select("col", F.col("seq_idx").alias("j"), F.col("base").alias("y"))
    met = a.join(b, "col").where("i < j")
    kind = F.concat(F.least("x", "y"), F.greatest("x", "y"))
    differ, transition = F.col("x") != F.col("y"), kind.isin("AG", "CT")
    w = F.col("w")
    zero = F.lit(0)
    found = met.groupBy("i", "j").agg(F.sum(w).alias("comp"), F.sum(F.when(differ, w).otherwise(zero)).alias("diffs"), F.sum(F.when(transition, w).otherwise(zero)).alias("ti"), F.sum(F.when(differ & ~transition, w).otherwise(zero)).alias("tv"))
    ids = alignment.select("seq_idx").distinct()
    every = ids.select(F.col("seq_idx").alias("i")).join(ids.select(F.col("seq_idx").alias("j")), F.col("i") < F.col("j"))
    return every.join(found, ["i", "j"], "left").na.fill(0, ["comp", "diffs", "ti", "tv"])


def distance(model: str) -> tuple[Column, Column]:
    """Distance (p, jc or k2p; saturated ones are capped) and whether it is saturated, of rows of ``pairs``."""
    comp = F.col("comp")
    raw = F.when(comp > 0, F.col("diffs") / comp).otherwise(0.0)
    if model == "p":
        return raw, F.lit(False)
    if model == "jc":
        saturated = raw >= 0.75
        corrected = -0.75 * F.ln(1 - 4 * raw / 3)
    else:
        p, q = (F.when(comp > 0, F.col(c) / comp).otherwise(0.0) for c in ("ti", "tv"))
        s, v = 1 - 2 * p - q, 1 - 2 * q
        saturated = ((s <= 0) | (v <= 0)) & ((p > 0) | (q > 0))
        corrected = -0.5 * F.ln(F.greatest(s, F.lit(MIN_VALUE))) - 0.25 * F.ln(F.greatest(v, F.lit(MIN_VALUE)))
    return F.when(saturated, SATURATED).when(raw > 0, quantized(corrected, 9)).otherwise(0.0), saturated


def distances(pair_rows: DataFrame, model: str = "jc") -> DataFrame:
    d, saturated = distance(model)
    return pair_rows.select("i", "j", d.alias("d"), "ti", "tv", "comp", saturated.alias("saturated"))


def distance_summary(rows: DataFrame) -> DataFrame:
    """One row: mean, closest and furthest pair (the first on ties), transition ratio, saturated and empty pairs."""
    far = F.min(F.when(F.col("d") > 0, F.struct((-F.col("d")).alias("k"), "i", "j")))
    near = F.min(F.struct(F.col("d").alias("k"), "i", "j"))
    return rows.agg(
        F.avg("d").alias("mean"), near["i"].alias("near_i"), near["j"].alias("near_j"), far["i"].alias("far_i"), far["j"].alias("far_j"),
        F.try_divide(F.sum("ti"), F.sum("tv")).alias("ti_tv"), F.count_if("saturated").alias("saturated"), F.count_if(F.col("comp") == 0).alias("no_data"),
    )


def _kmer_codes(seq: str | None, k: int) -> np.ndarray:
    """The k-mers of A, C, G and T alone as numbers, in order."""
    base = LETTER[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
    n = len(base) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for j in range(k):
        code = code * 4 + base[j : j + n]
    bad = np.concatenate([[0], np.cumsum(base > 3)])
    return code[bad[k:] == bad[:-k]]


def _spelled(codes: np.ndarray, k: int) -> pa.Array:
    letters = np.frombuffer(b"ACGT", np.uint8)[codes[:, None] >> np.arange(2 * k - 2, -1, -2) & 3]
    return pa.array(np.ascontiguousarray(letters).view(f"S{k}").ravel()).cast(pa.string())


def kmers(seqs: DataFrame, k: int, key: str = "seq_idx") -> DataFrame:
    """key, kmer, n: the k-mers of A, C, G and T alone, each counted where it starts. A sequence's are counted within its row; ``k`` is 31 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, seq in enumerate(batch.column(1)):
                codes, n = np.unique(_kmer_codes(seq.as_py(), k), return_counts=True)
                for low in range(0, len(codes), WRITTEN):
                    some = codes[low : low + WRITTEN]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(some), row))), _spelled(some, k), pa.array(n[low : low + WRITTEN])], names=[key, "kmer", "n"])

    each = seqs.select(key, "seq").mapInArrow(run, f"{key} {dict(seqs.dtypes)[key]}, kmer string, n long")
    return each.groupBy(key, "kmer").agg(F.sum("n").alias("n"))  # sequences that share a key are one


def kmer_totals(seqs: DataFrame, k: int, key: str = "seq_idx") -> DataFrame:
    """kmer, n, reads: occurrences, and how many keys have the k-mer. Where each key has one row, tasks add up their sequences, so no row a sequence and k-mer is shuffled."""
    if repeated(seqs, key):
        return kmers(seqs, k, key).groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("reads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def added() -> None:
            codes, n, reads = (np.concatenate([h[x] for h in held]) for x in range(3))
            found, at = np.unique(codes, return_inverse=True)
            held[:] = [(found, *(np.bincount(at, x, len(found)).astype(np.int64) for x in (n, reads)))]

        def out() -> Iterator[pa.RecordBatch]:
            codes, n, reads = held.pop()
            for low in range(0, len(codes), WRITTEN):
                part = slice(low, low + WRITTEN)
                yield pa.RecordBatch.from_arrays([_spelled(codes[part], k), pa.array(n[part]), pa.array(reads[part])], names=["kmer", "n", "reads"])

        for batch in batches:
            for seq in batch.column(0):
                codes, n = np.unique(_kmer_codes(seq.as_py(), k), return_counts=True)
                held.append((codes, n, np.ones(len(codes), np.int64)))
                if len(held) >= 256 or len(codes) > ADDED:
                    added()
                    if len(held[0][0]) > ADDED:
                        yield from out()
        if held:
            added()
            yield from out()

    return seqs.select("seq").mapInArrow(run, "kmer string, n long, reads long").groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("reads").alias("reads"))


def kmer_distances(counts: DataFrame) -> DataFrame:
    """i, j, d: corrected distance from the weighted Jaccard index of k-mer counts; 1 without any k-mer, 3 at saturation."""
    totals = counts.groupBy("seq_idx").agg(F.sum("n").alias("total"))
    a, b = (counts.select("kmer", F.col("seq_idx").alias(s), F.col("n").alias(f"n_{s}")) for s in "ij")
    shared = a.join(b, "kmer").where("i < j").groupBy("i", "j").agg(F.sum(F.least("n_i", "n_j")).alias("inter"))
    every = totals.select(F.col("seq_idx").alias("i"), F.col("total").alias("t_i")).join(totals.select(F.col("seq_idx").alias("j"), F.col("total").alias("t_j")), F.col("i") < F.col("j"))
    rows = every.join(shared, ["i", "j"], "left").na.fill(0, ["inter"])
    union = F.col("t_i") + F.col("t_j") - F.col("inter")
    p = 1 - F.try_divide("inter", union)
    d = F.when(union == 0, 1.0).when(p <= 0, 0.0).when(p >= 0.75, 3.0).otherwise(quantized(-0.75 * F.ln(1 - 4 * p / 3), 9))
    return rows.select("i", "j", d.alias("d"))


def numbered(columns: DataFrame) -> DataFrame:
    """col, k: the place of each column in their order. Columns are numbered in ranges of their values, after the counts of the ranges before."""
    placed = columns.select("col", F.floor(F.col("col") / COLUMNS).alias("part"))
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("part").orderBy("col")) - 1
    return placed.withColumn("within", within).join(before, "part").select("col", (F.col("before") + F.col("within")).alias("k"))


def draws(n: int, replicates: DataFrame, seed: int = 42) -> DataFrame:
    """rep, k: the n columns that each replicate (rep) draws. Draws are counters, so they are independent of each other and of the other replicates."""
    each = replicates.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("t"))
    return each.select("rep", F.floor(mulberry32(seed, F.col("rep") * n + F.col("t")) * n).alias("k"))


def drawn_columns(n: int, rep: int, first: int, last: int, seed: int = 42) -> np.ndarray:
    """The draws ``first`` to ``last`` of a replicate, as ``draws`` has them; products wrap at 32 bits."""
    draw = np.arange(rep * n + first + 1, rep * n + last + 1, dtype=np.int64).astype(np.uint32)
    a = np.uint32(seed & 0xFFFFFFFF) + draw * np.uint32(0x6D2B79F5)
    t = (a ^ a >> np.uint32(15)) * (a | np.uint32(1))
    t = (t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))) ^ t
    return np.floor((t ^ t >> np.uint32(14)) / 2.0**32 * n).astype(np.int64)


def bootstrap_columns(columns: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """rep, col, w: how often each replicate draws each kept column."""
    placed = numbered(columns)
    reps = columns.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    return draws(columns.count(), reps, seed).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("w")).join(placed, "k").select("rep", "col", "w")


def rows_of(alignment: DataFrame) -> DataFrame:
    """seq_idx, row: the aligned sequences as strings."""
    cells = F.array_sort(F.collect_list(F.struct("col", "base")))
    return alignment.groupBy("seq_idx").agg(F.array_join(cells["base"], "").alias("row"))
