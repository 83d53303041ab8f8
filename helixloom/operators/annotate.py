"""Gene annotation: frames, coding model, gene calls, overlap resolution, protein properties.

Table: contigs (contig, seq), contig being a long.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions import genes as G
from helixloom.functions import protein as P
from helixloom.functions import sequence as S
from helixloom.operators import clusters, explorer
from helixloom.session import materialize, spread

MIN_GENE, SPARE = 90, 60
TRAINING_LENGTHS, TRAINING_GENES = (300, 180, 120), 600
SHORT, SITE, CODING = 240, 0.45, 0.78
BASES = 1 << 20
SAME_STRAND, OPPOSITE_STRAND = 60, 25


def cleaned(contigs: DataFrame, min_gene: int = MIN_GENE) -> DataFrame:
    """Contigs of A, C, G, T and N that are long enough."""
    return contigs.select("contig", F.regexp_replace(F.upper("seq"), "[^ACGTN]", "N").alias("seq")).where(F.length("seq") >= min_gene + SPARE)


def strands(contigs: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col("seq")).alias("s")))
    return contigs.select("contig", F.length("seq").alias("len"), F.explode(both).alias("x")).select("contig", "len", "x.strand", F.col("x.s").alias("seq"))


def orf_scan(contigs: DataFrame, least: int = MIN_GENE) -> DataFrame:
    """contig, len, strand, start, end, partial3, orf in the direction of the strand; each contig by itself."""

    def run(batches):
        for rows in batches:
            out = [(c, n, s, a, b, p, seq[a:b]) for c, n, s, seq in rows[["contig", "len", "strand", "seq"]].itertuples(index=False) for a, b, p in G.orfs(seq, least)]
            yield pd.DataFrame(out, columns=["contig", "len", "strand", "start", "end", "partial3", "orf"])

    return spread(strands(contigs)).mapInPandas(run, "contig long, len int, strand string, start int, end int, partial3 boolean, orf string")


def hexamers(contigs: DataFrame) -> DataFrame:
    """hexamer, n over all places of the forward strand; a task counts its contigs, up to BASES bases at a time."""

    def run(batches):
        found = np.zeros(4096, np.int64)
        for rows in batches:
            held, weight = [], 0
            for seq in rows["seq"]:
                for k in range(0, len(seq or ""), BASES):
                    held.append(seq[k : k + BASES + 5])
                    weight += len(held[-1])
                    if weight >= BASES:
                        found += G.hexamer_counts("N".join(held))
                        held, weight = [], 0
            found += G.hexamer_counts("N".join(held))
        seen = np.flatnonzero(found)
        yield pd.DataFrame({"hexamer": ["".join("ACGT"[k >> s & 3] for s in (10, 8, 6, 4, 2, 0)) for k in seen.tolist()], "n": found[seen]}).astype({"hexamer": object})

    return contigs.select("seq").mapInPandas(run, "hexamer string, n long").groupBy("hexamer").agg(F.sum("n").alias("n"))


def training_orfs(contigs: DataFrame, most: int = TRAINING_GENES) -> DataFrame:
    """The longest frames, at least 300 long, or 180 or 120 if there are too few: a top-k."""
    found = materialize(orf_scan(contigs, TRAINING_LENGTHS[-1]), "orfs").withColumn("n", F.col("end") - F.col("start"))
    many = found.agg(*[F.count_if(F.col("n") >= k) for k in TRAINING_LENGTHS]).first()
    least = TRAINING_LENGTHS[0] if many[0] >= 40 else TRAINING_LENGTHS[1] if many[1] >= 20 else TRAINING_LENGTHS[2]
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "contig", "strand", F.col("start") % 3, "start").limit(most)


def train(contigs: DataFrame) -> G.CodingModel:
    """Hexamer log odds and start usage. Only 4096 counts and at most TRAINING_GENES frames reach the driver."""
    place = lambda h: int(G.words(G.codes(h), 6)[0])
    background, coding = np.zeros(4096), np.zeros(4096)
    for r in hexamers(contigs).collect():
        background[place(r["hexamer"])] = r["n"]
    chosen = [r["orf"] for r in training_orfs(contigs).select("orf").collect()]
    for orf in chosen:
        w = G.words(G.codes(orf), 6)[::3]
        coding += np.bincount(w[w >= 0], minlength=4096)
    found = Counter(s for s in map(G.best_site_start, chosen) if s)
    return G.CodingModel(G.log_odds(coding, background), G.start_usage(found), len(chosen))


CALL = "contig long, strand string, start int, end int, score double, coding double, mean_hex_lr double, rbs_score double, rbs_matches int, rbs_spacer int, start_codon string, partial string, dna string"


def call_genes(contigs: DataFrame, model: G.CodingModel, min_gene: int = MIN_GENE, use_rbs: bool = True, allowed: tuple[str, ...] = tuple(G.STARTS)) -> DataFrame:
    """A candidate gene for each frame with a usable start; short ones need a ribosome site or a strong ATG."""
    shared = contigs.sparkSession.sparkContext.broadcast(model)

    def called(rows: pd.DataFrame) -> pd.DataFrame:
        best = G.choose_starts(rows["orf"].tolist(), shared.value, use_rbs, allowed)
        rows = rows.iloc[best.frame]
        length, start, end = (rows[c].to_numpy(np.int64) for c in ("len", "start", "end"))
        size = rows["orf"].str.len().to_numpy(np.int64) - best.rel
        open_end, forward = rows["partial3"].to_numpy(bool), (rows["strand"] == "+").to_numpy(bool)
        backed = (best.rbs_score >= SITE) | ((best.codon == "ATG") & (best.coding >= CODING))
        kept = (best.rel >= 3) & (size >= min_gene)
        if use_rbs:
            kept &= (size >= SHORT) | open_end | backed
        first = start + best.rel
        thousandth = lambda x: np.floor(x * 10**3 + 0.5) / 10**3
        out = pd.DataFrame({
            "contig": rows["contig"].to_numpy(), "strand": rows["strand"].to_numpy(), "start": np.where(forward, first, length - end), "end": np.where(forward, end, length - first),
            "score": thousandth(best.total), "coding": thousandth(best.coding), "mean_hex_lr": thousandth(best.mean_lr), "rbs_score": best.rbs_score, "rbs_matches": best.rbs_matches,
            "rbs_spacer": pd.array(np.where(best.rbs_spacer < 0, 0, best.rbs_spacer), "Int32"), "start_codon": best.codon, "partial": np.where(open_end, "3'", None),
        })
        out.loc[best.rbs_spacer < 0, "rbs_spacer"] = pd.NA
        out = out[kept]
        return out.assign(dna=pd.Series([x[r:] for x, r in zip(rows["orf"].to_numpy()[kept], best.rel[kept].tolist(), strict=True)], out.index, object))

    def run(batches):
        for rows in batches:
            upto = rows["orf"].str.len().to_numpy(np.int64).cumsum() // BASES  # so many bases go through numpy together
            for _, some in rows.groupby(upto):
                yield called(some)

    return orf_scan(contigs, min_gene).mapInPandas(run, CALL)


def resolve_overlaps(calls: DataFrame) -> DataFrame:
    """Accepted genes: best scores first; one that overlaps an accepted one by more than the allowance goes."""
    return clusters.resolved(calls, SAME_STRAND, OPPOSITE_STRAND)


PROTEIN = "length_aa int, mw double, pi double, gravy double, aromaticity double, tm_segments array<struct<start:int,end:int>>, signal struct<score:double,cleavage_after:int,note:string>, localization string"


def protein_properties(proteins: DataFrame, key: str) -> DataFrame:
    """key and the properties of rows (key, protein)."""

    def one(protein: str, pi: float | None) -> tuple:
        segments, signal = P.membrane_segments(protein), P.signal_peptide(protein)
        named = {"score": signal[0], "cleavage_after": signal[1], "note": signal[2]} if signal else None
        return (
            len(protein), P.rounded(P.molecular_weight(protein), 1), None if pi is None else P.rounded(pi, 2), P.rounded(P.gravy(protein), 3), P.rounded(P.aromaticity(protein), 3),
            [{"start": a, "end": b} for a, b in segments], named, P.localization(segments, signal),
        )

    names = ["length_aa", "mw", "pi", "gravy", "aromaticity", "tm_segments", "signal", "localization"]

    def run(batches):
        for rows in batches:
            points = P.isoelectric_points(rows["protein"].tolist())
            yield pd.DataFrame([(k, *one(p, pi)) for (k, p), pi in zip(rows.itertuples(index=False), points, strict=True)], columns=[key, *names])

    return proteins.select(key, "protein").mapInPandas(run, f"{key} {dict(proteins.dtypes)[key]}, {PROTEIN}")


def annotate(contigs: DataFrame, min_gene: int = MIN_GENE, use_rbs: bool = True, prefix: str = "GE", allowed: tuple[str, ...] = tuple(G.STARTS)) -> DataFrame:
    """Genes with locus tags, proteins and their properties."""
    clean = materialize(cleaned(contigs, min_gene), "contigs")
    accepted = resolve_overlaps(materialize(call_genes(clean, train(clean), min_gene, use_rbs, allowed), "calls"))
    tagged = explorer.locus_tags(accepted.withColumn("feature_id", F.xxhash64("strand", "end")), prefix).drop("feature_id")
    tagged = materialize(tagged.withColumn("protein", S.translated(F.col("dna"))), "genes")
    gc = S.quantized(S.count_of(F.col("dna"), "GC") / F.length("dna") * 100, 1)
    product = F.when(F.col("partial").isNull(), "hypothetical protein").otherwise("hypothetical protein (partial)")
    return tagged.join(protein_properties(tagged, "locus_tag"), "locus_tag").withColumns({"gc": gc, "length_nt": F.length("dna"), "product": product})


def annotation_summary(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row: genes, density, lengths, starts, partial, signal and membrane proteins."""
    by_length = genes.groupBy("length_aa").agg(F.count(F.lit(1)).alias("n"))
    upto = by_length.withColumn("upto", F.sum("n").over(Window.orderBy("length_aa"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    median = upto.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("length_aa").alias("median_aa"))
    g = genes.agg(
        F.count(F.lit(1)).alias("genes"), F.sum(F.col("end") - F.col("start")).alias("coding_bases"), F.floor(F.avg("length_aa") + 0.5).alias("mean_aa"), F.min("length_aa").alias("shortest_aa"), F.max("length_aa").alias("longest_aa"),
        *[F.count_if(F.col("start_codon") == s).alias(f"starts_{s}") for s in G.STARTS], F.count_if(F.col("partial").isNotNull()).alias("partial_genes"), F.count_if(F.col("signal").isNotNull()).alias("signal_peptides"), F.count_if(F.size("tm_segments") > 0).alias("tm_proteins"),
    )
    bases = contigs.agg(F.sum(F.length("seq")).alias("total_bases"), F.count(F.lit(1)).alias("contigs"))
    return g.crossJoin(bases).crossJoin(median).withColumn("coding_density", F.coalesce(F.try_divide("coding_bases", "total_bases"), F.lit(0.0)))
