"""Table views: sorted pages, filters, inspectors, input checks and set operations on samples and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import sequence as S

READ_KEYS = {"index": "read_idx", "length": "length", "quality": "mean_q"}
GENE_KEYS = ("locus_tag", "start", "length_aa", "rbs_score", "pi", "mw")


def read_page(metrics: DataFrame, key: str = "index", descending: bool = False, offset: int = 0, rows: int = 50) -> DataFrame:
    """A page of the read table, ties by read."""
    by = F.col(READ_KEYS[key])
    return metrics.orderBy(by.desc() if descending else by.asc(), "read_idx").offset(offset).limit(rows)


def fetch(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the chosen read_idx."""
    return reads.join(ids.select("read_idx").distinct(), "read_idx", "left_semi")


def filter_genes(genes: DataFrame, query: str = "", membrane: bool = False, signal: bool = False, partial: bool = False, key: str = "start", most: int = 400) -> DataFrame:
    """Genes whose tag holds the text or whose protein holds its first 12 letters, with the flags, sorted: a top-k."""
    q = query.strip().lower()
    found = F.contains(F.lower("locus_tag"), F.lit(q)) | F.contains(F.lower("protein"), F.lit(q[:12]))
    rows = genes.where(found) if q else genes
    for wanted, flag in ((membrane, F.size("tm_segments") > 0), (signal, F.col("signal").isNotNull()), (partial, F.col("partial").isNotNull())):
        rows = rows.where(flag) if wanted else rows
    if key not in GENE_KEYS:
        raise ValueError(f"key must be one of {GENE_KEYS}")
    return rows.orderBy(key, "locus_tag").limit(most)


def sorted_tests(rows: DataFrame, key: str = "p", search: str = "", most: int = 150) -> DataFrame:
    """Association rows by p, q or the size of the log odds ratio, with a search on the gene and its product: a top-k."""
    q = search.strip().lower()
    named = [F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in ("gene", "product") if c in rows.columns]
    rows = rows.where(named[0] | named[-1]) if q else rows
    order = F.abs(F.log2("odds_ratio")).desc_nulls_last() if key == "odds_ratio" else F.col(key).asc_nulls_last()
    return rows.orderBy(order, "gene").limit(most)


def inspect_feature(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sequence of each feature in its direction, GC, protein of coding ones, and whether the contig is a placeholder."""
    met = features.join(contigs.select("contig", "seq", F.length("seq").alias("len")), "contig")
    part = F.substring("seq", F.greatest(F.lit(0), F.col("start")).cast("int") + 1, (F.least("len", F.col("end")) - F.greatest(F.lit(0), F.col("start"))).cast("int"))
    return described(met.select(*features.columns, part.alias("dna")), features.columns)


def described(sliced: DataFrame, columns: list[str]) -> DataFrame:
    """Features whose ``dna`` is a slice of the contig, turned into their direction, with what it says."""
    met = sliced.withColumn("dna", F.when(F.col("strand") == "-", S.reverse_complement(F.col("dna"))).otherwise(F.col("dna")))
    coding = F.col("type").isin("CDS", "gene")
    return met.select(*columns, "dna", region_gc(F.col("dna")).alias("gc"), F.when(coding, S.translated(F.col("dna"))).alias("protein"), (F.length(F.translate("dna", "N", "")) == 0).alias("placeholder"))


def region_gc(seq: Column) -> Column:
    """Share of G and C among all letters but gaps, in percent."""
    n = F.length(F.translate(seq, "-", ""))
    return F.when(n > 0, S.count_of(seq, "GCgc") * 100.0 / n).otherwise(0.0)


def conservation(stats: DataFrame) -> DataFrame:
    """col, share of the most frequent base among all sequences."""
    each = [F.col(f"n_{b}") for b in "ACGT"]
    n = F.col("gaps") + each[0] + each[1] + each[2] + each[3]
    return stats.select("col", (F.greatest(*each) / n).alias("share"))


def looks_like_protein(records: DataFrame, sequences: int = 5, letters: int = 400) -> bool:
    """Whether the first sequences are under 85 % nucleotide letters: the input heuristic of the tree builder."""
    head = F.substring("seq", 1, letters)
    n, known = records.orderBy("ord").limit(sequences).agg(F.sum(F.length(head)), F.sum(S.count_of(F.upper(head), "ACGTUN-"))).first()
    return bool(n) and n > 50 and known / n < 0.85


def runnable(traits: DataFrame, binary: bool = True) -> None:
    """An association needs four matched samples, and two cases and two controls or numbers throughout."""
    n, cases, bad = traits.agg(F.count(F.lit(1)), F.count_if("is_case") if binary else F.lit(0), F.lit(0) if binary else F.count_if(F.col("value").isNull() | F.isnan("value"))).first()
    if n < 4 or (binary and (cases < 2 or n - cases < 2)):
        raise ValueError("too few samples, cases or controls")
    if bad:
        raise ValueError("a numeric trait has values that are no numbers")


def merge_by_contig(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features of both sides; a contig that the right side has comes from there."""
    return left.join(right.select("contig").distinct(), "contig", "left_anti").unionByName(right, allowMissingColumns=True)


def named_alike(contigs: DataFrame, features: DataFrame) -> DataFrame:
    """Features; where there is exactly one contig and all features are on one, they take the contig's name."""
    ours = contigs.agg(F.count(F.lit(1)).alias("__n"), F.min("contig").alias("__name"))
    theirs = features.agg(F.min("contig").alias("__low"), F.max("contig").alias("__high"))
    met = features.crossJoin(F.broadcast(ours.crossJoin(theirs)))  # one row
    alike = (F.col("__n") == 1) & (F.col("__low") == F.col("__high"))
    return met.withColumn("contig", F.when(alike, F.col("__name")).otherwise(F.col("contig"))).select(*features.columns)


def repeated(rows: DataFrame, key: str) -> bool:
    """Whether any value of a key stands in several rows; only the key is read."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
