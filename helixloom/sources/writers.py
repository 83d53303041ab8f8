"""Text forms of reads, sequences, alignments, trees, annotations and association tables.

Row formats are columns or frames of one text column ``value``, for ``write.text``; formats
with a shape across rows (Clustal, NEXUS, PHYLIP, GenBank) are texts of one group.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOOL = "helixloom"
ESCAPES = {"&": "&amp;", ",": "%2C", ";": "%3B", "=": "%3D", "\n": " "}


def fixed(x: float, digits: int) -> str:
    """Decimals of the exact binary value, rounded half up."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def wrapped(seq: Column, width: int) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fastq(reads: DataFrame) -> DataFrame:
    head = F.when(F.coalesce(F.length("desc"), F.lit(0)) > 0, F.concat_ws(" ", "id", "desc")).otherwise(F.col("id"))
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), head), "seq", F.lit("+"), "qual").alias("value"))


def fasta(records: DataFrame, head: Column | str = "id", seq: str = "seq", width: int = 80) -> DataFrame:
    head = F.col(head) if isinstance(head, str) else head
    return records.select(F.concat(F.lit(">"), head, F.lit("\n"), wrapped(F.col(seq), width)).alias("value"))


def contig_fasta(contigs: DataFrame) -> DataFrame:
    head = F.concat("contig_id", F.lit(" length="), F.col("length").cast("string"), F.when(F.col("circular"), " circular=true").otherwise(""))
    return fasta(contigs, head)


def consensus_fasta(stats: DataFrame, name: str = "consensus") -> DataFrame:
    """The consensus of column statistics as one record; columns without one are N."""
    letters = F.array_join(F.array_sort(F.collect_list(F.struct("col", "consensus")))["consensus"], "")
    return fasta(stats.agg(F.replace(letters, F.lit("-"), F.lit("N")).alias("seq")), F.lit(name))


def region_fasta(contigs: DataFrame, contig, start: int, end: int, strand: str = "+") -> DataFrame:
    """The part of a contig, cut to its length, turned if the strand is '-'; 70 letters a line."""
    start = max(0, start)
    part = F.substring("seq", start + 1, max(0, end - start))
    if strand == "-":
        part = F.reverse(F.translate(F.regexp_replace(part, "[^ACGT]", "N"), "ACGT", "TGCA"))
    return contigs.where(F.col("contig") == contig).select(F.concat(F.lit(f">{contig}:{start + 1}-{end}({strand})\n"), wrapped(part, 70)).alias("value"))


def escaped(text: Column) -> Column:
    for mark, code in ESCAPES.items():
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def gff3(features: DataFrame, attributes: Column, phase: Column | None = None) -> DataFrame:
    """Feature lines; the head lines come from ``gff3_head``."""
    row = F.concat_ws("\t", F.col("contig").cast("string"), F.lit(TOOL), "type", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", phase if phase is not None else F.lit("."), attributes)
    return features.select(row.alias("value"))


def gff3_head(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.concat_ws(" ", F.lit("##sequence-region"), F.col("contig").cast("string"), F.lit("1"), F.length("seq").cast("string")).alias("value"))


def feature_gff3(features: DataFrame) -> DataFrame:
    tag, product = escaped(F.col("tag")), escaped(F.coalesce("product", F.lit("")))
    return gff3(features, F.concat(F.lit("ID="), tag, F.lit(";locus_tag="), tag, F.when(product != "", F.concat(F.lit(";product="), product)).otherwise("")))


def gene_gff3(genes: DataFrame) -> DataFrame:
    tag = escaped(F.col("locus_tag"))
    parts = [
        F.concat(F.lit("ID="), tag), F.concat(F.lit("locus_tag="), tag), F.concat(F.lit("product="), escaped(F.col("product"))), F.concat(F.lit("start_codon="), "start_codon"),
        F.concat(F.lit("rbs_score="), F.col("rbs_score").cast("string")), F.concat(F.lit("score="), F.col("score").cast("string")), F.concat(F.lit("partial="), "partial"),
        F.when(F.size("tm_segments") > 0, F.concat(F.lit("tm_helices="), F.size("tm_segments").cast("string"))), F.when(F.col("signal").isNotNull(), "signal_peptide=predicted"),
    ]
    phase = F.when(F.col("partial").isNotNull(), (3 - F.col("length_nt") % 3) % 3).otherwise(0).cast("string")
    return gff3(genes.withColumn("type", F.lit("CDS")), F.concat_ws(";", *parts), phase)


def _gene_head(full: bool) -> Column:
    parts = [F.col("locus_tag"), F.col("product"), F.concat(F.lit("contig="), F.col("contig").cast("string")), F.concat(F.lit("coords="), (F.col("start") + 1).cast("string"), F.lit(".."), F.col("end").cast("string")), F.concat(F.lit("strand="), "strand")]
    if full:
        parts += [F.concat(F.lit("start="), "start_codon"), F.concat(F.lit("partial="), "partial"), F.concat(F.lit("rbs="), F.col("rbs_score").cast("string")), F.when(F.size("tm_segments") > 0, F.concat(F.lit("tm_helices="), F.size("tm_segments").cast("string"))), F.when(F.col("signal").isNotNull(), "signal_peptide=yes")]
    return F.concat_ws(" ", *parts)


def protein_fasta(genes: DataFrame) -> DataFrame:
    return fasta(genes, _gene_head(True), "protein", 60)


def gene_fasta(genes: DataFrame) -> DataFrame:
    return fasta(genes, _gene_head(False), "dna", 70)


def gene_table(genes: DataFrame) -> DataFrame:
    """The 18 columns of the annotation table, for ``write.csv(sep="\\t", header=True)``."""
    return genes.select(
        "locus_tag", "contig", (F.col("start") + 1).alias("start"), "end", "strand", "length_nt", "length_aa", "start_codon", "rbs_score", F.col("gc").alias("gc_percent"), F.round(F.col("mw") / 1000, 1).alias("mw_kda"),
        "pi", "gravy", F.size("tm_segments").alias("tm_helices"), F.when(F.col("signal").isNotNull(), "yes").otherwise("no").alias("signal_peptide"), "localization", "partial", "product",
    )


def feature_table(features: DataFrame) -> DataFrame:
    return features.select(F.col("tag").alias("locus_tag"), "contig", (F.col("start") + 1).alias("start"), "end", "strand", "type", (F.col("end") - F.col("start")).alias("length_nt"), F.coalesce("product", F.lit("")).alias("product"))


def genbank(contigs: DataFrame, genes: DataFrame, date: str = "01-JAN-2026") -> DataFrame:
    """contig, value: a flat file for each contig; its genes are one group with it."""
    pad = " " * 21

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for contig, seq in left[["contig", "seq"]].itertuples(index=False):
            name = str(contig)
            out += [f"LOCUS       {name[:16]:<16}{len(seq):>11} bp    DNA     linear BCT {date}", f"DEFINITION  {name}", f"ACCESSION   {name}", f"VERSION     {name}", "FEATURES             Location/Qualifiers", f"     source          1..{len(seq)}", f'{pad}/mol_type="genomic DNA"']
            for g in right.sort_values("start").to_dict("records"):
                span = f"{g['start'] + 1}..{g['end']}"
                out += [f"     CDS             {'complement(' + span + ')' if g['strand'] == '-' else span}", f'{pad}/locus_tag="{g["locus_tag"]}"', f'{pad}/product="{g["product"]}"', f"{pad}/codon_start=1", f"{pad}/transl_table=11"]
                text = f'/translation="{g["protein"]}"'
                out += [pad + text[k : k + 58] for k in range(0, len(text), 58)]
            out.append("ORIGIN")
            low = seq.lower()
            out += [f"{k + 1:>9} " + " ".join(low[s : s + 10] for s in range(k, min(k + 60, len(low)), 10)) for k in range(0, len(low), 60)]
            out.append("//")
        return pd.DataFrame({"contig": [key[0]] if out else [], "value": ["\n".join(out)] if out else []}, dtype=object)  # no contig: an empty frame would be of floats, which Arrow makes no text of

    wanted = genes.select("contig", "start", "end", "strand", "locus_tag", "product", "protein")
    return contigs.select("contig", "seq").groupBy("contig").cogroup(wanted.groupBy("contig")).applyInPandas(one, f"contig {dict(contigs.dtypes)['contig']}, value string")


def genbank_lines(contigs: DataFrame, genes: DataFrame, date: str = "01-JAN-2026") -> DataFrame:
    """value: the flat files of ``genbank`` as rows in their order, for ``write.text``; no row or task holds the genes of a contig.

    A contig's rows are one run of one partition, sorted as head, genes, sequence. Genes without a contig go; of contigs that
    repeat a key the first carries the genes. All rows are shuffled once, and of a contig's letters only its last row has a copy.
    """
    pad = " " * 21
    none = lambda kind: F.lit(None).cast(kind)
    empty = {"start": "long", "end": "long", "strand": "string", "locus_tag": "string", "product": "string", "protein": "string"}
    key = F.struct(F.substring("seq", 1, 64).alias("begin"), F.xxhash64("seq").alias("hash"))  # the same on head and sequence, so they get one number
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), none("string").alias("seq")), F.struct(F.lit(2).alias("part"), F.col("seq").alias("seq"))))
    sides = contigs.select("contig", key.alias("key"), F.length("seq").alias("size"), ends.alias("end")).select("contig", "key", "size", "end.*", *[none(t).alias(c) for c, t in empty.items()])
    bodies = genes.select("contig", none("struct<begin:string,hash:bigint>").alias("key"), none("int").alias("size"), F.lit(1).alias("part"), none("string").alias("seq"), *[F.col(c).cast(t).alias(c) for c, t in empty.items()])
    dealt = sides.unionByName(bodies).repartition("contig")
    copies = F.when(F.col("part") == 1, 1).otherwise(F.row_number().over(Window.partitionBy("contig", "part").orderBy("key")))
    order = Window.partitionBy("contig").orderBy("copy", "part", "start", "end", "locus_tag").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("copy", copies).withColumn("known", F.max(F.col("part") == 0).over(order)).where("known")
    name, size = F.col("contig").cast("string"), F.col("size").cast("string")
    head = F.concat(
        F.lit("LOCUS       "), F.rpad(F.substring(name, 1, 16), 16, " "), F.lpad(size, 11, " "), F.lit(f" bp    DNA     linear BCT {date}\nDEFINITION  "), name, F.lit("\nACCESSION   "), name, F.lit("\nVERSION     "), name,
        F.lit("\nFEATURES             Location/Qualifiers\n     source          1.."), size, F.lit(f'\n{pad}/mol_type="genomic DNA"'),
    )
    span = F.concat((F.col("start") + 1).cast("string"), F.lit(".."), F.col("end").cast("string"))
    place = F.when(F.col("strand") == "-", F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)
    protein = F.regexp_replace(F.concat(F.lit('/translation="'), "protein", F.lit('"')), "(.{58})(?=.)", f"$1\n{pad}")
    gene = F.concat(
        F.lit("     CDS             "), place, F.lit(f'\n{pad}/locus_tag="'), "locus_tag", F.lit(f'"\n{pad}/product="'), "product",
        F.lit(f'"\n{pad}/codon_start=1\n{pad}/transl_table=11\n{pad}'), protein,
    )
    line = lambda x, k: F.concat(F.lpad((k * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(x, "(.{10})(?=.)", "$1 "))
    letters = F.array_join(F.transform(F.regexp_extract_all(F.lower("seq"), F.lit("(.{1,60})"), F.lit(1)), line), "\n")
    tail = F.concat_ws("\n", F.lit("ORIGIN"), F.nullif(letters, F.lit("")), F.lit("//"))
    return rows.select(F.when(F.col("part") == 0, head).when(F.col("part") == 1, gene).otherwise(tail).alias("value"))


def clustal(ids: list[str], rows: list[str], block: int = 60) -> str:
    """Blocks of 60 columns; '*' under a column of one base, ':' under a transition pair."""
    width = max(min(len(x), 24) for x in ids) + 4
    states = ["".join(sorted({c for c in column if c != "-"})) for column in zip(*rows, strict=True)]
    marks = "".join("*" if len(s) == 1 else ":" if s in ("AG", "CT") else " " for s in states)
    out = [f"CLUSTAL W style alignment by {TOOL}", ""]
    for k in range(0, len(marks), block):
        out += [f"{name[:24]:<{width}}{row[k : k + block]}" for name, row in zip(ids, rows, strict=True)]
        out += [" " * width + marks[k : k + block], ""]
    return "\n".join(out)


def _safe(name: str) -> str:
    return "".join(c if c.isalnum() or c in "_.-" else "_" for c in name)


def nexus(ids: list[str], rows: list[str]) -> str:
    names = [_safe(x) for x in ids]
    wide = max(map(len, names))
    head = ["#NEXUS", "BEGIN DATA;", f"    DIMENSIONS NTAX={len(ids)} NCHAR={len(rows[0]) if rows else 0};", "    FORMAT DATATYPE=DNA GAP=- MISSING=? ;", "    MATRIX"]
    return "\n".join([*head, *(f"    {n:<{wide}} {r}" for n, r in zip(names, rows, strict=True)), "    ;", "END;", ""])


def phylip(ids: list[str], rows: list[str]) -> str:
    """Names of ten characters, made unique by a number at their end."""
    used: dict[str, None] = {}
    for name in ids:
        stem, k = f"{_safe(name)[:10]:<10}", 0
        short = stem
        while short in used:
            k += 1
            short = f"{stem[:8]}{k:02d}"
        used[short] = None
    return "\n".join([f" {len(ids)} {len(rows[0]) if rows else 0}", *(n + r for n, r in zip(used, rows, strict=True)), ""])


def variant_table(sites: DataFrame) -> DataFrame:
    """1-based variable sites, for a tab-separated file."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return sites.select((F.col("pos") + 1).alias("alignment_column"), "consensus", F.array_join("alleles", " ").alias("alleles"), yes("informative").alias("parsimony_informative"), yes("indel").alias("involves_gap"))


def nexus_tree(newick: str) -> str:
    return "\n".join(["#NEXUS", f"[{TOOL}]", "", "BEGIN TREES;", f"  TREE tree1 = [&R] {newick}", "END;", ""])


def distance_table(distances: DataFrame, names: list[str]) -> DataFrame:
    """The square matrix to six places, a row for each taxon."""
    both = distances.select("i", "j", "d").unionByName(distances.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    wide = both.groupBy("i").pivot("j", list(range(len(names)))).agg(F.first("d"))
    cells = [F.format_number(F.coalesce(F.col(str(k)), F.lit(0.0)), "0.000000").alias(n) for k, n in enumerate(names)]
    label = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("i") + 1).cast("int"))
    return wide.select(label.alias("taxon"), *cells)


def association_table(rows: DataFrame, binary: bool = True) -> DataFrame:
    """The columns of the results file; p-values with four decimals and an exponent."""
    power = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4e", F.col(c)))
    if binary:
        return rows.select("gene", F.col("a").alias("present_case"), F.col("b").alias("present_control"), F.col("c").alias("absent_case"), F.col("d").alias("absent_control"), "odds_ratio", F.col("ci_lo").alias("or_ci_low"), F.col("ci_hi").alias("or_ci_high"), power("p").alias("p_fisher"), power("q").alias("q_bh_fdr"), power("q_bonf").alias("q_bonferroni"), power("cmh_p").alias("cmh_p_stratified"), F.col("or_mh").alias("cmh_or_common"), "strata_used")
    return rows.select("gene", "mean_present", "mean_absent", F.col("mean_diff").alias("mean_difference"), F.col("t").alias("t_statistic"), "df", power("p").alias("p_welch"), power("q").alias("q_bh_fdr"), power("q_bonf").alias("q_bonferroni"))
