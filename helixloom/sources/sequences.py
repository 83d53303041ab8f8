"""FASTA, GFF3/GTF and GenBank texts as DataFrames, the format sniff, and pasted sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Feature types of GenBank tables that count, and the names that GFF types go by.
GENBANK_TYPES = ("gene", "CDS", "rRNA", "tRNA", "tmRNA", "ncRNA", "misc_RNA", "mobile_genetic_element", "pseudogene", "region", "repeat_region", "exon", "mRNA", "transcript")
TYPE_NAMES = {
    "cds": "CDS", "gene": "gene", "pseudogene": "pseudogene", "trna": "tRNA", "rrna": "rRNA", "tmrna": "tmRNA", "ncrna": "ncRNA", "misc_rna": "misc_RNA",
    "snrna": "ncRNA", "snorna": "ncRNA", "mirna": "ncRNA", "mrna": "mRNA", "transcript": "mRNA", "exon": "exon", "mobile_genetic_element": "mobile_genetic_element",
    "insertion_sequence": "mobile_genetic_element", "transposon": "mobile_genetic_element", "prophage": "mobile_genetic_element",
    "repeat_region": "repeat_region", "crispr": "repeat_region", "region": "region", "source": "region",
}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def fasta(sources: DataFrame) -> DataFrame:
    """file, ord, id, desc, seq of rows (file, text): records without sequence go; nameless ones are numbered."""
    records = sources.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "(?m)^>")).alias("ord", "record")).where("ord > 0")
    desc = F.trim(F.regexp_extract("record", r"^([^\n]*)", 1))
    seq = F.upper(F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s+", ""))
    named = F.coalesce(F.nullif(F.split(desc, r"\s+")[0], F.lit("")), F.concat(F.lit("seq_"), F.col("ord").cast("string")))
    return records.select("file", (F.col("ord") - 1).alias("ord"), named.alias("id"), desc.alias("desc"), seq.alias("seq")).where("seq <> ''")


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """Records of a pasted text: FASTA if it holds '>', else one for each word."""
    source = spark.createDataFrame([("pasted", text)], "file string, text string")
    if ">" in text:
        return fasta(source)
    parts = source.select("file", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("ord", "seq"))
    name = F.concat(F.lit("pasted_"), (F.col("ord") + 1).cast("string"))
    return parts.select("file", "ord", name.alias("id"), name.alias("desc"), F.upper("seq").alias("seq"))


def sanitized(records: DataFrame, keep: str = "A-Z-") -> DataFrame:
    """Upper-case letters and gaps only; empty records go; repeated ids get a number."""
    clean = records.withColumn("seq", F.regexp_replace(F.upper("seq"), f"[^{keep}]", "")).where("seq <> ''")
    k = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return clean.withColumn("id", F.when(k > 1, F.concat("id", F.lit("_"), k.cast("string"))).otherwise(F.col("id")))


def sniff(text: str) -> str:
    """genbank, gff or fasta."""
    if re.search(r"(?m)^LOCUS\s", text):
        return "genbank"
    rows = (line.split("\t") for line in text.splitlines() if line and line[0] != "#")
    if text.lstrip().lower().startswith("##gff-version") or any(len(r) >= 9 and r[2].strip().lower() in TYPE_NAMES for r in rows):
        return "gff"
    return "fasta"


def decoded(value: str) -> str:
    return unquote(value.replace("+", "%20"), errors="replace")


def attributes(raw: str | None) -> dict[str, str]:
    """``k=v`` and ``k "v"`` parts; the first of a key wins."""
    out: dict[str, str] = {}
    for part in re.split(r";\s*", raw or ""):
        part = part.strip()
        key, eq, value = part.partition("=")
        if not eq:
            match = re.fullmatch(r"([\w.-]+)\s+(.*)", part, re.ASCII)
            if not match:
                continue
            key, value = match.groups()
        key, value = key.strip(), value.strip()
        value = value[value[:1] in "\"'" and value != "" :]
        value = value[:-1] if value[-1:] in ("'", '"') else value
        if key:
            out.setdefault(key, decoded(value))
    return out


GFF = "file string, ord long, contig string, type string, start long, end long, strand string, phase string, circular boolean, attrs map<string,string>"


def gff_line(line: str) -> tuple | None:
    """contig, type, start, end, strand, phase, circular, attrs of a line with nine columns or a region line."""
    line = line.strip()
    if region := re.match(r"##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)", line, re.I):
        start, end = int(region[2]), int(region[3])
        return (region[1], "sequence-region", start - 1, end, ".", ".", False, {}) if end >= start else None
    cells = line.split("\t")
    if line.startswith("#") or len(cells) < 9 or not (cells[3].strip().isdigit() and cells[4].strip().isdigit()):
        return None
    start, end = int(cells[3]), int(cells[4])
    if end < start:
        return None
    kind, attrs = cells[2].strip(), attributes(cells[8])
    ring = attrs.get("Is_circular") or attrs.get("is_circular") or attrs.get("circular") or ""
    return cells[0].strip() or "sequence", TYPE_NAMES.get(kind.lower(), kind), start - 1, end, "-" if cells[6].strip() == "-" else "+", cells[7].strip(), bool(re.search("true|yes|circular", ring, re.I)), attrs


def gff_rows(sources: DataFrame) -> DataFrame:
    """The lines of GFF3 or GTF texts with nine columns, and ``##sequence-region`` lines as type ``sequence-region``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file, text in zip(rows["file"], rows["text"], strict=True):
                lines = re.split(r"(?im)^##FASTA\s*$", text or "")[0].splitlines()
                out += [(file, k, *row) for k, line in enumerate(lines) if (row := gff_line(line))]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in GFF.replace("map<string,string>", "map").split(", ")])

    return sources.select("file", "text").mapInPandas(run, GFF)


def _first(*keys: str):
    return F.coalesce(*[F.nullif(F.col("attrs")[k], F.lit("")) for k in keys])


def gff_regions(rows: DataFrame) -> DataFrame:
    """contig, start, end, length, circular: region lines folded by contig."""
    size = F.col("end") - F.col("start")
    return rows.where(F.col("type").isin("region", "sequence-region")).groupBy("contig").agg(F.min(F.col("start") + 1).alias("start"), F.max("end").alias("end"), F.max(size).alias("length"), F.bool_or("circular").alias("circular"))


def gff_features(rows: DataFrame) -> DataFrame:
    """Features in the form that ``explorer.resolve_parents`` takes."""
    kind = F.col("type")
    parent = F.coalesce(_first("Parent"), F.when(kind != "mRNA", _first("transcript_id")), F.when(kind != "gene", _first("gene_id")))
    return rows.where(~kind.isin("region", "sequence-region")).select(
        "ord", "contig", "start", "end", "strand", "phase", "type", _first("ID", "transcript_id", "gene_id").alias("id"), parent.alias("parent"),
        _first("locus_tag", "Locus_tag", "locusTag", "gene_id", "protein_id").alias("tag"), _first("Name", "gene", "Gene", "gene_name").alias("name"),
        _first("product", "Product", "description", "Description", "Note", "note", "function", "gene_desc").alias("product"),
        (F.coalesce(_first("pseudo", "pseudogene").rlike("(?i)^(true|yes|1|unknown)$"), F.lit(False)) | (kind == "pseudogene")).alias("is_pseudo"),
    )


def gff_fasta(sources: DataFrame) -> DataFrame:
    """Records of the FASTA part of GFF texts."""
    part = F.split("text", r"(?im)^##FASTA[^\n]*$")
    return fasta(sources.where(F.size(part) > 1).select("file", part[1].alias("text"))).withColumn("seq", F.regexp_replace("seq", "[^ACGTN]", "N"))


GENBANK = "file string, kind string, contig string, desc string, seq string, type string, start long, end long, strand string, tag string, product string"
KEY = re.compile(r" {5}(\S+)\s+(.+?)\s*$")
QUALIFIER = re.compile(r"\s*/([^=]+)(?:=(.*))?$")


def _locus(block: list[str]) -> Iterator[tuple]:
    """Rows of one LOCUS record: the record itself, then its features."""
    name = block[0].split()[1] if len(block[0].split()) > 1 else ""
    desc = next((x[len("DEFINITION") :].strip() for x in block if x.startswith("DEFINITION")), "")
    first = next((k for k, x in enumerate(block) if x.startswith("FEATURES")), len(block))
    origin = next((k for k, x in enumerate(block) if x.startswith("ORIGIN")), len(block))
    letters = []
    for line in block[origin + 1 :]:
        if line.startswith("//"):
            break
        letters.append(re.sub("[^A-Za-z]", "", line).upper())
    yield "record", name, desc, "".join(letters), None, None, None, None, None, None
    heads = [k for k in range(first + 1, origin) if not block[k][5:6].isspace() and KEY.match(block[k])]
    count = 0
    for head, stop in zip(heads, [*heads[1:], origin], strict=True):
        kind, place = KEY.match(block[head]).groups()
        body = block[head + 1 : stop]
        while body and re.match(r"\s+\d", body[0]) and "/" not in body[0]:
            place += body.pop(0).strip()
        spans = [int(x) for x in re.findall(r"\d+", place)]
        if kind not in GENBANK_TYPES or len(spans) < 2:
            continue
        quals: dict[str, str] = {}
        current = None
        for line in body:
            if match := QUALIFIER.match(line):
                current = match[1].strip() if match[1].strip() not in quals else None
                if current:
                    quals[current] = match[2] or ""
            elif current:
                quals[current] += line.strip()
        quals = {k: v.removeprefix('"').removesuffix('"') for k, v in quals.items()}
        count += 1
        yield (
            "feature", name, None, None, "CDS" if kind == "gene" else kind, min(spans) - 1, max(spans), "-" if "complement" in place else "+",
            quals.get("locus_tag") or f"feat_{count}", quals.get("product") or quals.get("gene") or "",
        )


def genbank(sources: DataFrame) -> DataFrame:
    """Rows of kind ``record`` (contig, desc, seq) and ``feature`` of GenBank texts with one LOCUS or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file, text in zip(rows["file"], rows["text"], strict=True):
                all_lines = (text or "").splitlines()
                at = [k for k, x in enumerate(all_lines) if re.match(r"LOCUS\s", x)]
                if not at:
                    raise ValueError(f"no LOCUS line in {file}")
                out += [(file, *row) for a, b in zip(at, [*at[1:], len(all_lines)], strict=True) for row in _locus(all_lines[a:b])]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in GENBANK.split(", ")]).astype({"start": "Int64", "end": "Int64"})

    return sources.select("file", "text").mapInPandas(run, GENBANK)
