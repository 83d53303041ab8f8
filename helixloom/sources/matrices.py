"""Presence/absence matrices and phenotype tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Annotation columns of a matrix that are no samples, cells that state presence or absence, names of id columns.
ANNOTATION = re.compile(r"(?i)^(non-unique gene name|annotation|avg sequences? per gene|min|max)")
BINARY = r"(?i)^([01]|true|false|yes|no|present|absent)?$"
PRESENT = "(?i)^true|yes|present$"
ID_COLUMNS = ("id", "sample", "isolate", "strain", "name")
SNIFFED_ROWS = 20
#: What labels of cases read like.
CASE_HINTS = "(?i)resist|case|positive|^pos$|yes|surviv|pathog|sympt|high"


def delimiter(header: str) -> str:
    """The most frequent of tab, comma and semicolon; the earlier on ties."""
    return max("\t,;", key=header.count)


def _table(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None:
        raise ValueError("the table is empty")
    return spark.read.csv(path, sep=delimiter(first["value"]), header=True, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)


def presence(spark: SparkSession, path: str) -> DataFrame:
    """gene, sample, present in long form. Cells are 0/1 words or, if one of the first rows has another word, tags: then any text is presence."""
    rows = _table(spark, path)
    name = next((c for c in rows.columns if c.lower() == "gene"), rows.columns[0])
    samples = [c for c in rows.columns if c != name and not ANNOTATION.match(c)]
    if len(samples) < 2:
        raise ValueError("a matrix needs two sample columns or more")
    tags = any(not re.match(BINARY, (r[c] or "").strip()) for r in rows.limit(SNIFFED_ROWS).collect() for c in samples)
    kept = rows.where((F.col(f"`{name}`") != "") & (F.lower(f"`{name}`") != "gene")).withColumn("__ord", F.monotonically_increasing_id())
    first = kept.groupBy(F.col(f"`{name}`").alias("__gene")).agg(F.min("__ord").alias("__ord"))
    kept = kept.join(first, "__ord", "left_semi")

    def present(cell: Column) -> Column:
        cell = F.coalesce(F.trim(cell), F.lit(""))
        return cell != "" if tags else (cell == "1") | cell.rlike(PRESENT)

    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), present(F.col(f"`{s}`")).alias("present")) for s in samples])).alias("x")
    return kept.select(F.col(f"`{name}`").alias("gene"), cells).select("gene", "x.sample", "x.present")


def phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """sample and the trait columns as text; the sample column is the first, or a later one with the name of an id.

    ``row`` is the line's place in the file: of lines that repeat a sample the later one counts.
    """
    rows = _table(spark, path)
    if len(rows.columns) < 2:
        raise ValueError("a phenotype table needs an id and a trait column")
    key = next((c for c in rows.columns if c.lower() in ID_COLUMNS), rows.columns[0])
    return rows.select(F.col(f"`{key}`").alias("sample"), *[F.col(f"`{c}`") for c in rows.columns if c != key], F.monotonically_increasing_id().alias("row")).where("sample <> ''")


def pick_trait(kinds: dict[str, str]) -> str | None:
    """The first binary column, else the first numeric one."""
    return next((c for kind in ("binary", "numeric") for c, k in kinds.items() if k == kind), None)


def case_label(table: DataFrame, column: str, row: str = "row") -> str | None:
    """The label of the cases of a binary column: the first to appear that reads like one, else the last in order; blank ones do not count."""
    v = F.trim(F.col(f"`{column}`"))
    seen = table.select(v.alias("v"), F.col(row).alias("at")).where("v <> ''")
    hinted = F.min(F.when(F.col("v").rlike(CASE_HINTS), F.struct("at", "v")))
    return seen.agg(F.coalesce(hinted["v"], F.max("v")).alias("v")).first()["v"]
