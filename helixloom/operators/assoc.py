"""Genotype-phenotype association: sample matching, contingency, tests, corrections.

Tables: presence (gene, sample, present); traits (sample, is_case, value, stratum).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import stats


def _cells() -> list[Column]:
    here, case = F.col("present"), F.col("is_case")
    return [F.count_if(here & case).alias("a"), F.count_if(here & ~case).alias("b"), F.count_if(~here & case).alias("c"), F.count_if(~here & ~case).alias("d")]


def one_row_a_sample(traits: DataFrame) -> DataFrame:
    """Of rows that repeat a sample the later one counts: that with the largest ``row``, or without that column the largest by its values."""
    values = [c for c in traits.columns if c != "sample"]
    first = [F.col("row")] if "row" in values else []
    last = F.max(F.struct(*first, *[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(values)]))
    return traits.groupBy("sample").agg(last.alias("x")).select("sample", *[F.col(f"x.v{k}").alias(c) for k, c in enumerate(values)])


def _with_traits(presence: DataFrame, traits: DataFrame) -> DataFrame:
    """Samples without a case label count as controls; each sample counts once. No side is ever broadcast."""
    return presence.join(one_row_a_sample(traits).withColumn("is_case", F.coalesce("is_case", F.lit(False))).hint("merge"), "sample")


def contingency(presence: DataFrame, traits: DataFrame) -> DataFrame:
    """gene, a, b, c, d: present or absent by case or control."""
    return _with_traits(presence, traits).groupBy("gene").agg(*_cells())


def stratified(presence: DataFrame, traits: DataFrame) -> DataFrame:
    return _with_traits(presence, traits).groupBy("gene", "stratum").agg(*_cells())


def binary_scan(presence: DataFrame, traits: DataFrame, with_strata: bool = True) -> DataFrame:
    """One row a gene: counts, odds ratio, Fisher p, corrections and, with strata, the Mantel-Haenszel test.

    The stratum tables are the only aggregation over the grid; the tables of genes are their sums.
    """
    strata = stratified(presence, traits)
    tables = strata.groupBy("gene").agg(*[F.sum(x).alias(x) for x in "abcd"])
    rows = tables.join(stats.fisher_exact(tables, "gene"), "gene")
    rows = rows.withColumns(stats.odds_ratio(*[F.col(x) for x in "abcd"]))
    rows = stats.bonferroni(stats.benjamini_hochberg(rows, "p", "gene"), "p")
    return rows.join(stats.mantel_haenszel(strata, "gene"), "gene", "left").withColumn("cmh_p", stats.chi_square_sf1("chi2")) if with_strata else rows


def continuous_scan(presence: DataFrame, traits: DataFrame) -> DataFrame:
    """One row a gene: Welch's test of the trait between carriers and others, with corrections."""
    joined = presence.join(one_row_a_sample(traits).where(F.col("value").isNotNull()).hint("merge"), "sample")
    group = lambda here: [f(F.when(F.col("present") == here, F.col("value"))) for f in (F.count, F.avg, F.var_samp)]
    names = ["n1", "m1", "v1", "n2", "m2", "v2"]
    by = joined.groupBy("gene").agg(*[c.alias(n) for c, n in zip(group(True) + group(False), names, strict=True)])
    rows = by.withColumns(stats.welch(*[F.col(n) for n in names]))
    half = F.lit(0.5)
    rows = rows.withColumn("p", stats.betai(F.col("df") / 2, half, F.col("df") / (F.col("df") + F.col("t") * F.col("t"))))
    rows = stats.bonferroni(stats.benjamini_hochberg(rows, "p", "gene"), "p")
    return rows.withColumnsRenamed({"m1": "mean_present", "m2": "mean_absent", "n1": "n_present", "n2": "n_absent"}).drop("v1", "v2")


def match_samples(matrix: DataFrame, meta: DataFrame) -> DataFrame:
    """sample, in_matrix, in_meta over both sides."""
    left = matrix.select("sample").distinct().withColumn("in_matrix", F.lit(True))
    right = meta.select("sample").distinct().withColumn("in_meta", F.lit(True))
    return left.join(right.hint("merge"), "sample", "full").select("sample", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_matrix", "in_meta")])


def column_kinds(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (name, distinct, kind): constant, binary (two values), numeric or text, from one pass.

    Blank values do not count. A column with two values is binary even if they are numbers.
    """
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns])).alias("x")).select("x.*").where("v <> ''")
    by = long.groupBy("name").agg(F.count_distinct("v").alias("distinct"), F.count_if(F.col("v").try_cast("double").isNull()).alias("words"))
    every = table.sparkSession.createDataFrame([(c,) for c in columns], "name string").join(by, "name", "left")
    n = F.coalesce("distinct", F.lit(0))
    kind = F.when(n < 2, "constant").when(n == 2, "binary").when(F.col("words") == 0, "numeric").otherwise("text")
    return every.select("name", n.alias("distinct"), kind.alias("kind"))


def volcano(rows: DataFrame) -> DataFrame:
    """gene, x (log2 odds ratio within 9), y (-log10 p)."""
    x = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), F.log2("odds_ratio")))
    return rows.select("gene", x.alias("x"), (-F.log10(F.greatest("p", F.lit(1e-300)))).alias("y"))


def ranked_bars(rows: DataFrame, p: str = "p", most: int = 400) -> DataFrame:
    """gene, y (-log10 p) of the tests with a finite p, by p: a top-k."""
    finite = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    return finite.orderBy(p, "gene").limit(most).select("gene", (-F.log10(F.greatest(F.col(p), F.lit(1e-300)))).alias("y"))


def ranked(rows: DataFrame, most: int = 150) -> DataFrame:
    """Rows by p, tests that failed last: a top-k."""
    return rows.orderBy(F.col("p").asc_nulls_last(), "gene").limit(most)


def significant(rows: DataFrame, fdr: float = 0.05, by: str = "q") -> DataFrame:
    """Rows at or under the level: by the false discovery rate, or with ``by="cmh_p"`` by the raw stratified p."""
    return rows.where(F.col(by) <= fdr)


def group_counts(presence: DataFrame) -> DataFrame:
    """gene, carriers, samples, variable."""
    by = presence.groupBy("gene").agg(F.count_if("present").alias("carriers"), F.count(F.lit(1)).alias("samples"))
    return by.withColumn("variable", (F.col("carriers") > 0) & (F.col("carriers") < F.col("samples")))
