"""Statistics for association tests: column expressions, and Arrow functions where Spark has none."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from helixloom.session import materialize

Z95 = 1.959963984540054
LOG_SLACK = 1e-9


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series, four steps up the recurrence; one short expression, for code generation."""
    y = x + 4.0
    square = 1.0 / (y * y)
    series = (1 / 12.0 - square * (1 / 360.0 - square * (1 / 1260.0 - square * (1 / 1680.0 - square * (1 / 1188.0))))) / y
    return (y - 0.5) * F.ln(y) - y + (0.5 * math.log(2 * math.pi)) + series - F.ln(x * (x + 1.0) * (x + 2.0) * (x + 3.0))


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def fisher_exact(tables: DataFrame, key: str, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Two-sided p of each table: the sum over all tables with its margins that are not likelier. 1 if a margin is empty.

    The tables of one key are its rows here, so a very wide margin is spread over tasks with partial sums.
    """
    A, B, C, D = (F.col(x).cast("double") for x in (a, b, c, d))
    row, col, other = A + B, A + C, B + D
    n = row + C + D
    low, high = F.greatest(F.lit(0.0), row - other), F.least(row, col)
    held = tables.where((row > 0) & (C + D > 0) & (col > 0) & (other > 0)).select(key, A.alias("a"), row.alias("row"), col.alias("col"), other.alias("other"), low.cast("long").alias("low"), high.cast("long").alias("high"), n.alias("n"))
    held = held.select("*", log_choose(F.col("n"), F.col("row")).alias("total"))
    held = held.select("*", (log_choose(F.col("col"), F.col("a")) + log_choose(F.col("other"), F.col("row") - F.col("a")) - F.col("total")).alias("seen"))
    steps = held.select(key, "row", "col", "other", "total", "seen", F.explode(F.sequence("low", "high")).alias("k"))
    log_p = log_choose(F.col("col"), F.col("k").cast("double")) + log_choose(F.col("other"), F.col("row") - F.col("k")) - F.col("total")
    sums = steps.select(key, log_p.alias("log_p"), "seen").where(F.col("log_p") <= F.col("seen") + LOG_SLACK).groupBy(key).agg(F.sum(F.exp("log_p")).alias("p"))
    return tables.select(key).join(sums, key, "left").select(key, F.least(F.lit(1.0), F.coalesce("p", F.lit(1.0))).alias("p"))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Odds ratio with half a count added to each cell, and its 95 % interval."""
    A, B, C, D = (x.cast("double") + 0.5 for x in (a, b, c, d))
    log_or = F.ln(A * D / (B * C))
    se = F.sqrt(1 / A + 1 / B + 1 / C + 1 / D)
    return {"odds_ratio": F.exp(log_or), "ci_lo": F.exp(log_or - Z95 * se), "ci_hi": F.exp(log_or + Z95 * se)}


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not x > 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def betai(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else incomplete_beta(p, q, v) for p, q, v in zip(a, b, x, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi_square_sf1(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return pd.Series([None if pd.isna(v) else math.erfc(math.sqrt(max(0.0, v) / 2)) for v in x], dtype="float64")


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> dict[str, Column]:
    """Welch's t and degrees of freedom; null with fewer than two values in a group or no spread."""
    s1, s2 = v1 / n1, v2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (s1 + s2 > 0)
    t = F.when(ok, (m1 - m2) / F.sqrt(s1 + s2))
    df = F.when(ok, (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)))
    return {"mean_diff": F.when(ok, m1 - m2), "t": t, "df": df}


def mantel_haenszel(strata: DataFrame, key: str, continuity: bool = True) -> DataFrame:
    """Rows (key, chi2, or_mh, strata_used) from rows (key, a, b, c, d) of strata; only informative strata count.

    Strata are summed with partial sums; a zero denominator gives an infinite ratio.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n, row, col = a + b + c + d, a + b, a + c
    held = strata.where((n > 0) & (col > 0) & (col < n) & (row > 0) & (row < n))
    sums = held.groupBy(key).agg(
        F.sum(a).alias("sum_a"), F.sum(row * col / n).alias("sum_e"), F.sum(row * col * (n - row) * (n - col) / (n * n * (n - 1))).alias("sum_v"),
        F.sum(a * d / n).alias("num"), F.sum(b * c / n).alias("den"), F.count(F.lit(1)).alias("used"),
    )
    diff = F.abs(F.col("sum_a") - F.col("sum_e"))
    correction = F.when(diff >= 0.5, 0.5).otherwise(0.0) if continuity else F.lit(0.0)
    usable = F.col("sum_v") > 0
    return strata.select(key).distinct().join(sums, key, "left").select(
        key, F.when(usable, F.pow(diff - correction, F.lit(2.0)) / F.col("sum_v")).alias("chi2"),
        F.when(usable, F.coalesce(F.try_divide("num", "den"), F.lit(float("inf")))).alias("or_mh"), F.when(usable, F.col("used")).otherwise(0).cast("long").alias("strata_used"),
    )


def benjamini_hochberg(rows: DataFrame, p: str, tie: str, out: str = "q") -> DataFrame:
    """Adds the step-up false discovery rate over rows with a finite p; others get null.

    The adjusted value is a running minimum over the ranks. Ranks come from counted distinct
    p, so the one ordered window holds distinct values, not rows; ``tie`` orders equal p.
    The rows are written first: both sides of the join on p must see one and the same p, and
    sums that are computed twice can differ in their last bit.
    """
    rows = materialize(rows, "tests")
    finite = F.col(p).isNotNull() & ~F.isnan(p)
    counted = rows.where(finite).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("__p", upto.alias("rank"), F.sum("n").over(Window.partitionBy()).alias("m"))
    # among equal p the last rank gives the smallest value, which the running minimum hands to the others
    back = Window.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    q = ranked.select("__p", F.least(F.lit(1.0), F.min(F.col("__p") * F.col("m") / F.col("rank")).over(back)).alias(out))
    return rows.join(q, F.col(p) == F.col("__p"), "left").drop("__p")


def bonferroni(rows: DataFrame, p: str, out: str = "q_bonf") -> DataFrame:
    """Adds p times the number of finite p, at most 1."""
    m = rows.agg(F.greatest(F.count_if(F.col(p).isNotNull() & ~F.isnan(p)), F.lit(1)).alias("__m"))
    return rows.crossJoin(F.broadcast(m)).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("__m"))).drop("__m")
