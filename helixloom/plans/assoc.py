"""Queries on association, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions import stats
from helixloom.functions.sequence import quantized
from helixloom.operators import assoc
from helixloom.plans.inputs import PRESENCE, TRAITS, presence, table, traits, with_views


def _inputs(spark, sf_dir):
    return presence(spark, sf_dir), traits(spark, sf_dir)


def _rounded(df, *columns, digits=6):
    return df.select(*[quantized(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def contingency(spark, sf_dir):
    return assoc.contingency(*_inputs(spark, sf_dir))


def stratified_tables(spark, sf_dir):
    return assoc.stratified(*_inputs(spark, sf_dir))


def fisher(spark, sf_dir):
    return _rounded(stats.fisher_exact(assoc.contingency(*_inputs(spark, sf_dir)), "gene"), "p")


def odds_ratio_ci(spark, sf_dir):
    tables = assoc.contingency(*_inputs(spark, sf_dir))
    return _rounded(tables.select("gene", *[c.alias(n) for n, c in stats.odds_ratio(*[F.col(x) for x in "abcd"]).items()]), "odds_ratio", "ci_lo", "ci_hi")


def welch_t(spark, sf_dir):
    rows = assoc.continuous_scan(*_inputs(spark, sf_dir))
    return _rounded(rows.select("gene", "n_present", "n_absent", "mean_diff", "t", "df"), "mean_diff", "t", "df", digits=4)


def cmh(spark, sf_dir):
    return _rounded(stats.mantel_haenszel(assoc.stratified(*_inputs(spark, sf_dir)), "gene"), "chi2", "or_mh")


def _scan(spark, sf_dir):
    return assoc.binary_scan(*_inputs(spark, sf_dir), with_strata=False)


def bh_fdr(spark, sf_dir):
    return _rounded(_scan(spark, sf_dir).select("gene", "q"), "q")


def bonferroni(spark, sf_dir):
    return _rounded(_scan(spark, sf_dir).select("gene", "q_bonf"), "q_bonf")


def assoc_scan(spark, sf_dir):
    return _rounded(assoc.ranked(_scan(spark, sf_dir)), "p", "q", "q_bonf", "odds_ratio", "ci_lo", "ci_hi")


def assoc_scan_stratified(spark, sf_dir):
    return _rounded(assoc.binary_scan(*_inputs(spark, sf_dir)).select("gene", "p", "q", "cmh_p", "or_mh", "strata_used"), "p", "q", "cmh_p", "or_mh")


def assoc_scan_continuous(spark, sf_dir):
    rows = _rounded(assoc.continuous_scan(*_inputs(spark, sf_dir)), "mean_present", "mean_absent", "mean_diff", digits=8)  # few ties: values are cents
    return _rounded(_rounded(rows, "t", "df", digits=4), "p", "q", "q_bonf")


def volcano_points(spark, sf_dir):
    return _rounded(assoc.volcano(_scan(spark, sf_dir)), "x", "y")


def significance_count(spark, sf_dir):
    return assoc.significant(_scan(spark, sf_dir), fdr=0.5).agg(F.count(F.lit(1)).alias("significant"))


def carrier_counts(spark, sf_dir):
    return assoc.group_counts(presence(spark, sf_dir))


def sample_matching(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample"))
    return assoc.match_samples(buyers, traits(spark, sf_dir).where("value > 0"))


def column_kinds(spark, sf_dir):
    return assoc.column_kinds(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", "l_tax"])


QUERIES = {
    f.__name__: f
    for f in (
        contingency, stratified_tables, fisher, odds_ratio_ci, welch_t, cmh, bh_fdr, bonferroni, assoc_scan, assoc_scan_stratified, assoc_scan_continuous,
        volcano_points, significance_count, carrier_counts, sample_matching, column_kinds,
    )
}


def _q(x: str, digits: int = 6) -> str:
    return f"floor({x} * 1e{digits} + 0.5) / 1e{digits}"


CELLS = "count(*) FILTER (present AND is_case) AS a, count(*) FILTER (present AND NOT is_case) AS b, count(*) FILTER (NOT present AND is_case) AS c, count(*) FILTER (NOT present AND NOT is_case) AS d"
TABLES = f"v_tab AS (SELECT gene, {CELLS} FROM v_pa JOIN v_trait USING (sample) GROUP BY gene)"
STRATA = f"v_strata AS (SELECT gene, stratum, {CELLS} FROM v_pa JOIN v_trait USING (sample) GROUP BY gene, stratum)"
LC = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0))"
FISHER = f"""v_k AS (SELECT *, unnest(range(greatest(0, (a + b) - (b + d)), least(a + b, a + c) + 1)) AS k FROM v_tab),
    v_lp AS (SELECT gene, {LC.format("(a + c)", "k")} + {LC.format("(b + d)", "(a + b - k)")} - {LC.format("(a + b + c + d)", "(a + b)")} AS lp,
                    {LC.format("(a + c)", "a")} + {LC.format("(b + d)", "b")} - {LC.format("(a + b + c + d)", "(a + b)")} AS seen FROM v_k),
    v_fisher AS (SELECT t.gene, a, b, c, d, CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1.0 ELSE least(1.0, s.p) END AS p
                 FROM v_tab t LEFT JOIN (SELECT gene, sum(exp(lp)) AS p FROM v_lp WHERE lp <= seen + 1e-9 GROUP BY gene) s USING (gene)),
    v_or AS (SELECT *, ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) AS lor, sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)) AS se FROM v_fisher),
    v_bh AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)) AS q, least(1.0, p * m) AS q_bonf
             FROM (SELECT *, row_number() OVER (ORDER BY p, gene) AS rank, count(*) OVER () AS m FROM v_or))"""
V = (PRESENCE, TRAITS, TABLES)
Z = "1.959963984540054"
WELCH = """v_groups AS (SELECT gene, count(*) FILTER (present) AS n1, avg(value) FILTER (present) AS m1, var_samp(value) FILTER (present) AS v1,
        count(*) FILTER (NOT present) AS n2, avg(value) FILTER (NOT present) AS m2, var_samp(value) FILTER (NOT present) AS v2 FROM v_pa JOIN v_trait USING (sample) GROUP BY gene),
    v_t AS (SELECT *, (m1 - m2) / sqrt(s1 + s2) AS t, (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS df FROM (SELECT *, v1 / n1 AS s1, v2 / n2 AS s2 FROM v_groups)),
    v_y AS (SELECT *, t * t / (df + t * t) AS y FROM v_t),
    v_series AS (SELECT gene, sum(exp(lgamma(0.5 + df / 2 + k) - lgamma(0.5 + df / 2) - lgamma(1.5 + k) + lgamma(1.5) + k * ln(y))) AS total
        FROM (SELECT gene, df, y, unnest(range(400)) AS k FROM v_y WHERE y > 0) GROUP BY gene),
    v_p AS (SELECT v_y.*, CASE WHEN y > 0 THEN 1 - 2 * exp(lgamma(0.5 + df / 2) - lgamma(0.5) - lgamma(df / 2) + 0.5 * ln(y) + df / 2 * ln(1 - y)) * total WHEN y = 0 THEN 1 END AS p FROM v_y LEFT JOIN v_series USING (gene)),
    v_adjusted AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC)) AS q, least(1.0, p * m) AS q_bonf FROM (SELECT *, row_number() OVER (ORDER BY p, gene) AS rank, count(p) OVER () AS m FROM v_p))"""
CI = f"{_q('exp(lor)')} AS odds_ratio, {_q(f'exp(lor - {Z} * se)')} AS ci_lo, {_q(f'exp(lor + {Z} * se)')} AS ci_hi"
ORACLES = {
    "contingency": with_views("SELECT * FROM v_tab", *V),
    "stratified_tables": with_views("SELECT * FROM v_strata", PRESENCE, TRAITS, STRATA),
    "fisher": with_views(f"SELECT gene, {_q('p')} AS p FROM v_fisher", *V, FISHER),
    "odds_ratio_ci": with_views(f"SELECT gene, {CI} FROM v_or", *V, FISHER),
    "welch_t": with_views(
        f"""WITH s AS (SELECT gene, count(*) FILTER (present) AS n1, avg(value) FILTER (present) AS m1, var_samp(value) FILTER (present) AS v1,
                   count(*) FILTER (NOT present) AS n2, avg(value) FILTER (NOT present) AS m2, var_samp(value) FILTER (NOT present) AS v2 FROM v_pa JOIN v_trait USING (sample) GROUP BY gene),
        w AS (SELECT *, v1 / n1 AS s1, v2 / n2 AS s2 FROM s)
        SELECT gene, n1 AS n_present, n2 AS n_absent, {_q("(m1 - m2)", 4)} AS mean_diff, {_q("((m1 - m2) / sqrt(s1 + s2))", 4)} AS t,
               {_q("((s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)))", 4)} AS df FROM w""",
        PRESENCE, TRAITS,
    ),
    "cmh": with_views(
        f"""WITH h AS (SELECT *, (a + b + c + d)::DOUBLE AS n, (a + b)::DOUBLE AS r1, (a + c)::DOUBLE AS c1 FROM v_strata),
        s AS (SELECT gene, sum(a) AS sa, sum(r1 * c1 / n) AS se, sum(r1 * c1 * (n - r1) * (n - c1) / (n * n * (n - 1))) AS sv, sum(a * d / n) AS num, sum(b * c / n) AS den, count(*) AS used
              FROM h WHERE n > 0 AND c1 > 0 AND c1 < n AND r1 > 0 AND r1 < n GROUP BY gene)
        SELECT gene, {_q("(pow(abs(sa - se) - CASE WHEN abs(sa - se) >= 0.5 THEN 0.5 ELSE 0 END, 2) / sv)")} AS chi2, {_q("(num / den)")} AS or_mh, used AS strata_used FROM s""",
        PRESENCE, TRAITS, STRATA,
    ),
    "assoc_scan_stratified": with_views(
        f"""WITH h AS (SELECT *, (a + b + c + d)::DOUBLE AS n, (a + b)::DOUBLE AS r1, (a + c)::DOUBLE AS c1 FROM v_strata),
        s AS (SELECT gene, sum(a) AS sa, sum(r1 * c1 / n) AS se, sum(r1 * c1 * (n - r1) * (n - c1) / (n * n * (n - 1))) AS sv, sum(a * d / n) AS num, sum(b * c / n) AS den, count(*) AS used
              FROM h WHERE n > 0 AND c1 > 0 AND c1 < n AND r1 > 0 AND r1 < n GROUP BY gene),
        z AS (SELECT gene, sqrt(pow(abs(sa - se) - CASE WHEN abs(sa - se) >= 0.5 THEN 0.5 ELSE 0 END, 2) / sv / 2) AS z, num / den AS or_mh, used FROM s),
        e AS (SELECT gene, sum(exp((2 * k + 1) * ln(z) + 2 * k * ln(2) + lgamma(k + 1.0) - lgamma(2 * k + 2.0))) AS total FROM (SELECT gene, z, unnest(range(400)) AS k FROM z WHERE z > 0) GROUP BY gene)
        SELECT gene, {_q("p")} AS p, {_q("q")} AS q, {_q("CASE WHEN z > 0 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * total WHEN z = 0 THEN 1 END")} AS cmh_p, {_q("or_mh")} AS or_mh, coalesce(used, 0) AS strata_used
        FROM v_bh LEFT JOIN z USING (gene) LEFT JOIN e USING (gene)""",
        *V, STRATA, FISHER,
    ),
    "assoc_scan_continuous": with_views(
        f"""SELECT gene, n1 AS n_present, {_q("m1", 8)} AS mean_present, n2 AS n_absent, {_q("m2", 8)} AS mean_absent, {_q("(m1 - m2)", 8)} AS mean_diff, {_q("t", 4)} AS t, {_q("df", 4)} AS df,
               {_q("p")} AS p, {_q("q")} AS q, {_q("q_bonf")} AS q_bonf FROM v_adjusted""",
        PRESENCE, TRAITS, WELCH,
    ),
    "bh_fdr": with_views(f"SELECT gene, {_q('q')} AS q FROM v_bh", *V, FISHER),
    "bonferroni": with_views(f"SELECT gene, {_q('q_bonf')} AS q_bonf FROM v_bh", *V, FISHER),
    "assoc_scan": with_views(f"SELECT gene, a, b, c, d, {_q('p')} AS p, {_q('q')} AS q, {_q('q_bonf')} AS q_bonf, {CI} FROM v_bh", *V, FISHER),
    "volcano_points": with_views(f"SELECT gene, {_q('greatest(-9.0, least(9.0, lor / ln(2)))')} AS x, {_q('(-log10(greatest(p, 1e-300)))')} AS y FROM v_or", *V, FISHER),
    "significance_count": with_views("SELECT count(*) AS significant FROM v_bh WHERE q <= 0.5", *V, FISHER),
    "carrier_counts": with_views("SELECT gene, count(*) FILTER (present) AS carriers, count(*) AS samples, count(*) FILTER (present) BETWEEN 1 AND count(*) - 1 AS variable FROM v_pa GROUP BY gene", PRESENCE),
    "sample_matching": with_views(
        """WITH m AS (SELECT DISTINCT o_custkey AS sample, true AS x FROM orders), t AS (SELECT sample, true AS y FROM v_trait WHERE value > 0)
        SELECT sample, coalesce(x, false) AS in_matrix, coalesce(y, false) AS in_meta FROM m FULL JOIN t USING (sample)""",
        TRAITS,
    ),
    "column_kinds": """
        WITH x AS (SELECT 'l_returnflag' AS name, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL
                   SELECT 'l_quantity', l_quantity::VARCHAR FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem UNION ALL SELECT 'l_tax', l_tax::VARCHAR FROM lineitem),
        s AS (SELECT name, count(DISTINCT v) AS "distinct", count(*) FILTER (try_cast(v AS DOUBLE) IS NULL) AS words FROM x WHERE trim(v) <> '' GROUP BY name)
        SELECT name, "distinct", CASE WHEN "distinct" < 2 THEN 'constant' WHEN "distinct" = 2 THEN 'binary' WHEN words = 0 THEN 'numeric' ELSE 'text' END AS kind FROM s""",
}
