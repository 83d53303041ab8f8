"""Removal of repeated runs of lines by winnowing; DataFrame functions only.

A line with text has a hash. From each line on, the shortest run of lines with
``min_words`` words or more is a window, and likewise up to each line. The
smallest line hash of a window is its fingerprint. A window that occurs twice
has the same fingerprint both times, so only windows whose fingerprint occurs at
two positions or more go on: their positions are joined by fingerprint and
content with the first occurrence, and all but the first are repeated. Repeated
windows that touch or overlap are extended to maximal runs, forwards and
backwards, and the runs are deleted.

So a line goes exactly if it lies in a run of lines with ``min_words`` words or
more that occurs at an earlier position too, by (doc_id, line); runs of one
document may overlap. Every such line lies in a window that starts or ends
within the run, which is why both kinds are taken. Empty lines inside a deleted
run go with it, others stay.

Only hashes are shuffled up to the last step, which joins the runs with the
texts on the document. A fingerprint or window that a third of all rows have is
counted with partial sums and joined in salted shares.

Defined results: null texts stay null and count as empty; ids that are null come
last in order; of rows that repeat id and text each is treated as that one
document; very long texts are handled line by line; an empty table gives an
empty result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table

BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
SALTS = 8
LAST_ID = (1 << 63) - 1
DOC = ["doc", "text_hash"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, text_hash, pos, words, a, b): the lines with text, a and b being two hashes of the line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(_lines(text)).alias("pos", "line"),
    )
    lines = lines.select(*DOC, "pos", F.regexp_count("line", F.lit(WORD)).alias("words"), F.btrim("line", F.lit(BLANK)).alias("line")).where("words > 0")
    hashed = lines.select(*DOC, "pos", "words", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))
    return hashed.repartition(*DOC).dropDuplicates([*DOC, "pos"])


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc, text_hash, first, last, pos_first, pos_last, key_a, key_b, print, place).

    ``first`` and ``last`` count lines with text; ``print`` is the smallest line hash and
    ``place`` stands for where it is.
    """
    doc = Window.partitionBy(*DOC)
    upto = F.sum("words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    at = lines.withColumn("stop", upto).withColumn("start", F.col("stop") - F.col("words"))
    at = at.withColumn("n", F.row_number().over(doc.orderBy("pos")))
    line = F.struct("a", "b", "n", "pos")
    forward, backward = doc.orderBy("start").rangeBetween(0, min_words - 1), doc.orderBy("stop").rangeBetween(1 - min_words, 0)
    at = at.select(*DOC, "n", "start", "stop", F.collect_list(line).over(forward).alias("f"), F.max("stop").over(forward).alias("f_stop"), F.collect_list(line).over(backward).alias("g"), F.min("start").over(backward).alias("g_start"))
    long_f = F.when(F.col("f_stop") - F.col("start") >= min_words, F.col("f"))
    long_g = F.when((F.col("stop") - F.col("g_start") >= min_words) & (F.size("g") > 1), F.col("g"))
    runs = at.select(*DOC, F.explode(F.array_compact(F.array(long_f, long_g))).alias("w"))
    least = F.array_min("w")
    return runs.select(
        *DOC,
        F.element_at("w", 1)["n"].alias("first"),
        F.element_at("w", -1)["n"].alias("last"),
        F.element_at("w", 1)["pos"].alias("pos_first"),
        F.element_at("w", -1)["pos"].alias("pos_last"),
        F.xxhash64(F.col("w")["a"]).alias("key_a"),
        F.xxhash64(F.lit(7), F.col("w")["b"]).alias("key_b"),
        least["a"].alias("print"),
        F.xxhash64(*DOC, least["n"]).alias("place"),
    )


def _salted(many: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of many rows a key with one row a key, in salted shares."""
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = many.withColumn("salt", F.pmod(F.xxhash64("place", "first"), F.lit(SALTS)).cast("int"))
    return many.join(one, [*on, "salt"]).drop("salt")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc, text_hash, runs): for each document with any, its repeated runs as sorted positions (first, last)."""
    wins = materialize(windows(lines, min_words), "windows")
    prints = wins.groupBy("print").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y").select("print")
    shared = _salted(wins, prints, ["print"])
    origin = F.struct(*DOC, "first")
    origins = shared.groupBy("print", "key_a", "key_b").agg(F.min(origin).alias("origin"))
    found = _salted(shared, origins, ["print", "key_a", "key_b"]).where(origin > F.col("origin"))
    doc = Window.partitionBy(*DOC).orderBy("first", "last")
    before = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    found = found.select(*DOC, "first", "last", "pos_first", "pos_last").withColumn("new", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(1)))
    found = found.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = found.groupBy(*DOC, "run").agg(F.min("pos_first").alias("first"), F.max("pos_last").alias("last"))
    return runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _without(text: Column, runs: Column) -> Column:
    """The text without the lines of the runs."""
    lines = _lines(text)
    ends = F.concat(F.array(F.lit(-1)), runs["last"])
    nexts = F.concat(runs["first"], F.array(F.size(lines)))
    spans = F.transform(F.arrays_zip(ends.alias("end"), nexts.alias("next")), lambda s: F.slice(lines, s["end"] + 2, s["next"] - s["end"] - 1))
    return F.array_join(F.flatten(spans), "\n")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, runs_col: str | None = None) -> DataFrame:
    """``df`` with the repeated runs taken out of the text; ``runs_col`` names a column for the runs taken."""
    free = "__run"
    while any(c.startswith(free) for c in df.columns):  # names that no column of df has
        free += "_"
    found = repeated_runs(line_hashes(df, id_col, text_col), min_words)
    runs = found.select(F.col("doc").alias(f"{free}_doc"), F.col("text_hash").alias(f"{free}_hash"), F.col("runs").alias(f"{free}s"))
    key = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)) == F.col(f"{free}_doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(f"{free}_hash"))
    met, gone = df.join(runs, key, "left"), F.col(f"{free}s")
    text = F.when(gone.isNotNull(), _without(F.col(text_col), gone)).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return met.select(*columns, *([gone.alias(runs_col)] if runs_col else []))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("before", F.size(_lines(F.coalesce("text", F.lit("")))))
    out = line_dedup(docs, runs_col="runs")
    gone = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.coalesce(F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["last"])), ","), F.lit(""))
    return out.select("doc_id", F.col("before").cast("long").alias("lines"), gone.cast("long").alias("removed_lines"), spans.alias("removed_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {
    # Words before each line give the windows as ranges; a window is known by its text here, not by hashes.
    "op6_line_dedup": r"""
        WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        line AS (
            SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM doc),
        worded AS (
            SELECT doc_id, pos, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM line WHERE t <> ''),
        placed AS (
            SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS stop,
                   row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM worded),
        started AS (SELECT *, stop - words AS start FROM placed),
        framed AS (
            SELECT doc_id, list(t) OVER f AS ft, min(n) OVER f AS fa, max(n) OVER f AS fb, max(stop) OVER f - start AS fw,
                   min(pos) OVER f AS fpa, max(pos) OVER f AS fpb,
                   list(t) OVER g AS gt, min(n) OVER g AS ga, max(n) OVER g AS gb, stop - min(start) OVER g AS gw,
                   min(pos) OVER g AS gpa, max(pos) OVER g AS gpb
            FROM started
            WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
                   g AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
        win AS (
            SELECT doc_id, ft AS content, fa AS a, fpa AS pa, fpb AS pb FROM framed WHERE fw >= 50
            UNION SELECT doc_id, gt, ga, gpa, gpb FROM framed WHERE gw >= 50),
        ranked AS (SELECT *, min((doc_id, a)) OVER (PARTITION BY content) AS origin FROM win),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pa, pb + 1)) AS pos FROM ranked WHERE (doc_id, a) > origin),
        -- lines without text between two deleted runs go if the runs are neighbours
        blank AS (
            SELECT l.doc_id, l.pos, (SELECT max(p.pos) FROM placed p WHERE p.doc_id = l.doc_id AND p.pos < l.pos) AS prev,
                   (SELECT min(p.pos) FROM placed p WHERE p.doc_id = l.doc_id AND p.pos > l.pos) AS next
            FROM line l WHERE l.t = ''),
        all_gone AS (
            SELECT doc_id, pos FROM gone
            UNION SELECT b.doc_id, b.pos FROM blank b JOIN gone x ON x.doc_id = b.doc_id AND x.pos = b.prev
                  JOIN gone y ON y.doc_id = b.doc_id AND y.pos = b.next),
        islands AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM all_gone),
        runs AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM islands GROUP BY doc_id, island),
        spans AS (SELECT doc_id, sum(b - a + 1) AS removed, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_runs FROM runs GROUP BY doc_id),
        kept AS (
            SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS text
            FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw FROM doc) l
            ANTI JOIN all_gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
        SELECT d.doc_id, len(d.ls) AS lines, coalesce(s.removed, 0)::BIGINT AS removed_lines,
               coalesce(s.removed_runs, '') AS removed_runs, sha256(coalesce(k.text, '')) AS text_sha256
        FROM doc d LEFT JOIN spans s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
}
