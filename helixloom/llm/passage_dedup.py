"""Removal of repeated passages word by word, by winnowing; DataFrame functions only.

A word goes exactly if it lies in a run of ``min_words`` words or more that
occurs at an earlier position too, by (doc_id, word). Lines play no part: a
passage inside one line, or across line ends, counts like any other, and a text
without newlines is treated like one with them.

Select. A window is ``min_words`` words. Places at which a shingle of GRAM words
may be its fingerprint are those whose first word has a hash divisible by ANCHOR,
and, where a whole window has none, all of its places, which rank behind. The
least shingle of a window is its fingerprint: a guaranteed one, as equal windows
hold equal places. Neighbouring windows mostly share their minimum, so a text
keeps about one place for each ``min_words`` / 2 words, with the span of windows
that it stands for.

Join and extend. Only spans whose fingerprint lies at two places or more go on.
Spans whose words are all equal are settled as a whole: all but the first are
repeated. Where one fingerprint stands in different words, the first span of each
kind is extended both ways, window by window, and all but the first window with
equal words are repeated. Repeated windows that touch or overlap make maximal
runs. What has no partner is dropped early by filters of bounded size, which may
let some of it pass but never drop anything else.

Delete. Texts are never shuffled for the search, but for those whose spans need
the extension; and only texts that hold a run meet their runs, found by a filter
of bounded size, while all others pass straight through. A fingerprint or key
that a third of all rows have is only counted, with partial sums; its rows are
never brought together.

Of the space around a deleted run the one before it stays if the run began a line
or the text, else the one after it. Defined results: null texts stay null and
count as empty; ids that are null come last in order; of rows that repeat id and
text each is treated as that one document; an empty table gives an empty result;
other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, may_hold, table
from helixloom.llm.line_dedup import BLANK, DOC, LAST_ID, MIN_WORDS, WORD

SPACES = r"[\x20\x09-\x0D]+"
TOKEN = r"[\x20\x09-\x0D]*" + WORD
GRAM, ANCHOR, SEGMENT = 8, 8, 2048
PLACE = (1 << 28) - 1  # more words than a segment has
FIRST_RANK, SECOND_RANK = -(1 << 63), (1 << 63) - 1
NEAR = 20  # a window rarely holds as many places


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _word_list(text: Column) -> Column:
    """The words of a text. Splitting at one plain character is several times as fast as at a pattern."""
    for c in BLANK[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _apart(c: Column) -> Column:
    """``c`` in a step of its own: the optimizer neither repeats it in filters that it moves nor merges it into later steps."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _segments(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` with (base, h), for their text: hashes of the words from ``base`` on, so many that SEGMENT windows begin in them.

    Only texts of min_words words have any. Rows with short arrays are cheap to copy and cut.
    """
    rest = [c for c in docs.columns if c != "text"]
    out = docs.select(*rest, _apart(F.transform(_word_list(F.col("text")), lambda w: F.xxhash64(w))).alias("h"))
    starts = F.when(F.size("h") >= min_words, F.sequence(F.lit(0), F.size("h") - min_words, F.lit(SEGMENT))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda k: F.struct(k.alias("base"), F.slice("h", k + 1, SEGMENT + min_words - 1).alias("h")))
    return out.select(*rest, F.inline(_apart(cut)))


def _hashed(first: Column, words: Column | int) -> Column:
    """One hash over ``words`` words from the word ``first`` on."""
    return F.xxhash64(F.slice("h", first + 1, words))


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE)).cast("int")


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc, text_hash, first, last, print, key): the windows, first to last, whose least shingle is at one place; key is over all their words."""
    width, n = min_words - GRAM + 1, F.size("h")
    none = F.array().cast("array<bigint>")

    def ranked(at: Column, by: Column) -> Column:
        # the place in the low bits: of equal shingles the first counts, and the place comes with the rank
        return by.bitwiseAND(F.lit(~PLACE)).bitwiseOR(at.cast("long"))

    out = _segments(docs, min_words)
    places = F.filter(F.sequence(F.lit(0), n - GRAM), lambda i: F.get("h", i).bitwiseAND(F.lit(ANCHOR - 1)) == 0)
    out = out.select(*DOC, "base", "h", F.concat(F.array(F.lit(-1)), places).alias("a"))

    def with_gap(p: Column, j: Column) -> Column:
        upto = F.coalesce(F.get("a", j + 1), n - GRAM + 1)
        own = F.when(p >= 0, F.array(ranked(p, _hashed(p, GRAM).bitwiseOR(F.lit(FIRST_RANK))))).otherwise(none)
        gap = F.transform(F.sequence(p + 1, upto - 1), lambda i: ranked(i, _hashed(i, GRAM).bitwiseAND(F.lit(SECOND_RANK))))
        return F.when(upto - p > width, F.concat(own, gap)).otherwise(own)

    out = out.select(*DOC, "base", "h", F.flatten(F.transform("a", with_gap)).alias("e"))
    crowded = F.filter("e", lambda x, j: _place(F.get("e", j + NEAR)) - _place(x) < width)
    out = out.select(*DOC, "base", "h", "e", F.when(F.size(crowded) > 0, F.lit(width)).otherwise(F.lit(NEAR)).alias("c"))

    def span(x: Column, j: Column) -> Column:
        c = F.col("c")
        left = F.try_element_at(F.filter(F.slice("e", F.greatest(j - c, F.lit(0)) + 1, F.least(c, j)), lambda y: y < x), F.lit(-1))
        right = F.get(F.filter(F.slice("e", j + 2, c), lambda y: y < x), 0)
        first = F.greatest(F.coalesce(_place(left), F.lit(-1)) + 1, _place(x) - width + 1, F.lit(0))
        last = F.least(_place(x), F.coalesce(_place(right), n - GRAM + 1) - width, n - min_words)
        return F.struct(first.alias("first"), last.alias("last"), _place(x).alias("at"))

    out = out.select(*DOC, "base", "h", F.filter(F.transform("e", span), lambda s: s["first"] <= s["last"]).alias("s"))
    spans = F.transform("s", lambda s: F.struct((F.col("base") + s["first"]).alias("first"), (F.col("base") + s["last"]).alias("last"), _hashed(s["at"], GRAM).alias("print"), _hashed(s["first"], s["last"] - s["first"] + min_words).alias("key")))
    return out.select(*DOC, F.inline(spans))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` occurs once: counts, as narrow partial sums, make a filter of bounded size."""
    twice = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("key")), f"repeated-{key}")
    return may_hold(rows, F.col(key), twice, "held").where("held").drop("held")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc, text_hash, runs): for each document with any, its repeated runs as sorted words (first, last).

    Of the rows with one key the least is its origin; all others are repeated. So a
    document's repeated rows are its rows without its origins, and no row has to
    meet the rows of its key: only (key, first place) is grouped, with partial sums.
    """
    if min_words < 2 * GRAM:
        raise ValueError(f"min_words must be at least {2 * GRAM}")
    place, least = F.xxhash64(*DOC), F.min(F.struct(*DOC, "first", "last"))
    spans = _repeated(materialize(fingerprints(docs, min_words), "passages"), "print")
    origins = materialize(spans.groupBy("print", "key").agg(least.alias("origin")).select("print", "origin.*"), "passage-origins")
    mixed = origins.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("print").alias("key"))
    # by chance an origin of a print with one key is extended too, which finds nothing
    reps = may_hold(origins, F.col("print"), materialize(mixed, "passage-mixed"), "held").where("held").groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    reps = materialize(reps, "passage-reps")
    held = may_hold(docs, place, reps.select(place.alias("key")), "held").where("held").drop("held")

    inside = F.filter("spans", lambda s: (s["first"] >= F.col("base")) & (s["first"] < F.col("base") + SEGMENT))  # a span lies in one segment

    def window(i: Column) -> Column:
        return F.struct(i.alias("first"), _hashed(i - F.col("base"), min_words).alias("window"))

    segments = _segments(held.join(reps, DOC), min_words).select(*DOC, "base", "h", inside.alias("spans"))
    wins = segments.select(*DOC, F.inline(F.flatten(F.transform("spans", lambda s: F.transform(F.sequence(s["first"], s["last"]), window)))))
    wins = _repeated(materialize(wins, "passage-windows"), "window").withColumn("last", F.col("first"))
    first_wins = wins.groupBy("window").agg(least.alias("origin")).select("origin.*")
    parts = [(spans, False), (origins, True), (wins, False), (first_wins, True)]
    rows = None
    for k, (part, origin) in enumerate(parts):
        part = part.select(*DOC, (F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")).alias("at"), F.lit(k // 2).alias("kind"), F.lit(origin).alias("origin"))
        rows = part if rows is None else rows.unionByName(part)

    def picked(kind: int, origin: bool) -> Column:
        return F.collect_set(F.when((F.col("kind") == kind) & (F.col("origin") == origin), F.col("at")))

    found = rows.groupBy(*DOC).agg(*[picked(kind, origin).alias(f"{'o' if origin else 'r'}{kind}") for kind in (0, 1) for origin in (False, True)])
    found = found.select(*DOC, F.array_sort(F.array_union(F.array_except("r0", "o0"), F.array_except("r1", "o1"))).alias("at")).where(F.size("at") > 0)
    both = F.transform("at", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("first"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("last")))
    found = found.select(*DOC, both.alias("s"))
    s = F.col("s")
    firsts = F.filter(s, lambda x, j: (j == 0) | (x["first"] > F.get(s, F.greatest(j - 1, F.lit(0)))["last"] + min_words))
    lasts = F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["first"] > x["last"] + min_words, F.lit(True)))
    runs = found.select(*DOC, firsts.alias("f"), lasts.alias("l"))
    return runs.select(*DOC, F.zip_with("f", "l", lambda a, b: F.struct(a["first"].alias("first"), (b["last"] + min_words - 1).alias("last"))).alias("runs"))


def _without(text: Column, tokens: Column, runs: Column) -> Column:
    """The text without the words of the runs; ``tokens`` are its words with the space before each."""

    def after(r: Column, j: Column) -> Column:
        upto = F.coalesce(F.get(runs, j + 1)["first"], F.size(tokens))
        kept = F.array_join(F.slice(tokens, r["last"] + 2, upto - r["last"] - 1), "")
        before = F.regexp_extract(F.get(tokens, r["first"]), SPACES, 0)
        return F.when((kept != "") & ((r["first"] == 0) | F.contains(before, F.lit("\n"))), F.concat(before, F.ltrim(kept, F.lit(BLANK)))).otherwise(kept)

    head = F.array_join(F.slice(tokens, 1, F.get(runs, F.lit(0))["first"]), "")
    tail = F.substring(text, F.length(F.rtrim(text, F.lit(BLANK))) + 1, F.length(text))
    return F.concat(head, F.array_join(F.transform(runs, after), ""), tail)


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, runs_col: str | None = None) -> DataFrame:
    """``df`` with the repeated runs of words taken out of the text; ``runs_col`` names a column for the runs taken."""
    free = "__run"
    while any(c.startswith(free) for c in df.columns):  # names that no column of df has
        free += "_"
    found = materialize(repeated_passages(_keys(df, id_col, text_col), min_words), "passage-runs")
    runs = found.select(F.col("doc").alias(f"{free}_doc"), F.col("text_hash").alias(f"{free}_hash"), F.col("runs").alias(f"{free}s"))
    doc, text_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = may_hold(df, F.xxhash64(doc, text_hash), found.select(F.xxhash64(*DOC).alias("key")), f"{free}_held")
    held, gone, tokens = F.col(f"{free}_held"), F.col(f"{free}s"), F.col(f"{free}_tokens")
    met = marked.where(held).join(runs, (doc == F.col(f"{free}_doc")) & (text_hash == F.col(f"{free}_hash")), "left")
    met = met.withColumn(f"{free}_tokens", F.when(gone.isNotNull(), F.regexp_extract_all(text_col, F.lit(TOKEN), F.lit(0))))
    text = F.when(gone.isNotNull(), _without(F.col(text_col), tokens, gone)).otherwise(F.col(text_col))
    more = [(runs_col, gone)] if runs_col else []
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    straight = marked.where(~held).select(*[F.col(f"`{c}`") for c in df.columns], *[F.lit(None).cast(runs.dtypes[2][1]).alias(c) for c, _ in more])
    return straight.union(met.select(*columns, *[x.alias(c) for c, x in more]))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)))
    out = passage_dedup(docs, runs_col="runs")
    gone = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.coalesce(F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["last"])), ","), F.lit(""))
    return out.select("doc_id", F.col("words").cast("long").alias("words"), gone.cast("long").alias("removed_words"), spans.alias("removed_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op6_passage_dedup": op6_passage_dedup}
ORACLES: dict[str, str] = {}
