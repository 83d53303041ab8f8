r"""Secret scanning with corpus-wide ownership frequency; DataFrame functions only.

Base kinds, leftmost and non-overlapping for each kind:

- ``assign``: a keyword, ``:`` or ``=`` and a value of 6 characters or more,
- ``access``: ``AKIA`` and capitals or digits, 20 characters or more in all,
- ``hex``: 24 lower-case hexadecimal digits or more.

The method looks at who owns a value. The hash of each candidate value is
aggregated over the corpus by distinct repositories (documents) and owners
(sources). A value that at most MAX_OWNERS owners have looks live; one that more
have is a widely copied example. Candidates of a further kind, ``vendor`` (tokens
with a known prefix), become spans if they look live. Base spans always stay.

Positions come from a replacement that puts a mark around each match: the parts
between marks alternate between text and match, and their lengths add up to the
positions, in code points. U+0001, the mark, is first replaced by U+0002, which no
pattern matches either, so positions hold for any text.

Texts are scanned once. Only lengths and matches go on, as a table in the shared
folder. A value that a third of all rows have is counted with partial sums and
met in salted shares.

Defined results: null counts as empty; a text without spans has zero counts, the
hash of the empty string and empty spans; rows that repeat an id are scanned
each; a null source is an owner of its own; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table

MARK, SPARE = "\x01", "\x02"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs: one of the least length or more is the same match as one of any length that is long enough.
KINDS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "vendor": r"(?:gh[opsu]|github_pat|sk_live|rk_live|glpat|xox[abprs]|npm|hf)[_-][A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
BASE = ("assign", "access", "hex")
MIN_VALUE = 6
MAX_OWNERS = 2
SALTS = 8


def _pieces(text: Column, pattern: str) -> Column:
    """The parts of the text between marks: length, and the match for every second part."""
    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")
    return F.transform(F.split(marked, MARK, -1), lambda p, i: F.struct(F.char_length(p).alias("n"), F.when(i % 2 == 1, p).alias("match")))


def scan(df: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Rows (row_no, doc_id, owner, found): for each kind with a match its pieces."""
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(SPARE))
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), text.alias("text"))
    found = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(kind).alias("kind"), _pieces(F.col("text"), p).alias("pieces")) for k, (kind, p) in enumerate(KINDS.items())])
    return rows.select("row_no", "doc_id", "owner", F.filter(found, lambda f: F.size(f["pieces"]) > 1).alias("found"))


def candidates(scanned: DataFrame) -> DataFrame:
    """Rows (row_no, doc_id, owner, rank, kind, start, stop, value): one for each match that holds."""
    kinds = scanned.where(F.size("found") > 0).select("row_no", "doc_id", "owner", F.explode("found").alias("f"))
    pieces = kinds.select("row_no", "doc_id", "owner", "f.rank", "f.kind", F.posexplode("f.pieces").alias("at", "piece"))
    upto = Window.partitionBy("row_no", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("stop", F.sum("piece.n").over(upto)).where("at % 2 = 1")
    value = F.when(F.col("kind") == "assign", F.regexp_extract("piece.match", ASSIGN, 2)).otherwise(F.col("piece.match"))
    placed = placed.select("row_no", "doc_id", "owner", "rank", "kind", (F.col("stop") - F.col("piece.n")).alias("start"), "stop", value.alias("value"))
    return placed.where(F.char_length("value") >= MIN_VALUE).withColumn("value", F.sha2("value", 256))


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value, repositories, owners) over the whole corpus."""
    in_doc = found.groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = in_doc.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    scanned = materialize(scan(df, id_col, text_col, owner_col), "scanned")
    found = materialize(candidates(scanned), "candidates")
    owned = ownership(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = found.withColumn("salt", F.pmod("row_no", F.lit(SALTS)).cast("int")).join(owned, ["value", "salt"])
    live, base = F.col("owners") <= max_owners, F.col("kind").isin(*BASE)
    span = F.struct("start", "rank", F.col("stop"), "kind")
    by_row = met.groupBy("row_no").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in BASE],
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(base | live, span)).alias("all"),
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_copied"),
        F.max("owners").alias("max_owners"),
        F.max("repositories").alias("max_repositories"),
    )
    counts = ["n_assign", "n_access", "n_hex", "n_live", "n_copied", "max_owners", "max_repositories"]
    out = scanned.select("row_no", "doc_id").join(by_row, "row_no", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts[:3]],
        F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts[3:]],
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    marked = "\nUNION ALL ".join(
        f"SELECT row_no, doc_id, source, {k} AS rank, '{kind}' AS kind, string_split(regexp_replace(t, {quoted('(' + p + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM doc"
        for k, (kind, p) in enumerate(KINDS.items())
    )
    return f"""
        WITH doc AS (SELECT row_number() OVER () AS row_no, doc_id, source, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
        marked AS ({marked}),
        piece AS (SELECT row_no, doc_id, source, rank, kind, unnest(range(len(parts))) AS k, unnest(parts) AS p FROM marked WHERE len(parts) > 1),
        placed AS (SELECT *, (sum(length(p)) OVER (PARTITION BY row_no, rank ORDER BY k))::BIGINT AS stop FROM piece),
        found AS (
            SELECT *, stop - length(p) AS start, CASE WHEN kind = 'assign' THEN regexp_extract(p, {quoted(ASSIGN)}, 2) ELSE p END AS v
            FROM placed WHERE k % 2 = 1),
        kept AS (SELECT * FROM found WHERE length(v) >= {MIN_VALUE}),
        owned AS (SELECT v, count(DISTINCT coalesce(doc_id, -1)) AS repositories, count(DISTINCT coalesce(source, chr(0))) AS owners FROM kept GROUP BY v),
        met AS (SELECT *, kind || ':' || start || ':' || stop AS s FROM kept JOIN owned USING (v)),
        by_row AS (
            SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(s, ',' ORDER BY start, rank) FILTER (kind <> 'vendor') AS base,
                   string_agg(s, ',' ORDER BY start, rank) FILTER (kind <> 'vendor' OR owners <= {MAX_OWNERS}) AS spans,
                   count(*) FILTER (owners <= {MAX_OWNERS}) AS n_live, count(*) FILTER (owners > {MAX_OWNERS}) AS n_copied,
                   max(owners) AS max_owners, max(repositories) AS max_repositories
            FROM met GROUP BY row_no)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
               coalesce(n_copied, 0) AS n_copied, coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories
        FROM doc LEFT JOIN by_row USING (row_no)"""


QUERIES = {"op9_secrets": op9_secrets}
ORACLES = {"op9_secrets": _oracle()}
