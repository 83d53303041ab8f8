r"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers expand and validate them.

One automaton over the text finds all anchors at once: at-signs, plus signs, digits, ``://`` and cue words. From an
anchor a parser for its kind walks outwards to the boundaries and checks what it holds:

- ``email``: left over the local part, right over two or more labels,
- ``ip``: four numbers of at most 255,
- ``card``: digits with single spaces or hyphens between them, 14 to 19 of them, which pass the Luhn check,
- ``phone``: ``+`` and 10 to 15 digits up to the last digit of its run,
- ``login``: an address ``scheme://user[:password]@host[:port]``,
- ``iban``: after the cue, a country account number whose remainder by 97 is one,
- ``account``: after the cue, 6 to 17 digits.

The first four are the base kinds: leftmost and non-overlapping for each kind, and what fails its check is dropped
without another try from within it. The last three are what the method adds.

No parser reads back over what it has already taken, so a text takes time by its length; texts are scanned one by one
in Arrow batches, and nothing is shuffled. Positions are in code points, end exclusive.

Defined results: null counts as empty; a text without spans has an empty list, zero counts and the hash of the empty
string; rows that repeat an id are scanned each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
NUMBERS = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
DIGITS = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
AUTHORITY = r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?"
#: What stands before an account number; group 1 is the number, at the end of the match.
IBAN = r"(?i:iban)[\x20.:#-]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)"
ACCOUNT = r"(?i:account|acct|konto)(?i:nummer)?(?:\x20(?i:number|no|nr))?[\x20.:#]{1,3}([0-9][0-9-]{4,18}[0-9])"
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account"}
SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"

_domain, _numbers, _digits, _phone, _authority, _iban, _account = (re.compile(p) for p in (DOMAIN, NUMBERS, DIGITS, PHONE, AUTHORITY, IBAN, ACCOUNT))


@cache
def _anchors():
    from ahocorasick import Automaton

    found = Automaton()
    for word, kind in {"@": "email", "+": "phone", "://": "login", **dict.fromkeys("0123456789", "digit"), **CUES}.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(d - 9 * (d > 9) for d in doubled) + sum(map(int, digits[::-2]))) % 10 == 0


def country_account(value: str) -> bool:
    """Whether the letters and digits, turned by four and read as a number, leave one by 97."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _left(text: str, at: int, floor: int, letters: frozenset) -> int:
    while at > floor and text[at - 1] in letters:
        at -= 1
    return at


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of all spans of a text, by start, then kind."""
    out: list[tuple[int, int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, holds: bool) -> None:
        done[kind] = end
        if holds:
            out.append((start, KINDS.index(kind), end, kind))

    for last, (anchor, size) in _anchors().iter(text.encode("utf-8", "replace").lower().decode()):  # lowers A-Z only: places stay
        at = last + 1 - size
        if anchor == "digit":
            if at >= done["card"]:
                found = _digits.match(text, at)
                number = re.sub("[^0-9]", "", found[0]) if found and found.end() - at >= 14 else ""
                take("card", at, found.end() if found else at + 1, 14 <= len(number) <= 19 and luhn(number))
            if at >= done["ip"] and (at == 0 or not "0" <= text[at - 1] <= "9") and (found := _numbers.match(text, at)):
                take("ip", at, found.end(), all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in found[0].split(".")))
        elif anchor == "email":
            start = _left(text, at, done["email"], LOCAL)
            if start < at and (found := _domain.match(text, at + 1)):
                take("email", start, found.end(), True)
        elif anchor == "phone":
            if found := _phone.match(text, at):
                take("phone", at, found.end(), 10 <= sum("0" <= c <= "9" for c in found[0]) <= 15)
        elif anchor == "login":
            start = _left(text, at, done["login"], SCHEME)
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < at and (found := _authority.match(text, last + 1)):
                take("login", start, found.end(), True)
        elif at >= done[anchor] and (found := (_iban if anchor == "iban" else _account).match(text, at)):
            take(anchor, found.start(1), found.end(), country_account(found[1]) if anchor == "iban" else 6 <= sum("0" <= c <= "9" for c in found[1]) <= 17)
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        found = [[dict(zip(("start", "rank", "end", "kind"), s, strict=True)) for s in spans_of(t.as_py() or "")] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, rank of the kind, end, kind), by start, then kind."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}")


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, _, end, kind in spans_of(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_personal(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with all personal data in its texts masked; all other columns stay."""
    mask = F.pandas_udf(lambda texts: texts.map(masked, na_action="ignore"), "string")
    return df.withColumn(text_col, mask(F.col(text_col)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    count = lambda holds: F.size(F.filter("spans", holds)).cast("long")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(of_kind, BASE),
        F.sha2(_joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["rank"] >= len(BASE)).alias("n_added"),
    )


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": NUMBERS,
        "card": DIGITS,
        "phone": PHONE,
        "login": r"[A-Za-z][A-Za-z0-9+.-]*://" + AUTHORITY,
        "iban": IBAN,
        "account": ACCOUNT,
    }
    marked = "\nUNION ALL ".join(
        f"SELECT row_no, {k} AS rank, '{kind}' AS kind, string_split(regexp_replace(t, {q('(' + patterns[kind] + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM doc" for k, kind in enumerate(KINDS)
    )
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    return f"""
        WITH doc AS (SELECT row_number() OVER () AS row_no, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
        marked AS ({marked}),
        piece AS (SELECT row_no, rank, kind, unnest(range(len(parts))) AS k, unnest(parts) AS p FROM marked WHERE len(parts) > 1),
        placed AS (SELECT *, (sum(length(p)) OVER (PARTITION BY row_no, rank ORDER BY k))::BIGINT AS stop FROM piece),
        valued AS (SELECT *, CASE kind WHEN 'iban' THEN regexp_extract(p, {q(IBAN)}, 1) WHEN 'account' THEN regexp_extract(p, {q(ACCOUNT)}, 1) ELSE p END AS v FROM placed WHERE k % 2 = 1),
        numbered AS (SELECT *, stop - length(v) AS start, {digits} AS d, replace(v, ' ', '') AS c FROM valued),
        checked AS (
            SELECT *, CASE kind
                WHEN 'ip' THEN list_aggregate(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(right(x, 4) AS INT), 0) <= 255), 'bool_and')
                WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INT
                    ELSE substr(d, length(d) - i, 1)::INT * 2 - CASE WHEN substr(d, length(d) - i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
                WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
                WHEN 'account' THEN length(d) BETWEEN 6 AND 17
                WHEN 'iban' THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: (CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)::BIGINT)),
                    lambda r, x: (CASE WHEN x > 9 THEN r * 100 ELSE r * 10 END + x) % 97) = 1
                ELSE true END AS holds FROM numbered),
        met AS (SELECT *, kind || ':' || start || ':' || stop AS s FROM checked WHERE holds),
        by_row AS (
            SELECT row_no, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, count(*) FILTER (rank >= {len(BASE)}) AS n_added,
                   string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans
            FROM met GROUP BY row_no)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added
        FROM doc LEFT JOIN by_row USING (row_no)"""


QUERIES = {"op11_personal": op11_personal}
ORACLES = {"op11_personal": _oracle()}
