"""Anchor expansion against plain patterns, over awkward texts and random strings of the letters that matter."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from helixloom.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", " ", "é a.b@c.d@e.f.g @x.y a@b a@b.c", "1.2.3.4.5.6.7.8.256.1.1.1 0001.02.3.0255 9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111", "+1 (988) 555-2485. +49 30 123456-  +1 +12345678901234567 ++4915112345678",
    "see https://joe:pw1@db.example.com:5432/x and ftp://x@h 1http://a:b@c", "IBAN: DE89 3704 0044 0532 0130 00 BIC and iban GB82WEST12345698765432, IBAN GB82WEST12345698765433", "Account no: 12345678, acct 12-34-56-78 Kontonummer 1234567 account 1234", "x@y.z" * 3, "a@b." * 9, "1." * 9, "€" * 50 + "me@home.example" + "9" * 60,
    "a" * 300 + "@", "1" * 300, "+1" + "(" * 300, "1 " * 300, "@" * 300,
]
LONG = ["a" * 200_000 + "@", "1" * 200_000, "+1" + "(" * 100_000, "1 " * 50_000, "@" * 50_000, "1." * 50_000, "a@b." * 50_000]


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x[-9:]) > 255 or len(x.lstrip("0")) > 3 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def base(text):
    return [s for s in personal.spans_of(text or "") if s[3] in PLAIN]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for text in TEXTS:
        assert base(text) == plain(text)
    for _ in range(4000):
        text = "".join(rng.choice("01234567899@@..+-- ()abé%:/") for _ in range(rng.randrange(60)))
        assert base(text) == plain(text), text


def test_long_texts_take_time_by_their_length():
    began = time.perf_counter()
    assert [len(personal.spans_of(t)) for t in LONG] == [0, 0, 0, 0, 0, 12_500, 25_000]
    assert time.perf_counter() - began < 5


def test_added_kinds():
    kinds = lambda t: [(t[a:b], k) for a, _, b, k in personal.spans_of(t) if k not in PLAIN]
    assert kinds(TEXTS[7]) == [("https://joe:pw1@db.example.com:5432", "login"), ("ftp://x@h", "login"), ("http://a:b@c", "login")]
    assert kinds(TEXTS[8]) == [("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban")]
    assert kinds(TEXTS[9]) == [("12345678", "account"), ("12-34-56-78", "account"), ("1234567", "account")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 1), (None, TEXTS[4], None, None)]
    folder = tmp_path_factory.mktemp("personal")
    spark.createDataFrame(rows, "doc_id long, text string, spans string, rank int").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_query_equals_sql(spark, docs):
    found = personal.op11_personal(spark, docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{docs}/documents.parquet/*.parquet'")
    expected = con.sql(personal.ORACLES["op11_personal"])
    assert sorted(found.columns) == sorted(expected.columns)
    of = lambda columns, rows: sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows), key=repr)
    assert of(found.columns, found.collect()) == of(expected.columns, expected.fetchall())
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[0].base_sha256 == hashlib.sha256(b"").hexdigest() and by_id[0].spans == ""


def test_masked_and_empty(spark, docs):
    rows = spark.read.parquet(f"{docs}/documents.parquet")
    texts = {r.doc_id: r.text for r in personal.without_personal(rows).collect()}
    assert texts[0] is None and texts[9] == "Account no: [ACCOUNT], acct [ACCOUNT] Kontonummer [ACCOUNT] account 1234"
    assert personal.find_personal(rows.limit(0)).count() == 0
