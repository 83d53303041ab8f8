"""Dynamic phrase counts against plain counts, and the ranking against SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from helixloom.llm import collocations as C


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)] + ["é", "ÀB", "a\u0085b"]
    out = [(k, " ".join(rng.choice(words, 30, p=np.arange(33, 0, -1) / 561)) + rng.choice([".", "\n", "  "]) + "New York\tCity Hall is BIG; big", ["en", "de", None][k % 3]) for k in range(80)]
    out += [(100, None, "en"), (101, "", "de"), (102, " \t ,,; ", "xx"), (103, "lone", "yy"), (104, "x y z " * 4000 + "." + "u v " * 10, "en"), (104, "x y z", "en"), (None, "same same same same same", None)]
    return [(*r, 1, "h", 2) for r in out]


SCHEMA = "doc_id long, text string, lang string, n long, phrase string, shard int"


def plain(rows, least):
    found = Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, 5):
                found.update((lang or "und", " ".join(words[k : k + n]), n) for k in range(len(words) - n + 1))
    return {key: n for key, n in found.items() if n >= least}


@pytest.mark.parametrize(("least", "shards", "slots"), [(3, 4, C.MAX_SLOTS), (30, 3, 16), (8, 1, C.MAX_SLOTS)])
def test_counts_equal_plain_counts(spark, monkeypatch, least, shards, slots):
    monkeypatch.setattr(C, "MIN_SLOTS", min(slots, 1 << 16))
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = C.phrase_counts(docs, least=least, shards=shards, max_slots=slots).collect()
    assert {(r.lang, r.phrase, r.words): r.n for r in found if r.words} == plain(rows, least)
    assert {r.lang: r.n for r in found if r.words == 0 and r.n} == total(rows)


def total(rows):
    out = Counter()
    for (lang, _, n), count in plain(rows, 1).items():
        out[lang] += count * (n == 1)
    return out


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 50)
    rows = corpus()
    texts = [(lang or "und", (t or "").encode()) for _, t, lang, *_ in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([t.decode() for _, t in texts])], names=["lang", "text"])
    assert sum(len(w.begins) for w, _ in C.chunks(iter([batch]))) == sum(total(rows).values())


def test_ranking_equals_sql(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = C.ranked(C.phrase_counts(docs, least=3), top=40)
    expected = con.sql(C.oracle(3, 40))
    of = lambda columns, rows: sorted(tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows)
    assert of(found.columns, found.collect()) == of(expected.columns, expected.fetchall())
    assert found.count() > 60


def test_query_and_empty(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = C.op12_collocations(spark, sf_dir)
    expected = con.sql(C.ORACLES["op12_collocations"])
    of = lambda columns, rows: sorted(tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows)
    assert of(found.columns, found.collect()) == of(expected.columns, expected.fetchall())
    assert C.ranked(C.phrase_counts(spark.createDataFrame([], SCHEMA))).count() == 0
    assert C.ranked(C.phrase_counts(spark.createDataFrame([(1, None, None, 1, "", 1), (2, " ", "x", 1, "", 1)], SCHEMA))).count() == 0
