"""Passages that line dedup keeps: inside a line, across line ends, without newlines; against brute force word by word."""

import re

import numpy as np
import pytest

from helixloom.llm import line_dedup, passage_dedup

PASSAGE = [f"p{k}" for k in range(80)]
SPACES = "[\x20\x09-\x0d]*"


def texts():
    rng = np.random.default_rng(5)
    filler = [f"w{k}" for k in range(4000)]

    def own(n):
        return " ".join(rng.choice(filler, n))

    p = " ".join(PASSAGE)
    out = [None, "", " \n ", f"{own(30)} {p} {own(200)}", f"{own(7)} {p} {own(5)}", p, f"  {p}\ttail\n"]
    out += [f"{own(9)} {' '.join(PASSAGE[:40])}\n{' '.join(PASSAGE[40:])} {own(9)}\nnext line", f"{own(3)} {' '.join(PASSAGE[10:60])} {own(3)}", f"{own(3)} {' '.join(PASSAGE[10:59])} {own(3)}"]
    out += [" ".join(["again"] * 70), f"{own(4)} " + " ".join(f"c{k % 7}" for k in range(130)), f"x\n{p}\n{p}\ny", f"a {p} b {p}\nc", "\n".join([own(20), p, own(20)])]
    long = own(3000)
    return out + [long, long.replace(" ", "\n"), f"{own(10)} {' '.join(long.split()[700:1900])} {own(10)}", own(2000)]


def brute(rows, least=50):
    """What goes by the definition: each window of words that occurs at an earlier (doc, word)."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = text or ""
        tokens = re.findall(f"{SPACES}[^\x20\x09-\x0d]+", raw)
        words, gone = [t.strip() for t in tokens], set()
        for i in range(len(words) - least + 1):
            w = tuple(words[i : i + least])
            gone.update(range(i, i + least)) if w in seen else seen.add(w)
        kept, began = "", None  # began: the space before a deleted run that began a line or the text
        for i, t in enumerate(tokens):
            space = re.match(SPACES, t).group()
            if i in gone:
                began = (space if i == 0 or "\n" in space else "") if i - 1 not in gone else began
                began = None if began == "" and i != 0 and i - 1 not in gone else began
            else:
                kept += t if began is None or i - 1 not in gone else began + t[len(space) :]
                began = None
        tail = raw[len(raw.rstrip("\x20\x09\x0a\x0b\x0c\x0d")) :]
        out[doc] = (None if text is None else kept + tail if gone else text, len(gone))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3).cache()


def found(df):
    rows = passage_dedup.passage_dedup(df, runs_col="runs").collect()
    return {r.doc_id: (r.text, sum(x.last - x.first + 1 for x in r.runs or [])) for r in rows}


def test_equals_brute_force(docs):
    rows = list(enumerate(texts()))
    expected = brute(rows)
    assert found(docs) == expected
    assert sum(n > 0 for _, n in expected.values()) >= 10


def test_line_dedup_leaves_what_this_takes(docs):
    by_line = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    by_word, made = found(docs), texts()
    inside = [k for k in (4, 6, 7, 8, 17) if by_line[k] == made[k]]
    assert inside == [4, 6, 7, 8, 17] and all(by_word[k][1] >= 50 for k in inside)
    assert all(len(by_word[k][0] or "") <= len(t or "") for k, t in by_line.items())


def test_small_vocabulary(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(["a", "b"], 60) if k % 3 else ["a", "b", "b"] * 30)) for k in range(40)]
    rows += [(100 + k, " ".join(np.tile(rng.choice(["a", "b", "c"], k + 1), 150)[:140])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows)


def test_nulls_repeats_empty_and_columns(spark, docs):
    p = " ".join(PASSAGE)
    df = spark.createDataFrame([(5, f"a {p}", 1), (5, f"a {p}", 1), (None, f"b {p} c", 2), (7, None, 3)], "doc_id long, text string, __run int")
    out = sorted((r.doc_id or -1, r.text) for r in passage_dedup.passage_dedup(df).collect() if r.text is not None)
    assert out == [(-1, "b c"), (5, f"a {p}"), (5, f"a {p}")]
    assert passage_dedup.passage_dedup(df).columns == df.columns
    assert passage_dedup.passage_dedup(docs.limit(0)).count() == 0
