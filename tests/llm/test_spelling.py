"""The composed machines against all pairs, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from helixloom.llm import spelling as S
from helixloom.llm.common import table


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        found = [(-counts[o], o) for o in counts if abs(len(o) - len(w)) < 2 and near(w, o)]
        best = min(found, default=None)
        out[w] = (n, len(found), best[1] if best and -best[0] >= 5 * n else None)
    return out


def root(found, w):
    while found[w][2]:
        w = found[w][2]
    return w


def sample():
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(500)} | {"aaaaaaa", "aaaaaaaa", "ababab", "z" * 9, "z" * 10}
    return {w: rng.choice([1, 5, 6, 30, 150, 151, 5000]) for w in sorted(words)}


def test_composition_equals_all_pairs():
    words = sorted([*sample(), "zz" * 4000, "zz" * 4000 + "z"])
    found = list(S.composed(words))
    assert len(found) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_acceptor_is_minimal():
    states, first = S.acceptor(sorted(f"{a}{b}ing" for a in "bcd" for b in "xyz"))
    assert len(states) == 6 and not states[first][0]


@pytest.mark.parametrize("block", [1, 3, 40, 10_000])
def test_variants_equal_all_pairs(spark, block):
    counts = sample()
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    expected = plain(counts)
    found = {r.word: r for r in S.variants(rows, block=block).collect()}
    assert {w: (r.n, r.n_near, r.form) for w, r in found.items()} == expected
    assert {w: r.root for w, r in found.items()} == {w: root(expected, w) for w in expected}
    assert all(r.form_n == (counts[r.form] if r.form else None) for r in found.values())


def words_of(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def test_vocabulary_of_awkward_rows(spark):
    text = "Überall ÜBERALL éÉtoile lettersımore lettersmore " + "x" * 5000 + " ×÷×÷×÷ short"
    rows = [(k, text) for k in range(400)] + [(5, text), (5, text), (None, text), (7, None), (8, ""), (9, "1 2")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in S.vocabulary(docs).collect()} == words_of(rows)
    assert S.variants(S.vocabulary(docs.limit(0))).count() == 0


def test_query_equals_plain_python(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    counts = words_of(rows)
    by_rest = defaultdict(set)
    for w in counts:
        by_rest[w].add(w)
        for k in range(len(w)):
            by_rest[w[:k] + w[k + 1 :]].add(w)
    around = {w: {o for k in range(len(w)) for o in by_rest[w[:k] + w[k + 1 :]] | by_rest[w] if near(w, o)} for w in counts}
    found = {r.word: r for r in S.op13_spelling(spark, sf_dir).collect()}
    assert found.keys() == counts.keys() and any(r.form for r in found.values())
    for w, r in found.items():
        best = min(((-counts[o], o) for o in around[w]), default=None)
        form = best[1] if best and -best[0] >= 5 * counts[w] else None
        assert (r.n, r.n_near, r.form) == (counts[w], len(around[w]), form)
        assert r.root == (found[r.form].root if r.form else w)
