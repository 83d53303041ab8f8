"""Layout by list ranking against a walk along each path."""

import random

import pytest
from pyspark.sql import functions as F

from helixloom.operators import assembly as A
from helixloom.operators import layout

TURN = str.maketrans("ACGT", "TGCA")


def graph(seed, n=140):
    """Paths, cycles and lone reads: a list of edges in which each end is used once at most, no pair of reads twice."""
    rng = random.Random(seed)
    reads = {k * 3: "".join(rng.choice("ACGTN") for _ in range(rng.randrange(20, 60))) for k in range(n)}
    ends = [(r, e) for r in reads for e in "LR"]
    rng.shuffle(ends)
    edges, pairs = [], set()
    while len(ends) > 60:
        (u, e), (v, f) = ends.pop(), ends.pop()
        a, b = min(u, v), max(u, v)
        if a == b or (a, b) in pairs:
            continue
        pairs.add((a, b))
        lows = [rng.randrange(0, 15) for _ in "ab"]
        highs = [low + rng.randrange(1, 30) for low in lows]
        edges.append((a, b, e if a == u else f, f if a == u else e, rng.random() < 0.5, rng.choice(["same", "rev"]), lows[0], highs[0], lows[1], highs[1]))
    return reads, edges


EDGE = "a long, b long, end_a string, end_b string, flip boolean, orientation string, a_min int, a_max int, b_min int, b_max int"


def span(e, read, size, strand):
    low, high = (e[6], e[7]) if read == e[0] else (e[8], e[9])
    return (size - high, size - low) if (strand == -1) != (read != e[0] and e[5] == "rev") else (low, high)


def plain(reads, edges):
    at = {}
    for e in edges:
        at[e[0], e[2]], at[e[1], e[3]] = (e[1], e[3], e), (e[0], e[2], e)
    seen, out = set(), []
    for first in [r for r in sorted(reads) if ((r, "L") in at) + ((r, "R") in at) < 2] + sorted(reads):
        if first in seen:
            continue
        seen.add(first)
        steps, read, strand, leave, closing = [(first, 1, None)], first, 1, "R" if (first, "R") in at else "L", None
        while (read, leave) in at:
            to, enter, e = at[read, leave]
            if to == first:
                closing = e
                break
            seen.add(to)
            read, strand, leave = to, -strand if e[4] else strand, "L" if enter == "R" else "R"
            steps.append((read, strand, e))
        text, members = "", []
        for r, s, e in steps:
            seq = reads[r] if s == 1 else reads[r].translate(TURN)[::-1]
            cut = 0 if e is None else max(0, min(span(e, r, len(seq), s)[1], len(seq)))
            members.append([r, s, len(text), len(text) + len(seq) - cut])
            text += seq[cut:]
        circular = False
        if closing:
            r, s, _ = steps[-1]
            stop = members[-1][2] + span(closing, r, len(reads[r]), s)[0] - cut
            if members[-1][2] < stop < len(text):
                text, members[-1][3], circular = text[:stop], stop, True
        out.append((first, text, circular, tuple(map(tuple, members))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_layout_equals_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(layout, "BLOCK", 3)
    reads, edges = graph(seed)
    expected = plain(reads, edges)
    assert any(len(c[3]) > 8 for c in expected)
    table = spark.createDataFrame(list(reads.items()), "read_idx long, seq string").repartition(3)
    placed = layout.placements(table.select("read_idx", F.length("seq").alias("length")), spark.createDataFrame(edges, EDGE)).cache()
    rows = {}
    for r in sorted(placed.collect(), key=lambda r: r["rank"]):
        rows.setdefault(r.start, []).append((r.read_idx, r.strand, r.contig_start, r.contig_end))
    assert {s: tuple(m) for s, m in rows.items()} == {c[0]: c[3] for c in expected}
    assert {r.start: (r.circular, r.length) for r in placed.collect()} == {c[0]: (c[2], len(c[1])) for c in expected}
    texts = {}
    for r in sorted(layout.contig_chunks(placed, table, 16).collect(), key=lambda r: r.start):
        assert r.start == len(texts.setdefault(r.contig, "")) and r.start % 16 == 0
        texts[r.contig] += r.seq
    assert texts == {c[0]: c[1] for c in expected}


def test_cycles_and_a_long_path(spark):
    n = 3000
    ring = [(k, k + 1, "R", "L", False, "same", 12, 20, 0, 8) for k in range(9)] + [(0, 9, "L", "R", False, "same", 0, 8, 12, 20)]
    path = [(k, k + 1, "R", "L", False, "same", 12, 20, 0, 8) for k in range(100, 100 + n)]
    reads = spark.createDataFrame([(k, "ACGTACGTACGTACGTACGT") for k in [*range(10), *range(100, 101 + n)]], "read_idx long, seq string")
    placed = layout.placements(reads.select("read_idx", F.length("seq").alias("length")), spark.createDataFrame(ring + path, EDGE))
    found = {r.start: (r.n, r.circular, r.length) for r in placed.groupBy("start", "circular", "length").agg(F.count("*").alias("n")).collect()}
    assert found == {0: (10, True, 120), 100: (n + 1, False, 20 + 12 * n)}


def test_assembly_joins_overlapping_reads(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(6000))
    parts = [(k, genome[k * 400 : k * 400 + 1000]) for k in range(13)]
    parts = [(k, s if k % 3 else s.translate(TURN)[::-1]) for k, s in parts]
    built, _ = A.assemble(spark.createDataFrame(parts, "read_idx long, seq string"))
    rows = built.collect()
    assert all(r.length == len(r.seq) == r.members[-1].contig_end and r.read_count == len(r.members) for r in rows)
    assert [r.contig_id for r in sorted(rows, key=lambda r: (-r.length, r.first_read))] == [f"contig_{k}" for k in range(1, len(rows) + 1)]
    assert max(r.read_count for r in rows) > 5 and max(r.length for r in rows) > 3000
