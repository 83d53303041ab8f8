"""Interval clusters, lanes, greedy resolution and nested bins against brute force."""

import random

import pytest

from helixloom.operators import clusters, explorer


def intervals(seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2]), k, a := rng.randrange(0, 40_000), a + rng.choice([1, 30, 90, 300, 300, 2000]), rng.choice("+-"), rng.choice([0.5, 1.0, rng.random()])) for k in range(n)]
    rows += [(3, 1000 + k, k * 10, k * 10 + 10, "+", 0.1) for k in range(40)] + [(3, 2000, 0, 5_000_000_000, "-", 0.3), (3, 2001, 4_999_999_000, 4_999_999_400, "+", 0.2), (4, 2002, 511, 513, "+", 1.0), (4, 2003, 500, 600, "+", 1.0)]
    return rows


SCHEMA = "contig long, feature_id long, start long, end long, strand string, score double"


@pytest.mark.parametrize("block", [100, 1 << 18])
def test_clusters(spark, block):
    rows = intervals(1)
    found = {r.feature_id: r.cluster for r in clusters.clustered(spark.createDataFrame(rows, SCHEMA).repartition(4), "contig", block=block).collect()}
    expected = {}
    for contig in {r[0] for r in rows}:
        reach = first = None
        for r in sorted((r for r in rows if r[0] == contig), key=lambda r: r[2]):
            if reach is None or r[2] >= reach:
                first = r[2]
            reach = max(reach or 0, r[3])
            expected[r[1]] = first
    assert found == expected and len(set(expected.values())) > 20


def test_lanes(spark):
    rows = intervals(2)
    found = {r.feature_id: r.lane for r in explorer.lane_packing(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    expected = {}
    for key in {(r[0], r[4]) for r in rows}:
        ends = []
        for r in sorted((r for r in rows if (r[0], r[4]) == key), key=lambda r: (r[2], r[1])):
            lane = next((k for k, e in enumerate(ends) if r[2] >= e), len(ends))
            ends[lane : lane + 1] = [r[3]]
            expected[r[1]] = lane
    assert found == expected and max(expected.values()) > 3


def test_resolution(spark):
    rows = intervals(3)
    found = {(r.contig, r.strand, r.start, r.end) for r in clusters.resolved(spark.createDataFrame(rows, SCHEMA).repartition(4), 60, 25).collect()}
    taken = []
    for r in sorted(rows, key=lambda r: (-r[5], r[4], r[2])):
        if all(min(r[3], t[3]) - max(r[2], t[2]) <= (60 if r[4] == t[4] else 25) for t in taken if t[0] == r[0]):
            taken.append(r)
    assert found == {(r[0], r[4], r[2], r[3]) for r in taken} and len(found) < len(rows)


def test_overlaps_with_nested_bins(spark):
    rows = intervals(4)
    found = sorted(tuple(r) for r in explorer.overlaps(spark.createDataFrame(rows, SCHEMA).drop("score")).collect())
    expected = []
    for x in rows:
        for y in rows:
            over = min(x[3], y[3]) - max(x[2], y[2])
            if x[0] == y[0] and x[1] < y[1] and over > (60 if x[4] == y[4] else 25):
                expected.append((x[0], x[1], y[1], over))
    assert found == sorted(expected) and any(o > 300 for *_, o in expected)
