"""Chains from posting lists against chains of all matches, and reads whose matches could never be written down."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from helixloom.operators import assembly as A


def plain(places_a, places_b, turn, drift):
    out = []
    for other in (0, 1):
        rows = sorted((a >> 1, b >> 1) for pa, pb in zip(places_a, places_b, strict=True) for a in pa for b in pb if (a ^ b) & 1 == other)
        best, chain, last = (0, 0, 0, 0, 0), [], None
        for x, y in [*rows, (None, None)]:
            y = turn - y if other and y is not None else y
            if x is None or (last is not None and abs(x - y - last) > drift):
                if len(chain) > best[0]:
                    best = (len(chain), chain[0][0], chain[-1][0], min(c[1] for c in chain), max(c[1] for c in chain))
                chain = []
            if x is not None:
                chain.append((x, y))
                last = x - y
        out.append(best)
    return out


def test_chains_equal_plain_chains(monkeypatch):
    rng = random.Random(8)
    for trial in range(300):
        monkeypatch.setattr(A, "EXPANDED", rng.choice([1, 3, 10, 1 << 20]))
        used = [rng.sample(range(120), 40) for _ in range(2)]
        hashes = rng.randrange(1, 6)
        places = [[sorted(2 * p + rng.randrange(2) for k, p in enumerate(u) if k % hashes == h) for h in range(hashes)] for u in used]
        drift = rng.choice([0, 2, 10])
        assert A.chained(*[[np.array(x, np.int32) for x in p] for p in places], 130, drift) == plain(*places, 130, drift), trial


def test_homopolymers_take_seconds(spark):
    reads = spark.createDataFrame([(1, "A" * 20_000), (2, "A" * 20_000), (3, "ACGT" * 100)], "read_idx long, seq string")
    began = time.perf_counter()
    posted = A.postings(A.index(A.minimizers(reads))).cache()
    assert [tuple(r) for r in A.pair_counts(posted).collect()] == [(1, 2, 19_987**2)]
    found = A.overlaps(posted, reads.select("read_idx", F.length("seq").alias("length"))).collect()
    assert [(r.a, r.b, r.orientation, r.match_count) for r in found] == [(1, 2, "same", 19_987)]
    assert time.perf_counter() - began < 40
