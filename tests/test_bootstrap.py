"""Bootstrap distances by blocks against sums over columns, and runs that are stopped and resumed."""

import random

import pytest
from pyspark.sql import functions as F

from helixloom.operators import alignment as A
from helixloom.operators import phylo as P


@pytest.fixture(scope="module")
def aligned(spark):
    rng = random.Random(5)
    rows = [(s, c * 7 + (c > 40) * 20_000, rng.choice("ACGT") if rng.random() < 0.4 else "ACGT"[c % 4] if rng.random() < 0.9 else rng.choice("-N")) for s in range(6) for c in range(90)]
    rows += [(6, 0, "-")] + [(6, c, "A") for _, c, _ in rows[1:90]]
    return spark.createDataFrame(rows, "seq_idx long, col long, base string").repartition(4).cache()


def test_columns_are_numbered_in_order(aligned):
    found = [r.k for r in A.numbered(aligned.select("col").distinct()).orderBy("col").collect()]
    assert found == list(range(90))


@pytest.mark.parametrize(("columns", "complete"), [(16, False), (1024, True)])
def test_distances_equal_sums_over_columns(aligned, columns, complete):
    kept = A.complete_columns(aligned) if complete else aligned
    cells = {(r.seq_idx, r.col): r.base for r in kept.collect()}
    weights = {}
    for r in A.bootstrap_columns(kept.select("col").distinct(), 7, 3).collect():
        weights.setdefault(r.rep, {})[r.col] = r.w
    n = len({c for _, c in cells})
    assert all(sum(w.values()) == n for w in weights.values()) and len(weights) == 7
    found = {(r.rep, r.i, r.j): r.d for r in P.bootstrap_distances(aligned, 7, "p", 3, complete, columns).collect()}
    expected = {}
    for rep, w in weights.items():
        for i in range(7):
            for j in range(i + 1, 7):
                both = [(cells[i, c], cells[j, c], k) for c, k in w.items() if cells.get((i, c), "-") in "ACGT" and cells.get((j, c), "-") in "ACGT"]
                if comp := sum(k for *_, k in both):
                    expected[rep, i, j] = sum(k for x, y, k in both if x != y) / comp
    assert found.keys() == expected.keys() and all(abs(found[k] - d) < 1e-12 for k, d in expected.items())


def test_resumed_bootstrap_equals_one_run(spark, aligned, tmp_path):
    names = [f"t{k}" for k in range(7)]
    ledger = str(tmp_path / "ledger")
    of = lambda rows: sorted((r.rep, r.newick, tuple(r.splits)) for r in rows.collect())
    whole = of(P.replicate_trees(aligned, names, 10))
    assert of(P.replicate_trees(aligned, names, 4, ledger=ledger, batch=3)) == whole[:4]
    assert of(P.replicate_trees(aligned, names, 10, ledger=ledger, batch=4)) == whole
    before = len(list((tmp_path / "ledger").glob("*.parquet")))
    assert of(P.replicate_trees(aligned, names, 10, ledger=ledger)) == whole and len(list((tmp_path / "ledger").glob("*.parquet"))) == before
    with pytest.raises(ValueError, match="another bootstrap"):
        P.replicate_trees(aligned.where(F.col("col") > 0), names, 10, ledger=ledger)
    once = P.tree_with_support(aligned, names, replicates=10).first()
    assert P.tree_with_support(aligned, names, replicates=10, ledger=ledger).first() == once
