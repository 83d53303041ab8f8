"""Functions against hand-checked values, plain Python and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixloom.functions import genes, profiles, protein, stats, trees
from helixloom.functions import sequence as S
from helixloom.operators import annotate, assembly, assoc, phylo
from helixloom.sources import samples


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fnv_and_prng(spark):
    assert one(spark, S.fnv1a(F.lit("ACGTACGTAC"))) == 2697559521
    draws = [r.x for r in spark.range(3).select(S.mulberry32(42, F.col("id")).alias("x")).collect()]
    expected = [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]
    assert draws == expected
    stream = samples.mulberry32(42)
    assert [next(stream) for _ in range(3)] == expected


def test_sequence_functions(spark):
    assert one(spark, S.mean_quality(F.lit(""))) == pytest.approx(120)
    assert one(spark, S.reverse_complement(F.lit("ACGTNxacgt"))) == "acgtNNACGT"
    assert one(spark, S.reverse_complement(S.reverse_complement(F.lit("AACCGGTTN")))) == "AACCGGTTN"
    assert one(spark, S.translated(F.lit("ATGGCNTAAT"))) == "MX"
    assert one(spark, S.encoded(F.lit("acgU"), rna=True)) == "ACGT"
    assert one(spark, S.formatted_bases(F.lit(1234))) == "1.2 kb"


def test_fisher_odds_welch(spark):
    tables = spark.createDataFrame([("x", 2, 0, 0, 2), ("y", 0, 0, 3, 4), ("z", 10, 2, 3, 15)], "gene string, a long, b long, c long, d long")
    p = {r.gene: r.p for r in stats.fisher_exact(tables, "gene").collect()}
    assert p["x"] == pytest.approx(1 / 3, abs=1e-9) and p["y"] == 1
    choose = math.comb
    whole = [choose(13, k) * choose(17, 12 - k) / choose(30, 12) for k in range(13)]
    assert p["z"] == pytest.approx(sum(w for w in whole if w <= whole[10] * (1 + 1e-9)), rel=1e-9)
    r = tables.where("gene = 'z'").select(*[c.alias(n) for n, c in stats.odds_ratio(*[F.col(x) for x in "abcd"]).items()]).first()
    assert r.odds_ratio > 1 and r.ci_lo < r.odds_ratio < r.ci_hi
    for n in (1, 2, 5, 60, 4000):
        assert one(spark, stats.log_gamma(F.lit(float(n)))) == pytest.approx(math.lgamma(n), abs=1e-9)


def test_incomplete_beta():
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)), rel=1e-12)
    assert stats.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5, rel=1e-12)
    # two-sided p of t = 2 with 10 degrees of freedom
    assert stats.incomplete_beta(5, 0.5, 10 / 14) == pytest.approx(0.07338803, abs=1e-7)


def test_false_discovery_rate(spark):
    ps = [0.01, 0.04, 0.03, 0.03, 0.5, None]
    rows = spark.createDataFrame(list(enumerate(ps)), "gene int, p double")
    q = {r.gene: r.q for r in stats.benjamini_hochberg(rows, "p", "gene").collect()}
    assert q.pop(5) is None and [q[k] for k in range(4)] == pytest.approx([0.05] * 4)
    assert all(q[k] >= ps[k] for k in q)
    assert {r.gene: r.q_bonf for r in stats.bonferroni(rows, "p").collect()}[1] == pytest.approx(0.2)


def test_panel_finds_the_causal_genes(spark):
    cells, traits = samples.panel()
    rows = assoc.binary_scan(spark.createDataFrame(cells, "gene string, sample string, present boolean"), spark.createDataFrame(traits, "sample string, is_case boolean, stratum string"))
    top = [r.gene for r in assoc.ranked(rows, 2).collect()]
    assert set(top) == {"gene_01", "gene_02"}


def random_tree(n, rng):
    tree = trees.Tree()
    pool = [tree.add(f"t{k}") for k in range(n)]
    while len(pool) > 3:
        a, b = pool.pop(rng.randrange(len(pool))), pool.pop(rng.randrange(len(pool)))
        pool.append(tree.add(None, (a, b), (rng.random() + 0.1, rng.random() + 0.1)))
    tree.add(None, tuple(pool), tuple(rng.random() + 0.1 for _ in pool))
    return trees.parse_newick(trees.to_newick(tree))


def path_lengths(tree, names):
    d = np.zeros((len(names),) * 2)
    for mask, node in zip(trees.masks(tree, names)[:-1], tree.nodes[:-1], strict=True):
        side = np.array([mask >> k & 1 for k in range(len(names))], bool)
        d[np.ix_(side, ~side)] += node.length
        d[np.ix_(~side, side)] += node.length
    return d


def test_trees():
    rng = random.Random(3)
    for n in (4, 7, 15):
        tree = random_tree(n, rng)
        names = sorted(tree.nodes[k].name for k in tree.leaves())
        d = path_lengths(tree, names)
        joined = trees.neighbor_joining(d, names)
        assert trees.splits(joined, names) == trees.splits(tree, names)
        assert np.allclose(path_lengths(joined, names), d, atol=1e-9)
        rooted = trees.midpoint(joined)
        tips = sorted(rooted.depths()[list(rooted.leaves())])
        assert tips[-1] == pytest.approx(d.max() / 2) and tips[-2] == pytest.approx(tips[-1])
        assert np.allclose(path_lengths(rooted, names), d, atol=1e-9)
        flat = trees.upgma(d, names)
        assert np.ptp(flat.depths()[list(flat.leaves())]) < 1e-9
        assert len(trees.splits(rooted, names)) <= n - 3


def test_newick():
    text = '((a:1,"b ""c":2)95:0.5,d:1.25):0;'
    assert trees.to_newick(trees.parse_newick(text)) == text
    for bad in ("((a,b)", "(a,,b);", "(a:x,b);", "a b;", "(a,b));"):
        with pytest.raises(ValueError, match="character"):
            trees.parse_newick(bad)
    cut = trees.clades(trees.parse_newick("((a:0.01,b:0.01):0.06,(c:0.01,d:0.01):0.03);"), 0.05)
    assert cut["a"] == cut["b"] == "clade_1 (2)" and cut["c"] != cut["d"] or cut["c"] == "clade_2 (1)"


def test_supports_of_a_chain(spark):
    rows = samples.alignment(taxa=6, columns=600)
    cells = spark.createDataFrame([(k, c, b) for k, (_, s) in enumerate(rows) for c, b in enumerate(s)], "seq_idx long, col long, base string")
    found = phylo.tree_with_support(cells, [n for n, _ in rows], replicates=25).first()
    tree = trees.parse_newick(found.newick)
    assert found.replicates == 25 and {n.name for n in tree.nodes if n.name} == {n for n, _ in rows}
    assert max(n.support or 0 for n in tree.nodes) >= 90


def test_progressive_alignment():
    rng = random.Random(1)
    base = samples.genome(200, seed=5)
    seqs = [base[:60] + base[64:]] + ["".join(c for c in base if rng.random() > 0.03) for _ in range(5)] + [base]
    rows = profiles.progressive(seqs)
    assert len({len(r) for r in rows}) == 1
    assert [r.replace("-", "") for r in rows] == seqs
    assert sum(a == b for a, b in zip(rows[0], rows[-1], strict=True)) >= 190
    assert profiles.progressive(["ACGT"]) == ["ACGT"]


def test_protein():
    assert protein.molecular_weight("") == pytest.approx(18.01524)
    assert protein.molecular_weight("GG") == pytest.approx(132.12, abs=0.01)
    assert protein.isoelectric_point("") is None
    assert protein.isoelectric_point("K" * 10) > 10 > 4.5 > protein.isoelectric_point("D" * 10)
    assert protein.membrane_segments("D" * 30 + "L" * 25 + "D" * 30)
    assert protein.membrane_segments("D" * 80) == []
    assert protein.signal_peptide("MKKR" + "L" * 12 + "AVA" + "D" * 40) is not None
    assert protein.signal_peptide("M" * 20) is None


def test_orfs_tile_the_frames():
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    for frame in range(3):
        parts = [(a, b) for a, b, _ in genes.orfs(seq, 3) if a % 3 == frame]
        assert parts[0][0] == frame and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    assert all(seq[b - 3 : b] in genes.STOPS for _, b, end in genes.orfs(seq, 90) if not end)


def test_ribosome_sites_match_a_plain_scan():
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(300)) + genes.CONSENSUS + "ACGTAGATG"
    at = np.arange(0, len(seq))
    score, matches, spacer, _ = genes.ribosome_sites(genes.codes(seq), at)
    for p in at:
        best = (0, None)
        for off in range(max(0, p - 22), p - 8):
            m = sum(a == b for a, b in zip(seq[off : off + 9], genes.CONSENSUS, strict=True))
            if m > best[0]:
                best = (m, p - off - 9)
        assert matches[p] == best[0] and (spacer[p] == best[1] if best[0] else spacer[p] == -1)
    assert score.max() == 1


def test_annotation_finds_a_planted_gene(spark):
    rng = random.Random(9)
    body = "".join(rng.choice(("GCT", "GAA", "CTG", "AAA", "GGC", "ACC")) for _ in range(200))
    noise = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seq = noise(500) + "TAA" + genes.CONSENSUS + "ACCTAGC" + "ATG" + body + "TAA" + noise(500)
    frame = spark.createDataFrame([(1, seq), (2, samples.genome(4000))], "contig long, seq string")
    found = annotate.annotate(frame).collect()
    assert any(g.contig == 1 and g.strand == "+" and g.end == seq.index("ATG" + body) + 606 for g in found)
    assert [g.locus_tag for g in sorted(found, key=lambda g: (g.contig, g.start))] == [f"GE_{k + 1:05d}" for k in range(len(found))]


def test_assembly_of_clean_reads(spark):
    source = samples.genome(6000, seed=3)
    turn = str.maketrans("ACGT", "TGCA")
    made = [source[s : s + 1400] for s in range(0, 4601, 460)]
    made = [r if k % 2 else r.translate(turn)[::-1] for k, r in enumerate(made)]
    reads = spark.createDataFrame(list(enumerate(made)), "read_idx long, seq string")
    built, found = assembly.assemble(reads)
    rows = built.collect()
    assert sum(r.read_count for r in rows) == len(made)
    longest = max(rows, key=lambda r: r.length)
    assert longest.read_count >= 5 and len(longest.seq) == longest.length
    assert longest.members[0].contig_start == 0 and longest.members[-1].contig_end == longest.length
    s = assembly.summary(reads, built, found).first()
    assert s.input_reads == len(made) and s.unplaced_reads == 0


def test_matching_is_greedy(spark):
    rng = random.Random(8)
    rows, seen = [], set()
    for _ in range(60):
        a, b = sorted(rng.sample(range(14), 2))
        if (a, b) in seen:
            continue
        seen.add((a, b))
        rows.append((a, b, rng.choice("LR"), rng.choice("LR"), False, rng.randrange(4, 9), len(rows)))
    edges = spark.createDataFrame(rows, "a long, b long, end_a string, end_b string, flip boolean, match_count int, found_at int")
    used, expected = set(), set()
    for r in sorted(rows, key=lambda r: (-r[5], r[6])):
        ends = {(r[0], r[2]), (r[1], r[3])}
        if not ends & used:
            used |= ends
            expected.add(r[:2])
    assert {(r.a, r.b) for r in assembly.greedy_matching(edges).collect()} == expected


def test_byte_labels(spark):
    assert [one(spark, S.formatted_bytes(F.lit(n))) for n in (12, 1536, 3 << 20)] == ["12 B", "1.5 KB", "3.15 MB"]


def test_stream_progress_is_kept(spark, sf_dir):
    from helixloom.plans import streams
    from helixloom.streaming import progress

    watcher = progress.watch(spark)
    streams.stream_length_counts(spark, sf_dir)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    progress.cancel(spark)
    spark.streams.removeListener(watcher)
    assert all(r[2] >= 0 for r in watcher.reports)
