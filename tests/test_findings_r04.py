"""Faults that only tables of 6 GB showed, each on small input."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from helixloom.functions import profiles
from helixloom.operators import explorer
from helixloom.plans import formats
from helixloom.sources import chunks, writers


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_of_any_length_are_aligned():
    draw = np.random.default_rng(2)
    root = draw.integers(0, 4, 30_500, dtype=np.uint8)
    far = (root + (draw.random(len(root)) < 0.01)).astype(np.uint8) % 4
    far = np.delete(far, draw.choice(len(far), 20, replace=False))
    rows = profiles.merge(root[None, :], far[None, :], profiles.Scoring())  # over 900 million cells
    assert [list(r[r < 4]) for r in rows] == [list(root), list(far)]
    assert (rows[0] == rows[1]).sum() > 0.98 * len(root)


def test_a_path_is_that_of_all_cells_however_few_rows_and_steps_are_held(monkeypatch):
    draw = random.Random(7)
    for k in range(12):
        root = draw.choices("ACGT", k=draw.randrange(150, 300))
        seqs = ["".join(draw.choice("ACGT") if draw.random() < 0.1 else c for c in root if draw.random() > 0.03) for _ in range(4)]
        seqs = [seqs[0][: len(seqs[0]) // (1 + k % 3)], *seqs[1:3], seqs[3][::-1] if k % 4 == 0 else "A" * (5 * k) + seqs[3]]
        wanted = profiles.progressive(seqs)
        with monkeypatch.context() as m:
            for name, value in (("DENSE", 10), ("NARROW", draw.randrange(4, 30)), ("SAMPLED", draw.randrange(1, 40)), ("STEPS", draw.choice([300, 3000])), ("KEPT", draw.randrange(2, 9))):
                m.setattr(profiles, name, value)
            assert profiles.progressive(seqs) == wanted


def test_genbank_is_written_packed_by_one_shuffle_and_read_without_another(spark, sf_dir, tmp_path):
    contigs = spark.createDataFrame([(k % 20, "ACGTN" * (k + 1)) for k in range(25)], "contig long, seq string")  # five keys twice
    genes = spark.range(90).selectExpr("id % 30 AS contig", "id AS start", "id + 5 AS end", "'+' AS strand", "concat('t', id) AS locus_tag", "'p' AS product", "'MKV' AS protein")
    lines = writers.genbank_lines(contigs, genes)
    assert executed(lines).count("Exchange hashpartitioning") == 1
    lines.write.text(str(tmp_path / "a"), compression="gzip")
    rows, table = chunks.genbank(spark, str(tmp_path / "a"), 32, 100)
    assert "Join" not in executed(table)
    assert {(r.contig, r.type, r.tag) for r in rows.where("kind = 'feature'").collect()} == {(str(k % 30), "CDS", f"t{k}") for k in range(90) if k % 30 < 20}
    assert rows.where("kind = 'feature'").count() == 60
    assert sorted((r.contig, r.len) for r in rows.where("kind = 'record'").collect()) == sorted((str(k % 20), 5 * (k + 1)) for k in range(25))
    wanted = [(str(k % 20), len(x), at, x[at : at + 32]) for k in range(25) for x in ["ACGTN" * (k + 1)] for at in range(0, len(x), 32)]
    assert sorted(tuple(r) for r in table.collect()) == sorted(wanted)  # each copy of a key by itself
    path = formats.fresh_path(spark, "genbank").rsplit("/", 1)[0].removeprefix("file:")
    before = set(Path(path).iterdir())
    assert formats.genbank_scan(spark, sf_dir).count() > 0
    new = set(Path(path).iterdir()) - before
    assert len(new) == 1 and all(f.suffix == ".gz" for f in new.pop().glob("part-*"))  # nothing but the packed files


def test_long_genbank_records_pass_through_the_disk(monkeypatch, tmp_path):
    monkeypatch.setattr(chunks, "HELD", 100)
    seqs = {"a": "ACGTN" * 50, "b": "", "c": "GGCA" * 3, "d": "TTAGC" * 40}
    text = "".join(f"LOCUS       {k} x\nFEATURES\nORIGIN\n        1 {x[:60].lower()}\n       61 {x[60:].lower()}\n//\n" for k, x in seqs.items())
    (tmp_path / "a.gb").write_text(text)
    spans = [(0, 200), (200, 600), (600, len(text))]
    batch = pa.RecordBatch.from_pylist([{"file": str(tmp_path / "a.gb"), "first": a, "last": b} for a, b in spans])
    found = [tuple(r.values()) for b in chunks._genbank_chunks(32)(iter([batch])) for r in b.to_pylist()]
    assert found == [(k, len(x), at, x[at : at + 32]) for k, x in seqs.items() for at in range(0, len(x), 32)]


def test_features_meet_what_is_found_of_them_in_one_shuffle(spark):
    schema = "contig string, start long, end long, strand string, type string, ord long, id string, parent string, tag string, name string, product string, is_pseudo boolean"
    rows = [("a", k, k + 5, "+", "gene" if k % 4 == 0 else "CDS", k, f"g{k}" if k % 4 == 0 else None, f"g{k - k % 4}" if k % 4 == 1 else None, f"t{k - k % 4}" if k % 4 == 2 else None, None, f"p{k}" if k % 4 == 0 else None, False) for k in range(40)]
    rows += [("b", k, k + 5, "+", "gene", k, None, None, None, None, None, False) for k in (0, 7)] + [("a", 12, 17, "+", "CDS", 99, None, None, None, None, None, False), (None, 1, 2, "+", "CDS", 98, None, None, "u", None, None, False)]
    features = spark.createDataFrame(rows, schema)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k in before:
            spark.conf.set(k, "false" if "adaptive" in k else "-1")
        found = explorer.resolve_parents(features)
        plan = executed(found)
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
        assert len(shuffles) == 9 and "ReusedExchange" in plan  # three of genes, three of keys, one of what is found, one of features, one of genes with children
        kept = {(r.contig, r.ord): r.gene_product for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: v for k, v in kept.items() if v} == {("a", k): f"p{k - k % 4}" for k in range(40) if k % 4 == 1} | {("a", 99): "p12"}
    assert {o for c, o in kept if c == "b"} == {0, 7} and not any(c == "a" and o % 4 == 0 and o < 40 for c, o in kept)  # of one number on two contigs each goes by itself
    named = explorer.labelled(found, "ord", "contig").collect()
    assert len(named) == len(kept) and {r.locus_tag for r in named if r.contig == "b"} == {"feat_1", "feat_2"}
