"""Faults that only large tables showed, each on small input."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixloom.functions import genes, profiles, protein, stats
from helixloom.operators import alignment, annotate, assembly, assoc, chunked, explorer, msa, phylo
from helixloom.plans import formats, inputs
from helixloom.sources import chunks, fastq, writers


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_no_estimate_makes_the_driver_hold_parts_orders_or_samples(spark, sf_dir):
    grid, traits = inputs.presence(spark, sf_dir), inputs.traits(spark, sf_dir)
    assert "BroadcastHashJoin" not in planned(grid)
    place = planned(traits).count("BroadcastHashJoin")  # nation and region: 25 rows
    assert planned(assoc.contingency(grid, traits)).count("BroadcastHashJoin") <= place


def test_each_finite_p_gets_its_q_even_if_it_is_computed_anew_each_time(spark):
    drawn = F.udf(lambda k: random.random(), "double").asNondeterministic()
    rows = stats.benjamini_hochberg(spark.range(40).withColumn("p", drawn("id")), "p", "id").collect()
    assert len(rows) == 40 and all(r.q is not None and r.q >= r.p for r in rows)


def test_genbank_rows_are_the_flat_files_in_order_and_sort_in_no_python_group(spark, tmp_path):
    contigs = spark.createDataFrame([(k, "ACGTNACGTTA" * k) for k in range(1, 30)], "contig long, seq string")
    spans = [(k % 40, 7 * (k % 9), 7 * (k % 9) + k + 1, "+-"[k % 2], f"t{k:03d}", f"p {k}", "MKV" * (k % 50)) for k in range(200)]
    genes = spark.createDataFrame(spans, "contig long, start long, end long, strand string, locus_tag string, product string, protein string")
    rows = writers.genbank_lines(contigs, genes)
    assert "Pandas" not in planned(rows)
    rows.coalesce(1).write.text(str(tmp_path / "a"))
    written = "".join(f.read_text() for f in sorted((tmp_path / "a").glob("part-*")))
    files = {x.split()[1]: x.splitlines() for x in written.split("//\n") if x}
    wanted = {str(r.contig): r.value.splitlines()[:-1] for r in writers.genbank(contigs, genes).collect()}
    blocks = lambda lines: sorted("\n".join(lines).split("     CDS "))  # noqa: E731 (genes with one start stand in any order in the old form)
    assert files.keys() == wanted.keys() and all(len(files[k]) == len(wanted[k]) for k in files)
    for k in files:
        at = files[k].index("ORIGIN")
        assert files[k][at:] == wanted[k][at:] and blocks(files[k][:at]) == blocks(wanted[k][:at])


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 5000)
    parts = chunks.ranges(spark, str(tmp_path), 10)
    assert parts.count() == 500 and parts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_starts_of_many_frames_are_those_of_each_and_much_faster():
    draw = random.Random(5)
    frames = ["".join(draw.choices("ACGTN", (30, 20, 30, 20, 1), k=3 * draw.randrange(0, 120))) for _ in range(3000)] + ["", "AT", "ATG", "TAAGGAGGTACCATGAAA"]
    model = genes.CodingModel(np.array([draw.uniform(-3, 3) for _ in range(4096)]), genes=40)
    for use_rbs, allowed in ((True, tuple(genes.STARTS)), (False, ("ATG",))):
        began = time.process_time()
        singly = [(k, best) for k, x in enumerate(frames) if (best := genes.choose_start(x, model, use_rbs, allowed))]
        slow, began = time.process_time() - began, time.process_time()
        s = genes.choose_starts(frames, model, use_rbs, allowed)
        assert time.process_time() - began < slow / 3
        columns = (s.frame, s.rel, s.codon, s.total, s.coding, s.mean_lr, s.rbs_score, s.rbs_matches, s.rbs_spacer)
        assert [(k, genes.Choice(*rest, None if gap < 0 else gap)) for k, *rest, gap in zip(*(c.tolist() for c in columns), strict=True)] == singly


def test_counted_hexamers_and_joint_isoelectric_points(spark, monkeypatch):
    monkeypatch.setattr(annotate, "BASES", 50)
    seqs = ["ACGTTGCANACGTTGACGTACG" * 9, "ACGTA", "", "NNNNNNNN", "GATTACA"]
    wanted = Counter(x[k : k + 6] for x in seqs for k in range(len(x) - 5) if set(x[k : k + 6]) <= set("ACGT"))
    found = annotate.hexamers(spark.createDataFrame([(k, x) for k, x in enumerate(seqs)], "contig long, seq string")).collect()
    assert {r.hexamer: r.n for r in found} == wanted and len(found) == len(wanted)
    proteins = ["", "M", "MKKRRDE", "CCYYHHX*"]
    assert [None if x is None else round(x, 9) for x in protein.isoelectric_points(proteins)] == [None if (x := protein.isoelectric_point(p)) is None else round(x, 9) for p in proteins]


def test_features_without_parent_or_tag_are_dealt_out(spark):
    rows = spark.range(4000).selectExpr("1L AS contig", "id AS start", "id + 5 AS end", "'+' AS strand", "if(id % 50 = 0, 'gene', 'CDS') AS type", "id AS ord", "if(id % 50 = 0, concat('g', id), null) AS id", "if(id = 51, 'g50', null) AS parent", "CAST(null AS string) AS tag", "CAST(null AS string) AS name", "concat('p', id) AS product", "false AS is_pseudo")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k in before:
            spark.conf.set(k, "false" if "adaptive" in k else "-1")
        found = explorer.resolve_parents(rows)
        executed = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(coalesce(parent" in executed and "hashpartitioning(parent" not in executed
        assert {r.ord: r.gene_product for r in found.where("gene_product IS NOT NULL AND type <> 'gene'").collect()} == {51: "p50"}
        assert found.count() == 3999
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_minimizers_leave_a_task_in_small_batches(spark, monkeypatch):
    draw = random.Random(3)
    reads = spark.createDataFrame([(k, None if k == 7 else "".join(draw.choices("ACGT", k=200))) for k in range(60)], "read_idx long, seq string").coalesce(1)
    wanted = sorted(assembly.minimizers(reads).collect())
    single = [(r.read_idx, *x) for r in reads.collect() for x in zip(*(c.tolist() for c in assembly.sketch(r.seq or "")), strict=True)]
    monkeypatch.setattr(assembly, "SKETCHED", 1000)
    assert sorted(assembly.minimizers(reads).collect()) == wanted == sorted(single)


def test_a_band_has_the_path_of_all_cells(spark, monkeypatch):
    draw, cells, fill = np.random.default_rng(4), [], profiles._fill
    root = draw.integers(0, 4, 900)
    seqs = ["".join("ACGT"[(c + (draw.random() < 0.05)) % 4] for c in root if draw.random() > 0.01) for _ in range(6)]
    for some in (seqs, [*seqs[:3], seqs[3][:500], seqs[4][200:]], [seqs[0], seqs[1][::-1], seqs[2]]):
        wanted = profiles.progressive(some)
        with monkeypatch.context() as m:
            m.setattr(profiles, "DENSE", 100)
            m.setattr(profiles, "NARROW", 20)
            m.setattr(profiles, "SAMPLED", 100)
            m.setattr(profiles, "_fill", lambda *a: cells.append((found := fill(*a))[0].size) or found)
            assert profiles.progressive(some) == wanted
        if some is seqs:
            assert sum(cells) < 5 * 900 * 900 / 2  # five merges
    sets = spark.createDataFrame([(k, s, str(s), "ACGTACGT") for k in range(8) for s in range(2)], "aln_id long, seq_idx long, seq_id string, seq string")
    assert msa.align(sets)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1


def test_fastq_records_leave_tasks_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fastq, "HELD", 1000)
    (tmp_path / "a.fastq").write_text("".join(f"@r{k} d{k}\n{'ACGT' * 25}\n+\n{'I' * 100}\n" for k in range(50)))
    for reader in (fastq.FastqSource({"path": str(tmp_path)}).reader(None), fastq.FastqSource({"path": str(tmp_path)}).streamReader(None)):
        parts = reader.partitions() if not hasattr(reader, "log") else reader.partitions(reader.initialOffset(), reader.latestOffset())
        sizes = [b.num_rows for p in parts for b in reader.read(p)]
        assert sum(sizes) == 50 and max(sizes) <= 5
    fastq.register(spark)
    rows = spark.read.format("fastq").load(str(tmp_path))
    places = [pa.RecordBatch.from_pylist([{"file": r.file, "byte_start": r.byte_start, "byte_len": r.byte_len} for r in rows.collect()])]
    sizes = [b.num_rows for b in fastq._ranges(iter(places))]
    assert sum(sizes) == 50 and max(sizes) <= 5
    assert sorted((r.id, r.desc, r.seq) for r in fastq.fetch(rows).collect()) == sorted((f"r{k}", f"d{k}", "ACGT" * 25) for k in range(50))


def test_kmers_are_counted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "ADDED", 20)
    draw = random.Random(2)
    texts = [(k % 30 if k < 60 else k, None if k == 5 else "".join(draw.choices("ACGTNac", (30, 30, 30, 30, 5, 3, 3), k=draw.randrange(0, 90)))) for k in range(90)]
    for some in (texts, texts[30:]):
        of = {}
        for key, x in some:
            for p in range(len(x or "") - 3):
                if set(x[p : p + 4]) <= set("ACGT"):
                    of.setdefault(key, Counter())[x[p : p + 4]] += 1
        rows = spark.createDataFrame(some, "seq_idx long, seq string")
        assert {(r.seq_idx, r.kmer): r.n for r in alignment.kmers(rows, 4).collect()} == {(k, x): n for k, c in of.items() for x, n in c.items()}
        totals = alignment.kmer_totals(rows, 4)
        assert {r.kmer: (r.n, r.reads) for r in totals.collect()} == {x: (sum(c[x] for c in of.values()), sum(x in c for c in of.values())) for x in set().union(*of.values())}
        assert ("hashpartitioning(seq_idx" in totals._jdf.queryExecution().executedPlan().toString()) == (some is texts)


def test_hashes_are_counted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(assembly, "SKETCHED", 300)
    draw = random.Random(6)
    root = "".join(draw.choices("ACGT", k=900))
    rows = [(k * 7 % 50 if k < 60 else k + 100, None if k == 9 else root[(p := draw.randrange(800)) : p + 120] + "".join(draw.choices("ACGTNa", k=40))) for k in range(90)]
    for some in (rows, rows[55:]):
        for added in (40, 1 << 20):
            monkeypatch.setattr(assembly, "ADDED", added)
            reads = spark.createDataFrame(some, "read_idx long, seq string")
            sketches = assembly.minimizers(reads)
            of = {}
            for r in sketches.collect():
                of.setdefault(r.hash, []).append((r.read_idx, r.pos))
            counts = assembly.hash_counts(reads)
            assert {r.hash: (r.reads, r.entries, tuple(r.seen)) for r in counts.collect()} == {h: (len({x for x, _ in v}), len(v), min(v)) for h, v in of.items()}
            assert ("read_idx" in "".join(x for x in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)) == (some is rows)
            names = ["hash", "read_idx", "pos", "strand", "seen"]
            assert sorted(assembly.shared(reads, most=9).select(names).collect()) == sorted(assembly.index(sketches, 9).select(names).collect())


def test_draws_have_no_row_each(spark, monkeypatch):
    reps = spark.range(3).withColumnRenamed("id", "rep")
    wanted = {}
    for r in alignment.draws(1000, reps, 7).orderBy("rep", "k").collect():
        wanted.setdefault(r.rep, []).append(r.k)
    parts = {k: np.concatenate([alignment.drawn_columns(1000, k, 0, 300, 7), alignment.drawn_columns(1000, k, 300, 1000, 7)]) for k in range(3)}
    assert {k: sorted(v.tolist()) for k, v in parts.items()} == wanted
    cells = spark.range(1500).selectExpr("id % 3 AS seq_idx", "id div 3 AS col", "substr('ACGT', int(id * 7 % 11 % 4) + 1, 1) AS base")
    whole = sorted(phylo.bootstrap_distances(cells, 3, columns=64).collect())
    monkeypatch.setattr(phylo, "DRAWS", 130)
    rows = phylo.bootstrap_distances(cells, 3, columns=64)
    assert sorted(rows.collect()) == whole and "collect_list(place" not in rows._jdf.queryExecution().logical().toString()
    seen = phylo._drawn(500, 64, 42)(iter([pa.RecordBatch.from_pylist([{"rep": 1, "first": 0, "last": 500}])]))
    assert [b.num_rows for b in seen] == [8]


def test_no_python_worker_gets_the_letters_of_skew_tracks(spark, sf_dir):
    assert "Arrow" not in planned(formats.chunk_skew_tracks(spark, sf_dir))
    draw = random.Random(8)
    odd = ["", "A", "acgtN", "G\nC\r" * 40, "\U0001f9ecGé" * 150, "ACGT" * 16, *("".join(draw.choices("ACGTNgc-", k=n)) for n in (31, 32, 33, 63, 64, 65, 128, 1000, 4999))]
    contigs = spark.createDataFrame([(k, x) for k, x in enumerate([*odd, None])], "contig long, seq string")
    for size in (64, 100):
        table = chunks.cut(contigs, size)
        found = sorted(tuple(r) for r in table.collect())
        assert found == [(k, len(x), at, x[at : at + size]) for k, x in enumerate(odd) for at in range(0, max(1, len(x)), size)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=table.columns)
        for least, parts in ((32, 1400), (33, 7), (50, 3)):
            wanted = [tuple(r.values()) for b in chunked._cells(least, parts)(iter([batch])) for r in b.to_pylist()]
            assert sorted(tuple(r) for r in chunked.cells(table, least, parts).collect()) == sorted(wanted)


def test_origins_over_chunks_use_no_python_worker(spark, sf_dir):
    for query in (formats.chunk_ori_ter, formats.chunk_gc_track):
        assert "Arrow" not in planned(query(spark, sf_dir))
    draw = random.Random(9)
    seqs = ["".join(draw.choices("ACGTN", weights, k=n)) for n, weights in ((33, (1, 1, 1, 1, 0)), (700, (1, 5, 1, 1, 1)), (5000, (1, 1, 5, 1, 2)), (47_000, (1, 1, 1, 1, 0)), (400, (0, 0, 0, 0, 1)), (20, (1, 1, 1, 1, 0)))]
    wanted = set()
    for k, x in enumerate(seqs):
        win, total, seen = max(32, len(x) // 1400), 0.0, []
        for at in range(0, len(x) - win + 1, win // 2):
            g, c, known = (sum(map(x[at : at + win].count, some)) for some in ("G", "C", "ACGT"))
            if known >= win * 0.5:
                total += (g - c) / (g + c) if g + c else 0.0
                seen.append((np.floor(total * 1e9 + 0.5) / 1e9, at))
        if seen:
            wanted.add((k, min(seen)[1], min((-cum, at) for cum, at in seen)[1]))
    contigs = spark.createDataFrame(list(enumerate(seqs)), "contig long, seq string")
    assert len(wanted) == 4
    for size in (64, 1000, 4096):
        assert {tuple(r) for r in explorer.origin_terminus(chunked.skew_tracks(chunks.cut(contigs, size))).collect()} == wanted
