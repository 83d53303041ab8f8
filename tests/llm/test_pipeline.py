"""The pipeline on a small table: each stage's decisions, columns and empty input."""

import numpy as np

import corpus_pipeline
from helixloom.llm import decontamination, packing, simhash, toxicity
from tests.llm.test_operators import brute_fingerprint, brute_tiling, xx
from tests.llm.test_passage_dedup import brute as brute_passages

LAST = (1 << 63) - 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.count()
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    assert total >= sizes[0] == sizes[1] >= sizes[2] >= sizes[3] > total // 2
    groups = simhash.near_duplicates(docs).collect()
    assert all(r.doc_id == r.component_id for r in groups)
    packed = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert max(r.offset + r.length for r in packed) <= packing.WINDOW


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def hostile(rng):
    """Rows with nulls, repeats, shared ids, near copies, passages, benchmark items and toxic texts."""
    words = [f"w{k}" for k in range(900)]
    passage, item = " ".join(f"p{k}" for k in range(70)), " ".join(f"b{k}" for k in range(30))

    def own(n):
        return " ".join(rng.choice(words, n))

    toxic = [f"{own(30)} you utter zorbla idiot {own(10)}" for _ in range(60)]
    long = own(400)
    near = long.split()
    near[200] = "changed"
    texts = [own(60) for _ in range(140)] + [None, "", " \n ", "one", long, " ".join(near), f"{own(20)} {passage} {own(25)}", f"{own(9)}\n{passage} {own(30)}", f"{own(40)} {item} {own(5)}", own(3000)]
    rows = [(k, t) for k, t in enumerate(toxic + texts)]
    rows += [(300, own(50)), (300, own(50)), (300, texts[0]), (400, texts[1]), (400, texts[1]), (None, texts[2]), (None, own(40)), (None, own(40)), (None, item), (500, long), (500, long)]
    labels = [(k, int(k % 3 == 0), int(k < 60)) for k in range(190)]
    return [(k, t, "en", f"s{(k or 0) % 3}", None if t is None else len(t)) for k, t in rows], labels, [(1, item), (2, None), (3, "")]


def expected(spark, rows, labels, bench):
    """The pipeline in plain Python: what each stage keeps, and its token counts."""
    rank = lambda r: (LAST if r[0] is None else r[0], xx(r[1]))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.learn(toxicity.labelled_rows(docs, spark.createDataFrame(labels, LABELS)))
    make = toxicity.Features(model.learned)
    kept = [r for r in rows if model.score(make.matrix([r[1]]))[0] < 0.3]
    sizes = [len(kept)]
    order = sorted({(rank(r), r[1]) for r in kept}, key=lambda x: x[0])
    texts = brute_passages([(k, text) for k, (_, text) in enumerate(order)])
    cut = {key: texts[k][0] for k, (key, _) in enumerate(order)}
    kept = [(r[0], cut[rank(r)], r[2], r[3], None if cut[rank(r)] is None else len(cut[rank(r)])) for r in kept]
    sizes.append(len(kept))
    prints = [brute_fingerprint(r[1]) for r in kept]
    group = list(range(len(kept)))

    def find(k):
        return k if group[k] == k else find(group[k])

    for a in range(len(kept)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[find(a)] = find(b)
    first = {}
    for k, r in enumerate(kept):
        first[find(k)] = min(first.get(find(k), r), r, key=lambda r: (rank(r), r[3]))
    kept = list(first.values())
    sizes.append(len(kept))
    items = [decontamination.words(t) for _, t in bench if decontamination.words(t)]

    def leaks(text):
        doc = decontamination.words(text)
        number = {w: k for k, w in enumerate({*doc, *sum(items, [])})}
        ids = [np.array([number[w] for w in x], int) for x in (*items, doc)]
        return any(brute_tiling(x, ids[-1], min(5, len(x))) >= 0.5 * len(x) for x in ids[:-1])

    kept = [r for r in kept if not leaks(r[1])]
    return [*sizes, len(kept)], kept


def test_run_equals_plain_python(spark, tmp_path):
    rows, labels, bench = hostile(np.random.default_rng(12))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", __held string, h int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes, kept = expected(spark, rows, labels, bench)
    assert sizes[0] < len(rows) and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    left = docs
    for (_, stage), n in zip(corpus_pipeline.STAGES[:-1], sizes, strict=True):
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.count() == n
    assert sorted(map(repr, (tuple(r) for r in left.collect()))) == sorted(map(repr, kept))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.tokens()
    wanted = sorted(repr((r[0], len(tokens.exact.encode(r[1] or "", add_special_tokens=False).ids) + 1)) for r in kept)
    assert sorted(repr((r.doc_id, r.doc_tokens)) for r in found if r.start == 0) == wanted
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)


def test_unique_rows_that_share_an_id_stay(spark):
    t, u = " ".join(f"t{k}" for k in range(90)), " ".join(f"u{k}" for k in range(90))
    rows = [(1, t), (2, t), (2, u), (1, t), (None, u), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, ""), (1, t), (2, u)]


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
