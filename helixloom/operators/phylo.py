"""Trees from distances: building, bootstrap, supports. Trees are built in grouped functions, one group a replicate.

Tables: distances (i, j, d) with i < j; taxa (seq_idx, name); alignment (seq_idx, col, base).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.functions import trees
from helixloom.operators import alignment as A
from helixloom.session import exists, materialize

MAX_REPLICATES = 1000
BLOCK, KEPT, BATCH = 1024, 4_000_000, 25
DRAWS, TASKS = 1 << 20, 64  # draws of a range, and the partitions of the ranges
METHODS: dict[str, Callable] = {"nj": trees.neighbor_joining, "upgma": trees.upgma}


def matrix(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    d = np.zeros((len(names), len(names)))
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    d[i, j] = d[j, i] = rows["d"].to_numpy()
    return d


def checked(method: str, model: str, replicates: int) -> int:
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    if model not in ("p", "jc", "k2p"):
        raise ValueError("model must be p, jc or k2p")
    return max(0, min(MAX_REPLICATES, replicates))


def aligned(alignment: DataFrame) -> None:
    """An alignment has three sequences or more, all of one length."""
    n, shortest, longest = alignment.groupBy("seq_idx").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    if n < 3:
        raise ValueError("a tree needs three sequences or more")
    if shortest != longest:
        raise ValueError("sequences differ in length; align them first")


def build_trees(distances: DataFrame, names: list[str], method: str = "nj", rooting: str = "none", key: str = "rep") -> DataFrame:
    """key, newick, clamped, splits: a tree for each group of distances. A group holds the pairs of one matrix."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = METHODS[method](matrix(rows, names), names)
        found = sorted(trees.splits(tree, names))
        tree = trees.midpoint(tree) if rooting == "midpoint" else tree
        return pd.DataFrame({key: [rows[key].iloc[0]], "newick": [trees.to_newick(tree)], "clamped": [tree.clamped], "splits": [found]})

    return distances.select(key, "i", "j", "d").groupBy(key).applyInPandas(build, f"{key} long, newick string, clamped long, splits array<string>")


def _weighted(columns: int):
    """Of rows (block, kind, key, bases, drawn, at), one block after the other: sums (rep, i, j, comp, diffs, ti) of the pairs of sequences.

    A block is a matrix of sequences by columns, and the replicates' draws in it a matrix of columns by replicates, so a product of
    matrices gives all replicates of a sequence against all others at once. Sums are kept over blocks while they are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (i, others, reps), sums in kept.items():
                shape = sums.shape[1:]
                at = np.flatnonzero(sums.any(0).ravel())
                columns_ = [np.array(reps)[at % shape[1]], np.full(len(at), i), np.array(others)[at // shape[1]], *(s.ravel()[at] for s in sums)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns_], names=["rep", "i", "j", "comp", "diffs", "ti"])
            kept.clear()

        def add(rows: list[tuple]) -> None:
            seqs, drawn = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
            reps = tuple(sorted({r[2] for r in drawn}))
            weight = np.zeros((columns, len(reps)))
            for r in drawn:  # a replicate has a row for each range of its draws
                weight[:, reps.index(r[2])] += np.bincount(np.frombuffer(r[4], "<u4"), minlength=columns)
            codes = np.full((len(seqs), columns), ord("-"), np.uint8)
            for line, r in zip(codes, seqs, strict=True):
                if len(set(r[5])) < len(r[5]):
                    raise ValueError(f"sequence {r[2]} has two bases in one column")
                line[r[5]] = np.frombuffer(r[3].encode(), np.uint8)
            base = np.full(codes.shape, -1, np.int8)
            for k, letter in enumerate(b"ACGT"):
                base[codes == letter] = k
            for x in range(len(seqs) - 1):
                both = (base[x] >= 0) & (base[x + 1 :] >= 0)
                differ = both & (base[x] != base[x + 1 :])
                turned = differ & ((base[x] ^ base[x + 1 :]) == 2)  # A and G, C and T
                sums = np.stack([np.rint(m @ weight) for m in (both, differ, turned)]).astype(np.int64)
                key = (seqs[x][2], tuple(s[2] for s in seqs[x + 1 :]), reps)
                kept[key] = kept[key] + sums if key in kept else sums

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    if any(r[1] for r in held) and any(not r[1] for r in held):
                        add(held)
                    held = []
                    if sum(s.size for s in kept.values()) > KEPT:
                        yield from out()
                held.append(row)
        if any(r[1] for r in held) and any(not r[1] for r in held):
            add(held)
        yield from out()

    return run


def _drawn(n: int, columns: int, seed: int):
    """Of rows (rep, first, last), ranges of a replicate's draws: rows (block, kind, key, bases, drawn, at), the places that the range draws in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = A.drawn_columns(n, rep, first, last, seed)
                k = k[np.argsort(k // columns, kind="stable")]
                block, at = k // columns, (k % columns).astype("<u4")
                begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                ends = np.append(begins[1:], len(k))
                m = len(begins)
                places = pa.array([at[x:y].tobytes() for x, y in zip(begins, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block[begins]), pa.array(np.ones(m, np.int32)), pa.array(np.full(m, rep)), pa.nulls(m, pa.string()), places, pa.nulls(m, pa.list_(pa.int32()))], names=["block", "kind", "key", "bases", "drawn", "at"])

    return run


def bootstrap_distances(alignment: DataFrame, replicates: int | DataFrame, model: str = "jc", seed: int = 42, complete: bool = False, columns: int = BLOCK) -> DataFrame:
    """rep, i, j, d of the replicates 0 to ``replicates``, or of those in a table (rep).

    Columns are dealt in blocks. A sequence has one row in a block, its bases there, and a replicate one for each range of its
    draws, the columns that it draws there; there is no row for a draw, nor for a column, pair and replicate.
    """
    kept = A.complete_columns(alignment) if complete else alignment
    reps = alignment.sparkSession.range(replicates).select(F.col("id").alias("rep")) if isinstance(replicates, int) else replicates
    placed = materialize(A.numbered(kept.select("col").distinct()), "columns")
    n = placed.count()
    if not n:
        return alignment.sparkSession.createDataFrame([], "rep long, i long, j long, d double")
    block, place = F.floor(F.col("k") / columns).alias("block"), (F.col("k") % columns).cast("int")
    cells = kept.join(placed, "col").select("seq_idx", block, place.alias("at"), F.when(F.col("base").isin(*"ACGT"), F.col("base")).otherwise("-").alias("base"))
    found = F.collect_list(F.struct("at", "base")).alias("found")
    sequences = cells.groupBy("block", "seq_idx").agg(found).select("block", F.lit(0).alias("kind"), F.col("seq_idx").cast("long").alias("key"), F.array_join("found.base", "").alias("bases"), F.lit(None).cast("binary").alias("drawn"), F.col("found.at").alias("at"))
    ranges = reps.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(DRAWS).cast("long"))).alias("first"))
    ranges = ranges.select("rep", "first", F.least(F.col("first") + DRAWS, F.lit(n)).alias("last")).repartition(TASKS, "rep", "first")
    drawn = ranges.mapInArrow(_drawn(n, columns, seed), "block long, kind int, key long, bases string, drawn binary, at array<int>")
    rows = sequences.unionByName(drawn).repartition("block").sortWithinPartitions("block", "kind", "key")
    sums = rows.mapInArrow(_weighted(columns), "rep long, i long, j long, comp long, diffs long, ti long").groupBy("rep", "i", "j").agg(*[F.sum(c).alias(c) for c in ("comp", "diffs", "ti")])
    d, _ = A.distance(model)
    return sums.where("comp > 0").withColumn("tv", F.col("diffs") - F.col("ti")).select("rep", "i", "j", d.alias("d"))


def replicate_trees(alignment: DataFrame, names: list[str], replicates: int, method: str = "nj", model: str = "jc", seed: int = 42, complete: bool = False, ledger: str | None = None, batch: int = BATCH) -> DataFrame:
    """rep, newick, clamped, splits of the replicates.

    With a ``ledger``, a folder that driver and executors share, finished replicates are kept there, some at a time, and a
    run that finds some of them makes only the others. A replicate's draws depend on its number alone, so a stopped and resumed
    run gives what one run gives. A ledger of another alignment, method, model or seed is an error.
    """
    spark = alignment.sparkSession
    if ledger is None:
        return build_trees(bootstrap_distances(alignment, replicates, model, seed, complete), names, method)
    cells = alignment.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("seq_idx", "col", "base"))).first()
    run = ":".join(map(str, (*cells, *names, method, model, seed, complete)))
    schema = "rep long, newick string, clamped long, splits array<string>, run string"

    def kept() -> DataFrame:
        return spark.read.schema(schema).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], schema)

    if kept().where(F.col("run") != run).limit(1).count():
        raise ValueError("the ledger is of another bootstrap")
    done = {r["rep"] for r in kept().select("rep").collect()}  # at most MAX_REPLICATES
    left = [r for r in range(replicates) if r not in done]
    for k in range(0, len(left), batch):
        reps = spark.createDataFrame([(r,) for r in left[k : k + batch]], "rep long")
        made = build_trees(bootstrap_distances(alignment, reps, model, seed, complete), names, method)
        made.withColumn("run", F.lit(run)).write.mode("append").parquet(ledger)
    return kept().where(F.col("rep") < replicates).dropDuplicates(["rep"]).drop("run")


def split_tally(built: DataFrame) -> DataFrame:
    """split, n over the replicates' trees."""
    return built.select(F.explode("splits").alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def tree_with_support(alignment: DataFrame, names: list[str], method: str = "nj", model: str = "jc", rooting: str = "midpoint", replicates: int = 100, seed: int = 42, complete: bool = False, ledger: str | None = None) -> DataFrame:
    """One row: newick with supports, clamped limbs, replicates.

    Replicates are trees of their own tasks; only split counts of one taxon set meet again. With a ``ledger`` they can be resumed.
    """
    replicates = checked(method, model, replicates)
    aligned(alignment)
    kept = A.complete_columns(alignment) if complete else alignment
    main = A.distances(A.pairs(kept), model).select(F.lit(0).cast("long").alias("rep"), "i", "j", "d")
    tally = split_tally(replicate_trees(alignment, names, replicates, method, model, seed, complete, ledger)) if replicates else None
    hits = {r["split"]: r["n"] for r in tally.collect()} if tally is not None else {}  # at most replicates x (taxa - 3) splits

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = METHODS[method](matrix(rows, names), names)
        tree = trees.midpoint(tree) if rooting == "midpoint" else tree
        if replicates:
            trees.annotate(tree, names, hits, replicates)
        return pd.DataFrame({"newick": [trees.to_newick(tree)], "clamped": [tree.clamped], "replicates": [replicates]})

    return main.groupBy("rep").applyInPandas(build, "newick string, clamped long, replicates long")


def tree_nodes(newicks: DataFrame, key: str = "tree_id") -> DataFrame:
    """key, node_id, parent_id, child_ord, name, branch_len, support, depth, row of each node of rows (key, newick)."""

    def parse(batches):
        for batch in batches:
            out = []
            for tree_id, text in zip(batch[key], batch["newick"], strict=True):
                tree = trees.parse_newick(text)
                above = {c: (k, o) for k, node in enumerate(tree.nodes) for o, c in enumerate(node.children)}
                for (k, depth, row), node in zip(trees.geometry(tree), tree.nodes, strict=True):
                    parent, order = above.get(k, (None, 0))
                    out.append((tree_id, k, parent, order, node.name, node.length, node.support, depth, row))
            frame = pd.DataFrame(out, columns=[key, "node_id", "parent_id", "child_ord", "name", "branch_len", "support", "depth", "row"])
            yield frame.astype({"parent_id": "Int64", "support": "Int64"})

    return newicks.select(key, "newick").mapInPandas(parse, f"{key} long, node_id int, parent_id int, child_ord int, name string, branch_len double, support int, depth double, row double")


def sample_clades(newick: str, samples: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """sample, stratum: the clade of each sample in a tree, or one of its own."""
    found = trees.clades(trees.parse_newick(newick), cutoff)
    labels = samples.sparkSession.createDataFrame(list(found.items()), "sample string, stratum string")
    return samples.select(F.col("sample").cast("string").alias("sample")).join(labels, "sample", "left").select("sample", F.coalesce("stratum", F.concat(F.lit("unplaced_"), "sample")).alias("stratum"))
