"""Near-duplicate groups by SimHash, with an exact tiled comparison.

A fingerprint has 64 bits; bit k is set if it is set in over half of the XXH64
values of the text's three-word shingles. All pairs of different fingerprints
within RADIUS bits are found exactly: fingerprints are dealt into tiles by the
bit counts of their two halves, a pair of tiles is skipped if those counts
differ by more than the radius in all (the bits differ by as much at least), and
the other pairs of tiles are compared by exclusive-or and bit counts in numpy.
A tile pair reports the edges of a spanning forest of its links, not all links,
so a group of k near copies never makes k * k rows. Components over the forests
give the same groups as all links.

Equal fingerprints are one node, counted beforehand with partial sums. Tiles hold
about TILE fingerprints; larger cells are split by a hash. Tiles stand in files of
the shared folder; the list of tile pairs is made and dealt by Spark, and tasks
read the tiles that they compare. The comparison is quadratic by the method; the
counts of the halves leave about a fifth of it.

Defined results: a null or empty text, or one of white space only, has the
fingerprint zero and links like any other; a text of one or two words is one
shingle; texts are hashed in blocks, whatever their length; rows that repeat an
id appear as often; a null id belongs to the group but never names it unless all
its ids are null; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import Appender, fresh_path, materialize, may_hold, store, table
from helixloom.operators.components import components

WORDS, SEED, RADIUS = 3, 42, 3
SALTS = 8
TILE, BLOCK_ROWS, BLOCK_COLUMNS = 1 << 15, 64, 1 << 13
HASHES = 1 << 16
LAST_ID = (1 << 63) - 1
TILES = "high int, low int, part int, file string, at long, size long"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fingerprint(text: str | None) -> int:
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower() is A-Z alone
    gap = SPACE[raw]
    word = ~gap
    first = word.copy()
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return 0
    last = word.copy()
    last[:-1] &= gap[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    keep = word.copy()
    keep[starts[1:] - 1] = True  # one space before each word but the first
    joined = np.where(gap, np.uint8(0x20), raw)[keep].tobytes()
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    begins, ends = (begins[: 1 - WORDS], ends[WORDS - 1 :]) if len(starts) >= WORDS else (begins[:1], ends[-1:])
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), HASHES):
        spans = zip(begins[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist(), strict=True)
        hashes = np.array([digest(joined[b:e], SEED) for b, e in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text_hash", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, fp): the fingerprint as a signed long."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a and b (both unsigned, without repeats inside)."""
    root = np.arange(len(a) + len(b))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    edges = []
    low_a, low_b = a.astype(np.uint32), b.astype(np.uint32)  # the low halves; a link has few differing bits there too
    for s in range(0, len(a), BLOCK_ROWS):
        for t in range(0, len(b), BLOCK_COLUMNS):
            near = np.bitwise_count(low_a[s : s + BLOCK_ROWS, None] ^ low_b[None, t : t + BLOCK_COLUMNS]) <= radius
            if not near.any():
                continue
            i, j = np.nonzero(near)
            i, j = i + s, j + t
            fit = np.bitwise_count(a[i] ^ b[j]) <= radius
            i, j = i[fit], j[fit]
            pair = np.stack([[find(x) for x in i], [find(len(a) + x) for x in j]]) if len(i) < 64 else np.stack([root[i], root[len(a) + j]])
            _, one = np.unique(pair[:, pair[0] != pair[1]], axis=1, return_index=True)
            one = np.flatnonzero(pair[0] != pair[1])[one]
            for x, y in zip(i[one].tolist(), j[one].tolist(), strict=True):
                if (p := find(x)) != (q := find(len(a) + y)):
                    root[max(p, q)] = min(p, q)
                    if a[x] != b[y]:
                        edges.append((int(a[x].view(np.int64)), int(b[y].view(np.int64))))
    return edges


def _store_tiles(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = Appender(folder, ".tiles"), []
        for batch in batches:
            for high, low, part, fps in zip(*batch.columns, strict=True):
                rows.append((high.as_py(), low.as_py(), part.as_py(), *out.add(fps.values.to_numpy().tobytes())))
        out.close()  # places are reported only for files that are complete
        if rows:
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in TILES.split(", ")])

    return run


def _links(folder: str, radius: int):
    """Of rows (file, at, size, file_2, at_2, size_2): the forests of the tile pairs, whose tiles are read from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)

        @lru_cache(maxsize=16)
        def tile(name: str, at: int, size: int) -> np.ndarray:
            with files.open_input_file(f"{base}/{name}") as source:
                return np.frombuffer(source.read_at(size, at), np.uint64)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edges := forest(tile(*row[:3]), tile(*row[3:]), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the fingerprints ``fp`` of ``distinct`` as all links within the radius would."""
    halves = distinct.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("high"), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)).alias("low"))
    halves = halves.withColumn("high", F.col("high").cast("int")).withColumn("low", F.col("low").cast("int"))
    sizes = halves.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))  # at most 33 * 33 rows
    parts = {(r["high"], r["low"]): -(-r["n"] // tile) for r in sizes.collect()}
    if not parts:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    split = F.element_at(F.create_map(*[F.lit(x) for (h, lo), n in parts.items() for x in (h * 33 + lo, n)]), F.col("high") * 33 + F.col("low"))
    dealt = halves.withColumn("part", F.pmod(F.xxhash64("fp"), split).cast("int")).groupBy("high", "low", "part").agg(F.collect_list("fp").alias("fps"))
    folder = fresh_path(distinct.sparkSession, "tiles")
    tiles = materialize(dealt.mapInArrow(_store_tiles(folder), TILES), "tile-places")
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(abs(a) - radius, radius - abs(a) + 1)]
    near = tiles.withColumn("step", F.explode(F.array(*steps))).withColumn("high_2", F.col("high") + F.col("step.a")).withColumn("low_2", F.col("low") + F.col("step.b"))
    other = tiles.select(*[F.col(c).alias(f"{c}_2") for c in tiles.columns])
    pairs = near.join(other, ["high_2", "low_2"]).where(F.struct("high", "low", "part") <= F.struct("high_2", "low_2", "part_2"))
    pairs = materialize(pairs.select("file", "at", "size", "file_2", "at_2", "size_2"), "tile-pairs")  # narrow: places, not fingerprints
    spread = pairs.repartition(max(12, min(pairs.count() // 8, 65536)))
    return spread.mapInArrow(_links(folder, radius), "u long, v long")


def _grouped(docs: DataFrame, radius: int, first: Column) -> DataFrame:
    """Rows (fp, first): the least ``first`` of the group of each fingerprint of ``docs``."""
    nodes = materialize(docs.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    roots = components(links(nodes, radius)).withColumnRenamed("u", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("first"))
    return materialize(placed.drop("first").join(named, "root").select("fp", "first"), "labels")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    docs = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    labels = _grouped(docs, radius, F.col("doc_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    salted = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one fingerprint may be a third of all rows
    docs = docs.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return docs.join(salted, ["fp", "salt"]).select("doc_id", hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group: that with the smallest id (null ids last), of equal ids the one with the least hash of its text.

    Rows that share an id but not the text are rows of their own; of rows that repeat id and text one
    stays, the least by its other columns. Only rows that a filter of bounded size takes for dropped
    or repeated meet the decisions; all others pass as they are read.
    """
    docs = materialize(fingerprints(df, id_col, text_col), "fingerprints").withColumn("rank", F.coalesce("doc_id", F.lit(LAST_ID)))
    key = F.struct("rank", "text_hash")
    counted = docs.groupBy("rank", "text_hash", "fp").agg(F.count(F.lit(1)).alias("n"))
    labels = _grouped(docs, radius, key)
    marks = counted.join(labels, "fp").select("rank", "text_hash", (key != F.col("first")).alias("gone"), "n").where("gone or n > 1")
    marks = materialize(marks.select(F.col("rank").alias("__rank"), F.col("text_hash").alias("__hash"), "gone"), "marks").withColumnRenamed("gone", "__gone")
    rank, text_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), _text_hash(text_col)
    marked = may_hold(df, F.xxhash64(rank, text_hash), marks.select(F.xxhash64("__rank", "__hash").alias("key")), "__held")
    met = marked.where("__held").join(marks, (rank == F.col("__rank")) & (text_hash == F.col("__hash")), "left").where("__gone is null or not __gone")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    repeated = met.where("__gone is not null").groupBy("__rank", "__hash").agg(F.min(whole).alias("row")).select("row.*")
    return marked.where("not __held").select(*df.columns).unionByName(met.where("__gone is null").select(*df.columns)).unionByName(repeated)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLES: dict[str, str] = {}
