"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences. Runs of MIN_MATCH shared words
are seeds, found by a rolling Karp-Rabin hash of word numbers and checked word by
word. An item of fewer words contaminates nothing, as any text may name it, unless
``min_words`` lets such items in; they then match by their whole length. Along a diagonal,
seeds grow to maximal matches. The longest match free of marked words is marked,
again and again; what is left of a match beside marked words comes back as a
shorter one. The marked words cover the item wherever its parts stand, so
reordered passages are found too. A document is contaminated by an item if the
tiles cover at least COVERAGE of the item's words.

Matches on one diagonal are found for whole texts at once, an array step for each
word of the item, and matches of one item place and length are tiled as one
group, so texts that repeat a word a million times take seconds.

Every document is read once, without a shuffle, against an index of the
benchmark of bounded size: a benchmark of more than MAX_INDEX_CHARS characters
is dealt into blocks of items, and a task looks some documents at a time up in one
block after the other.
Tasks build the indexes and leave them in the shared folder; no item passes the
driver.

Defined results: null and empty texts match nothing, nor do items without words;
ties go to the earlier place in the item, then in the document; repeated rows
give repeated results; very long and very repetitive documents are matched
whole; empty tables give an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
import pickle
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import fresh_path, materialize, store, table

WORD = re.compile(r"\w+")
MIN_MATCH, COVERAGE = 5, 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)
MAX_INDEX_CHARS = 16_000_000
GROUP_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, coverage double, tiles int, matched_words int, item_words int"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rolling(numbers: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n numbers."""
    key = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    for k in range(n):
        key = key * BASE + numbers[k : k + len(key)].astype(np.uint64) + np.uint64(1)
    return key


Group = tuple[int, int, np.ndarray]  # matches of one length at one item place, and where they are in the document


def diagonals(item: np.ndarray, doc: np.ndarray, at: np.ndarray, least: int) -> list[Group]:
    """The maximal matches of ``least`` words or more whose words lie at the document's places ``at``, in order."""
    text, n = doc[at], len(at)
    follows = np.append(False, np.diff(at) == 1)  # whether a place is the one after the place before it in ``at``
    run, found = np.zeros(n, np.int64), []
    for i in range(len(item) + 1):
        longer = np.zeros(n, np.int64)
        if i < len(item):
            before = np.append(0, run[:-1]) * follows
            longer = np.where(text == item[i], before + 1, 0)
        goes_on = np.append(longer[1:] * follows[1:] > 1, False)
        ended = np.flatnonzero((run >= least) & ~goes_on)
        for length in np.unique(run[ended]).tolist():
            found.append((length, i - length, at[ended[run[ended] == length]] - length + 1))
        run = longer
    return found


def _free(tiles: list[tuple[int, int]], start: int, stop: int, least: int) -> list[tuple[int, int]]:
    """What the tiles leave of the words start to stop, in parts of ``least`` words or more."""
    out = []
    for a, b in [*tiles, (stop, stop)]:  # the tiles are sorted and apart
        if min(a, stop) - start >= least:
            out.append((start, min(a, stop)))
        start = max(start, b)
    return out


def tiling(groups: list[Group], item_length: int) -> list[tuple[int, int, int]]:
    """Tiles (length, item place, document place) of maximal matches, longest first, then earliest in the item and the document."""
    least = min(MIN_MATCH, item_length)
    waiting: dict[tuple[int, int], list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def push(length: int, i: int, places: np.ndarray) -> None:
        if (key := (-length, i)) not in waiting:
            waiting[key] = []
            heapq.heappush(heap, key)
        waiting[key].append(places)

    for group in groups:
        push(*group)
    in_item: list[tuple[int, int]] = []
    in_doc: list[tuple[int, int]] = []
    tiles = []
    while heap:
        key = heapq.heappop(heap)
        length, i = -key[0], key[1]
        places = np.unique(np.concatenate(waiting.pop(key)))
        parts = _free(in_item, i, i + length, least)
        if parts != [(i, i + length)]:
            for a, b in parts:
                push(b - a, a, places + (a - i))
            continue
        met = np.zeros(len(places), bool)
        for a, b in in_doc:
            met |= (places < b) & (places + length > a)
        clear = places[~met]
        if len(clear):
            j = int(clear[0])
            tiles.append((length, i, j))
            in_item, in_doc = sorted([*in_item, (i, i + length)]), sorted([*in_doc, (j, j + length)])
            met, places = np.zeros(0, bool), places[:0]  # the item's words are taken for all others
        for j in places[met].tolist():
            for a, b in _free(in_doc, j, j + length, least):
                push(b - a, i + a - j, np.array([a]))
    return tiles


class Index:
    """Seeds of the items: for each length, sorted hashes and the items that have them."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int = MIN_MATCH):
        self.number: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            if len(found := words(text)) >= max(1, min_words):
                self.items.append((item_id, np.array([self.number.setdefault(w, len(self.number)) for w in found], np.int64)))
        keys: dict[int, list[np.ndarray]] = {}
        for at, (_, numbers) in enumerate(self.items):
            n = min(MIN_MATCH, len(numbers))
            own = np.unique(rolling(numbers, n))
            keys.setdefault(n, []).append(np.stack([own, np.full(len(own), at, np.uint64)]))
        self.seeds = {}
        for n, parts in keys.items():
            key, item = np.concatenate(parts, axis=1)
            order = np.lexsort((item, key))
            self.seeds[n] = key[order], item[order].astype(np.int64)

    def matches(self, text: str | None) -> Iterator[tuple[int, float, int, int, int]]:
        """Of each item that shares a seed: item_id, coverage, tiles, matched words, words."""
        get = self.number.get
        doc = np.array([get(w, -1) for w in words(text)], np.int64)
        known = doc >= 0
        for n, (keys, items) in self.seeds.items():
            if len(doc) < n:
                continue
            whole = np.convolve(known, np.ones(n, np.int64), "valid") == n if n > 1 else known
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            near = (at[:, None] + np.arange(n)).ravel()  # only the runs of known words are hashed
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = key * BASE + doc[near[k::n]].astype(np.uint64) + np.uint64(1)
            first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(last > first)
            if not len(hit):
                continue
            shared, kind = np.unique(key[hit], return_inverse=True)  # a frequent seed counts once
            spans = [items[a:b] for a, b in zip(np.searchsorted(keys, shared, "left"), np.searchsorted(keys, shared, "right"), strict=True)]
            for item in np.unique(np.concatenate(spans)).tolist():
                holds = np.array([item in span for span in spans])
                seeds = at[hit[holds[kind]]]
                places = np.unique(seeds[:, None] + np.arange(n))
                item_id, numbers = self.items[item]
                tiles = tiling(diagonals(numbers, doc, places, n), len(numbers))
                if covered := sum(t[0] for t in tiles):
                    yield item_id, covered / len(numbers), len(tiles), covered, len(numbers)


def _build(folder: str, min_words: int):
    """Of rows (block, item_id, text), one block after the other: the index of each block as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        rows: dict[int, list[tuple]] = {}
        for batch in batches:
            for block, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(block, []).append((item_id, text))
        for block, items in rows.items():
            items.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
            files.create_dir(path, recursive=True)
            name = f"{path}/index-{block}-{uuid.uuid4().hex}"  # of attempts that are run again, only the reported file is read
            with files.open_output_stream(name) as out:
                out.write(pickle.dumps(Index(items, min_words)))
            yield pa.RecordBatch.from_pydict({"block": [block], "path": [name]}, schema=pa.schema([("block", pa.int32()), ("path", pa.string())]))

    return run


@lru_cache(maxsize=1)
def _load(folder: str, name: str) -> Index:
    with store(folder)[0].open_input_stream(name) as source:
        return pickle.loads(source.read())  # written by this job's own tasks


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Some batches at a time, so that a block is loaded once for all of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _match(folder: str, names: list[str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            for name in names:
                find = _load(folder, name).matches
                rows = [(doc_id, *m) for batch in group for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in find(text.as_py()) if m[1] >= coverage]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _clean(folder: str, names: list[str], text_at: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            kept = [np.ones(batch.num_rows, bool) for batch in group]
            for name in names:
                find = _load(folder, name).matches
                for batch, keep in zip(group, kept, strict=True):
                    for k in np.flatnonzero(keep).tolist():
                        keep[k] = not any(m[1] >= coverage for m in find(batch.column(text_at)[k].as_py()))
            yield from (batch.filter(pa.array(keep)) for batch, keep in zip(group, kept, strict=True))

    return run


def indexes(benchmark: DataFrame, max_index_chars: int, min_words: int = MIN_MATCH) -> tuple[str, list[str]]:
    """The folder of the indexes, and the path of each: blocks of about ``max_index_chars`` characters, built by tasks."""
    size = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // max_index_chars))
    folder = fresh_path(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"), F.col("item_id").cast("long").alias("item_id"), "text")
    built = materialize(items.repartition(blocks, "block").mapInArrow(_build(folder, min_words), "block int, path string"), "benchmark-blocks")
    return folder, [r["path"] for r in built.orderBy("block").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, max_index_chars: int = MAX_INDEX_CHARS, min_words: int = MIN_MATCH) -> DataFrame:
    """A row for each document and item whose words the document covers to at least ``coverage``; items of under ``min_words`` words take no part."""
    folder, names = indexes(benchmark, max_index_chars, min_words)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_match(folder, names, coverage), SCHEMA)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, max_index_chars: int = MAX_INDEX_CHARS, min_words: int = MIN_MATCH) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, whole; each is judged where it stands, so nothing is joined back."""
    folder, names = indexes(benchmark, max_index_chars, min_words)
    return docs.mapInArrow(_clean(folder, names, docs.columns.index("text"), coverage), docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
