"""Tracks, slices and motif hits over chunk tables (contig, len, start, seq): results equal those over whole contigs.

No task holds more than some chunks, so memory does not grow with a contig.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import explorer
from helixloom.operators.tables import described
from helixloom.session import materialize
from helixloom.sources.chunks import CHUNK

COUNTED = ("G", "C", "known")


def cell_counts(codes: np.ndarray, first: int, step: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Cells of ``step`` bases that the bases from place ``first`` on touch: their numbers, counts, and counts of their first base."""
    cells = np.arange(first // step, (first + len(codes) - 1) // step + 1)
    at = np.maximum(cells * step - first, 0)
    g, c = codes == ord("G"), codes == ord("C")
    kinds = (g, c, g | c | (codes == ord("A")) | (codes == ord("T")))
    begins = cells * step >= first
    return cells, [np.add.reduceat(k.view(np.uint8), at, dtype=np.int64) for k in kinds], [np.where(begins, k[at], False).astype(np.int64) for k in kinds]


def _cells(least: int, parts: int):
    """The plain form of ``cells``, against which tests hold it; for chunks that are record batches already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seq = batch.column(3)[k].as_py()
                if not seq:
                    continue
                size, first = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                win = max(least, size // parts)
                cells, counts, heads = cell_counts(np.frombuffer(seq.encode("ascii", "replace"), np.uint8), first, win // 2)
                same = lambda value, kind: pa.array(np.full(len(cells), value), kind)  # noqa: B023, E731
                columns = [batch.column(0).take(pa.array(np.full(len(cells), k))), same(size, pa.int64()), same(win, pa.int64()), pa.array(cells), *map(pa.array, counts), *map(pa.array, heads)]
                yield pa.RecordBatch.from_arrays(columns, names=["contig", "len", "win", "cell", *COUNTED, *(f"{c}_head" for c in COUNTED)])

    return run


def cells(chunks: DataFrame, least: int, parts: int) -> DataFrame:
    """The rows of ``_cells`` by expressions: a chunk's letters are cut along the grid of cells, so no Python worker gets them."""
    win = F.greatest(F.lit(least).cast("long"), F.floor(F.col("len") / parts))
    sized = chunks.where("seq <> ''").select("contig", "len", "start", "seq", win.alias("win"), F.floor(win / 2).alias("step"), (F.col("start") % F.floor(win / 2)).alias("past"))
    # The first piece ends where the cell in which the chunk begins does; all pieces are possessive, so a match never goes back.
    pattern = F.concat(F.lit(r"(?s)\A.{1,"), (F.col("step") - F.col("past")).cast("string"), F.lit("}+|.{1,"), F.col("step").cast("string"), F.lit("}+"))
    cut = sized.select("contig", "len", "win", F.floor(F.col("start") / F.col("step")).alias("first"), "past", F.posexplode(F.regexp_extract_all("seq", pattern, F.lit(0))).alias("pos", "piece"))
    count = {x: F.length("piece") - F.length(F.replace("piece", F.lit(x), F.lit(""))) for x in "ACGT"}
    head = F.when((F.col("pos") > 0) | (F.col("past") == 0), F.substring("piece", 1, 1)).otherwise("")
    counts = (count["G"], count["C"], count["A"] + count["C"] + count["G"] + count["T"])
    heads = (head == "G", head == "C", head.isin(*"ACGT"))
    return cut.select("contig", "len", "win", (F.col("first") + F.col("pos")).alias("cell"), *[x.cast("long").alias(n) for n, x in zip(COUNTED, counts, strict=True)], *[x.cast("long").alias(f"{n}_head") for n, x in zip(COUNTED, heads, strict=True)])


def windows(chunks: DataFrame, least: int, parts: int) -> DataFrame:
    """Rows (contig, win, start, G, C, known), as ``explorer.windows`` has them.

    A window is two neighbouring cells of half its size, and the first base of a third one if its size is odd. Cells are
    summed over chunk edges; a contig has about 2 * ``parts`` cells at most, however long it is, so a window
    function over them is bounded.
    """
    names = [*COUNTED, *(f"{c}_head" for c in COUNTED)]
    whole = cells(chunks, least, parts).groupBy("contig", "len", "win", "cell").agg(*[F.sum(n).alias(n) for n in names])
    order = Window.partitionBy("contig").orderBy("cell")
    half = F.floor(F.col("win") / 2)
    met = whole.select("contig", "len", "win", (F.col("cell") * half).alias("start"), *[(F.col(c) + F.coalesce(F.lead(c).over(order), F.lit(0)) + F.when(F.col("win") % 2 == 1, F.coalesce(F.lead(f"{c}_head", 2).over(order), F.lit(0))).otherwise(0)).alias(c) for c in COUNTED])
    return met.where("start + win <= len").select("contig", F.col("win").cast("int").alias("win"), F.col("start").cast("int").alias("start"), *[F.col(c).cast("int").alias(c) for c in COUNTED])


def skew_tracks(chunks: DataFrame) -> DataFrame:
    """As ``explorer.skew_tracks``; ``explorer.origin_terminus`` takes its rows."""
    return explorer.skews(windows(chunks, *explorer.SKEW_WINDOWS))


def gc_track(chunks: DataFrame) -> DataFrame:
    """As ``explorer.gc_track``."""
    return explorer.gc_percents(windows(chunks, *explorer.GC_WINDOWS))


def slices(features: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """The features on contigs of the table with ``dna``: their letters in the contig's direction.

    A feature meets the chunks that it touches; a slice is put together from their parts, so no row of the join
    carries more than a chunk. Features past the contig's end get an empty text, as those cut from a whole contig do.
    """
    known = chunks.where("start = 0").select("contig", "len")
    low, high = F.greatest(F.lit(0).cast("long"), F.col("start").cast("long")), F.least(F.col("len"), F.col("end").cast("long"))
    numbered = materialize(features.join(known, "contig").select(*features.columns, low.alias("__low"), high.alias("__high"), F.monotonically_increasing_id().alias("__row")), "features")
    touched = F.when(F.col("__high") > F.col("__low"), F.sequence(F.floor(F.col("__low") / size) * size, F.col("__high") - 1, F.lit(size).cast("long")))
    places = numbered.select("contig", "__row", "__low", "__high", F.explode(touched).alias("start"))
    part = F.substring("seq", (F.greatest("__low", "start") - F.col("start") + 1).cast("int"), (F.least(F.col("__high"), F.col("start") + size) - F.greatest("__low", "start")).cast("int"))
    parts = places.join(chunks.select("contig", "start", "seq"), ["contig", "start"]).select("__row", F.col("start").alias("at"), part.alias("part"), (F.col("__high") <= F.col("start") + size).alias("ends"), (F.col("__low") >= F.col("start")).alias("begins"))
    one = parts.where("begins AND ends").select("__row", F.col("part").alias("dna"))  # features within one chunk are not grouped
    many = parts.where("NOT (begins AND ends)").groupBy("__row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "part")))["part"], "").alias("dna"))
    return numbered.join(one.unionByName(many), "__row", "left").select(*features.columns, F.coalesce("dna", F.lit("")).alias("dna"))


def inspect_feature(features: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """As ``tables.inspect_feature``, from chunks."""
    return described(slices(features, chunks, size), features.columns)


def _accepted(starts: list[int], size: int, blocked: int) -> tuple[list[int], int]:
    """Of places in order those that a scan takes, each at or past the end of the one before; and where the last one ends."""
    out = []
    for at in starts:
        if at >= blocked:
            out.append(at)
            blocked = at + size
    return out, blocked


def _found(pattern: re.Pattern, turned: re.Pattern, text: str, own: int) -> tuple[list[int], list[int]]:
    """Places in a chunk's own letters where the motif stands, and where it stands on the other strand."""
    return tuple([m.start() for m in p.finditer(text) if m.start() < own] for p in (pattern, turned))  # type: ignore[return-value]


def motif_hits(chunks: DataFrame, motif: str) -> DataFrame:
    """As ``explorer.motif_hits``: hits on both strands, non-overlapping on each in its direction.

    Each chunk sees as many letters of the next as a motif that begins in it needs. Which of overlapping places count
    depends on the hit before, which may lie in an earlier chunk: a first pass tells, for each number of letters of a chunk
    that may already be taken when a scan enters it, how many of the next chunk's are taken when it leaves. Composing
    these few numbers along the contig tells every chunk its own entry, and a second pass takes its hits.
    """
    letters = [c for c in motif.upper() if "A" <= c <= "Z"]
    m, kind = len(letters), dict(chunks.dtypes)["contig"]
    if not m:
        empty = f"contig {kind}, start long, end long, strand string, match string"
        return chunks.sparkSession.createDataFrame([], empty)
    forward = explorer.motif_pattern(motif)
    backward = "".join(f"[{''.join(S.COMPLEMENTS[S.BASES.index(b)] for b in explorer.IUPAC.get(c, 'N'))}]" for c in reversed(letters))
    rows = chunks.select("contig", "start", F.upper("seq").alias("seq"), (F.col("start") + F.length("seq")).alias("next"))
    edges = chunks.select("contig", F.col("start").alias("next"), F.upper(F.substring("seq", 1, m - 1)).alias("edge"))
    edged = materialize(rows.join(edges, ["contig", "next"], "left").select("contig", "start", "seq", F.coalesce("edge", F.lit("")).alias("edge")), "edged")

    def places(batch: pa.RecordBatch, patterns: tuple[re.Pattern, re.Pattern]) -> Iterator[tuple[int, int, str, list[int], list[int]]]:
        for k in range(batch.num_rows):
            seq = batch.column(2)[k].as_py()
            yield k, len(seq), seq + batch.column(3)[k].as_py(), *_found(*patterns, seq + batch.column(3)[k].as_py(), len(seq))

    def patterns() -> tuple[re.Pattern, re.Pattern]:
        return re.compile(f"(?={forward})"), re.compile(f"(?={backward})")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = patterns()
        for batch in batches:
            right, left = [], []
            for _, own, _, plus, minus in places(batch, both):
                right.append([max(0, _accepted(plus, m, e)[1] - own) for e in range(m)])
                # The other strand is scanned from the right: a place ends at -at there, and taken letters lie past the chunk.
                back = [-(at + m) for at in reversed(minus)]
                left.append([max(0, _accepted(back, m, -(own + m - 1) + e)[1] - -(m - 1)) for e in range(m)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(right, pa.list_(pa.int64())), pa.array(left, pa.list_(pa.int64()))], names=["contig", "start", "right", "left"])

    told = materialize(edged.mapInArrow(exits, f"contig {kind}, start long, right array<long>, left array<long>"), "exits")
    entries = None
    for side, by in (("right", F.asc), ("left", F.desc)):
        entry = _entries(told, side, by).withColumnRenamed("entry", f"{side}_entry")
        entries = entry if entries is None else entries.join(entry, ["contig", "start"])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = patterns()
        for batch in batches:
            for k, own, text, plus, minus in places(batch, both):
                first, base = batch.column(1)[k].as_py(), None
                right, left = batch.column(4)[k].as_py(), batch.column(5)[k].as_py()
                taken = [(at, "+") for at in _accepted(plus, m, right)[0]]
                taken += [(-at - m, "-") for at in _accepted([-(at + m) for at in reversed(minus)], m, -(own + m - 1) + left)[0]]
                if taken:
                    at = np.array([t[0] for t in taken]) + first
                    columns = [batch.column(0).take(pa.array(np.full(len(taken), k))), pa.array(at), pa.array(at + m), pa.array([t[1] for t in taken]), pa.array([text[t[0] : t[0] + m] for t in taken])]
                    yield pa.RecordBatch.from_arrays(columns, names=["contig", "start", "end", "strand", "match"])

    met = edged.join(entries, ["contig", "start"]).select("contig", "start", "seq", "edge", "right_entry", "left_entry")
    return met.mapInArrow(hits, f"contig {kind}, start long, end long, strand string, match string")


def _entries(told: DataFrame, side: str, by) -> DataFrame:
    """contig, start, entry: the composition of the exits of all chunks before, in the order of the scan, entered with nothing taken.

    Exits are a few numbers a chunk. Where a chunk's exit is the same for every entry, which it is unless overlapping
    places run through the whole chunk, the scan begins anew; so a window over such runs, not over contigs, composes them.
    """
    order = Window.partitionBy("contig").orderBy(by("start"))
    fixed = F.size(F.array_distinct(side)) == 1
    runs = told.select("contig", "start", side, F.coalesce(F.lag(fixed).over(order), F.lit(True)).cast("int").alias("anew"), F.lag(side).over(order).alias("before"))
    runs = runs.withColumn("run", F.sum("anew").over(order))
    in_run = Window.partitionBy("contig", "run").orderBy(by("start")).rowsBetween(Window.unboundedPreceding, 0)
    led = F.collect_list(F.struct("anew", F.coalesce("before", F.array(F.lit(0).cast("long"))).alias("exit"))).over(in_run)
    entry = F.aggregate(led, F.lit(0).cast("long"), lambda e, x: F.when(x["anew"] == 1, x["exit"][0]).otherwise(F.element_at(x["exit"], (e + 1).cast("int"))))
    return runs.select("contig", "start", entry.alias("entry"))
