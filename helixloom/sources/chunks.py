"""Sequence files of any size as chunks: FASTA, the FASTA part of GFF, GFF lines, and GenBank, read by byte ranges.

A chunk table has the rows (contig, len, start, seq): ``start`` is a multiple of the chunk's size, and all chunks of a
contig but the last are full. No row, task or worker ever holds a contig.

FASTA is read twice by ranges. The first pass says for each range how many letters continue the record that is open at
its start, how many records begin in it and how many letters the last of them has there; running sums over these few
numbers tell each range where it stands. The second pass cuts the letters along the chunk grid; a chunk that lies across
ranges is put together from its pieces.
"""

from __future__ import annotations

import io
import re
import tempfile
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.session import materialize
from helixloom.sources.fastq import _open
from helixloom.sources.sequences import GENBANK, GFF, _locus, gff_line

CHUNK = 1 << 16
RANGE = 32 << 20
BLOCK = 1 << 20
UNPACKED = 1 << 60  # past the end of any packed file
HELD = 16 << 20  # letters of a record that are held in memory
CHUNKS = "contig string, len long, start long, seq string"
SUMMARY = "file string, first long, part long, lead long, heads long, tail long, opened boolean"
PIECES = "file string, ord long, at long, piece string, head string"


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, first, last: the byte ranges of the files at a path; Spark lists the files and reads none. A packed file is one range, as it is read from its start."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").cast("long").alias("length")).where("length > 0")
    packed = F.endswith("file", F.lit(".gz"))
    starts = listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.when(packed, 0).otherwise(F.col("length") - 1), F.lit(size).cast("long"))).alias("first"))
    cut = starts.select("file", "first", F.when(packed, UNPACKED).otherwise(F.least("length", F.col("first") + size)).alias("last"))
    many, weight = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(packed, RANGE).otherwise(F.col("last") - F.col("first"))), F.lit(0))).first()
    tasks = max(4 * spark.sparkContext.defaultParallelism, weight // RANGE)  # small ranges share tasks, which take one after the other
    return cut.repartition(max(1, min(many, tasks, 10_000)), "file", "first")


SPACE = b" \t\x0b\x0c\r\n"


def _events(file: str, first: int, last: int) -> Iterator[tuple[str, bytes]]:
    """("head", header) where a record begins in a range, ("seq", letters), and before them ("part", letters) of a line that began earlier.

    At most BLOCK bytes are held at a time, so lines may be as long as a file. A header that passes the range's end is read to its own.
    """
    with _open(file) as source:
        source.seek(max(0, first - 1))
        begins = not first or source.read(1) == b"\n"
        kind, at = "seq" if begins else "part", first
        while at < last and (part := source.readline(min(BLOCK, last - at))):
            at += len(part)
            if begins and part.startswith(b">"):
                while not part.endswith(b"\n") and (more := source.readline(BLOCK)):
                    part, at = part + more, at + len(more)
                yield "head", part[1:]
                if at > last or not part.endswith(b"\n"):
                    yield "open", b""
            else:
                yield kind, part.translate(None, SPACE).upper()
                begins = part.endswith(b"\n")
                kind = "seq" if begins else kind


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = lead = heads = tail = 0
            opened = None  # whether the range ends inside a header; unknown while it is inside one line
            for kind, data in _events(file, first, last):
                opened = opened if kind == "part" else kind == "open"
                if kind == "head":
                    heads, tail = heads + 1, 0
                elif kind == "part":
                    part += len(data)
                elif heads:
                    tail += len(data)
                else:
                    lead += len(data)
            rows.append((file, first, part, lead, heads, tail, opened))
        types = (pa.string(), *[pa.int64()] * 5, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "first", "part", "lead", "heads", "tail", "opened"])


def _pieces(size: int):
    """Rows (file, ord, at, piece, head): the letters of each record cut along the chunk grid, and a row with the header of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, last, done, at, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order, held, since, rows, weight = done - 1, [], at, [], 0

                def cut(upto: int) -> None:
                    """Close the piece that is held."""
                    if upto > since and order >= 0:  # noqa: B023
                        rows.append((file, order, since, b"".join(held).decode("latin-1"), None))  # noqa: B023

                for kind, letters in _events(file, first, last):
                    if kind == "head":
                        cut(at)
                        order, held, since, at = order + 1, [], 0, 0
                        rows.append((file, order, 0, None, letters.decode("utf-8", "replace").strip()))
                    while letters and (kind == "seq" or kind == "part" and not inside):
                        room = size - at % size
                        held.append(letters[:room])
                        at, letters = at + len(held[-1]), letters[room:]
                        if at % size == 0:
                            cut(at)
                            held, since = [], at
                            weight += size
                    if weight > 16 * size or len(rows) > 10_000:
                        yield _batch(rows)
                        rows, weight = [], 0
                cut(at)
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "ord", "at", "piece", "head"])


def fasta(spark: SparkSession, path: str, size: int = CHUNK, split: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Records (file, ord, id, desc, len) and chunks (contig, len, start, seq) of FASTA files, or of the FASTA part of GFF files.

    Letters before the first header belong to no record; records without letters go; nameless ones are numbered.
    The ids are the contigs, so they should be unique over the files; rows of one contig are not merged but clash otherwise.
    """
    parts = materialize(ranges(spark, path, split), "ranges")
    told = materialize(parts.mapInArrow(_summaries, SUMMARY), "summaries")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a few numbers for each range
    inside = F.coalesce(F.last("opened", ignorenulls=True).over(before), F.lit(False))
    told = told.withColumn("inside", inside).withColumn("lead", F.col("lead") + F.when(F.col("inside"), 0).otherwise(F.col("part")))
    opened = told.withColumns({"done": F.coalesce(F.sum("heads").over(before), F.lit(0)), "led": F.coalesce(F.sum("lead").over(before), F.lit(0))})
    reset = F.when(F.col("heads") > 0, F.col("tail") - F.col("led") - F.col("lead"))
    placed = opened.withColumn("at", F.col("led") + F.coalesce(F.last(reset, ignorenulls=True).over(before), F.lit(0))).select("file", "first", "done", "at", "inside")
    dealt = parts.join(placed, ["file", "first"]).select("file", "first", "last", "done", "at", "inside")
    pieces = materialize(dealt.repartition(max(1, parts.rdd.getNumPartitions()), "file", "first").mapInArrow(_pieces(size), PIECES), "pieces")
    lengths = pieces.where("piece IS NOT NULL").groupBy("file", "ord").agg(F.sum(F.length("piece")).alias("len"))
    named = F.coalesce(F.nullif(F.split("head", r"\s+")[0], F.lit("")), F.concat(F.lit("seq_"), (F.col("ord") + 1).cast("string")))
    records = pieces.where("head IS NOT NULL").join(lengths, ["file", "ord"]).select("file", "ord", named.alias("id"), F.col("head").alias("desc"), "len")
    grid = (F.floor(F.col("at") / size) * size).cast("long")
    whole = pieces.where("piece IS NOT NULL").groupBy("file", "ord", grid.alias("start")).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("cut"))  # at most size letters
    chunks = whole.join(records.select("file", "ord", "id", "len"), ["file", "ord"]).select(F.col("id").alias("contig"), "len", "start", F.array_join(F.col("cut.piece"), "").alias("seq"))
    return records, chunks


def cut(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks of a table of whole contigs (contig, seq); each row by itself. An empty contig is one empty chunk.

    Letters are cut by an expression: Arrow batches count rows, not letters, so whole contigs in them have no bound.
    """
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}+"), F.lit(0)).alias("pieces")
    whole = contigs.where("seq IS NOT NULL").select("contig", F.length("seq").cast("long").alias("len"), pieces)
    rows = whole.select("contig", "len", F.posexplode_outer("pieces").alias("k", "piece"))  # a contig's letters do not go along with each of its pieces
    return rows.select("contig", "len", (F.coalesce("k", F.lit(0)).cast("long") * size).alias("start"), F.coalesce("piece", F.lit("")).alias("seq"))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    file = None
    for rows in batches:
        out = []
        for name, block, line in rows.itertuples(index=False):
            file, k = ((name, block), 0) if (name, block) != file else (file, k + 1)
            if re.match(r"##FASTA\s*$", line, re.I):
                out.append((name, block + k, "", "##FASTA", 0, 0, "", "", False, {}))
            elif row := gff_line(line):
                out.append((name, block + k, *row))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in GFF.replace("map<string,string>", "map").split(", ")])


def gff_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``sequences.gff_rows``, from files that Spark splits by lines; lines are in order by ``ord``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = materialize(lines.mapInPandas(_numbered, GFF), "gff")
    ends = rows.where("type = '##FASTA'").groupBy("file").agg(F.min("ord").alias("until"))  # one row a file
    return rows.join(F.broadcast(ends), "file", "left").where("until IS NULL OR ord < until").drop("until")


def _parts(file: str, first: int, last: int) -> Iterator[tuple[str, str]]:
    """("locus", line), ("line", line) up to the sequence, and ("seq", letters) of the records that begin in a range."""
    inside = origin = False
    for begins, line in _records(file, first, last):
        if begins:
            inside, origin = True, False
            yield "locus", line
        elif inside and origin:
            if line.startswith("//"):
                inside = False
            else:
                yield "seq", re.sub("[^A-Za-z]", "", line).upper()
        elif inside:
            origin = line.startswith("ORIGIN")
            yield "line", line


def _genbank_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """A row for each record that begins in a range, and one for each of its features; letters are only counted."""
    columns = [*(x.split()[0] for x in GENBANK.split(", ")), "len"]
    kinds = {"start": "Int64", "end": "Int64", "len": "Int64"}
    for batch in batches:
        for file, first, last in zip(*(batch[c].tolist() for c in ("file", "first", "last")), strict=True):
            block: list[str] = []
            rows: list[tuple] = []
            total = 0
            for kind, data in chain(_parts(file, first, last), [("locus", "")]):
                if kind == "seq":
                    total += len(data)
                elif kind == "line":
                    block.append(data)
                else:
                    if block:
                        rows += [(file, *row, total if row[0] == "record" else None) for row in _locus(block)]
                    block, total = [data], 0
                    if len(rows) > 500 or not data:
                        yield pd.DataFrame(rows, columns=columns).astype(kinds)
                        rows = []


def _genbank_chunks(size: int):
    """The chunks of the records that begin in a range. A record's letters are held until its length is known, on the worker's disk from ``HELD`` on."""

    def cut(name: str, letters, total: int) -> Iterator[tuple[str, int, int, str]]:
        letters.seek(0)
        for start in range(0, total, size):
            yield name, total, start, letters.read(size).decode("ascii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, last in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "last")), strict=True):
                name, rows, weight = None, [], 0
                letters, total = tempfile.SpooledTemporaryFile(HELD), 0
                for kind, data in chain(_parts(file, first, last), [("locus", "")]):
                    if kind == "seq":
                        letters.write(data.encode("ascii"))
                        total += len(data)
                    elif kind == "locus":
                        for row in cut(name, letters, total):
                            rows.append(row)
                            weight += len(row[3])
                            if weight > BLOCK:
                                yield _chunk_batch(rows)
                                rows, weight = [], 0
                        if total > HELD:
                            letters.close()
                            letters = tempfile.SpooledTemporaryFile(HELD)
                        letters.seek(0)
                        letters.truncate()
                        name, total = next(iter(data.split()[1:]), ""), 0
                letters.close()
                if rows:
                    yield _chunk_batch(rows)

    return run


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["contig", "len", "start", "seq"])


def _records(file: str, first: int, last: int) -> Iterator[tuple[bool, str]]:
    """The lines of the records whose LOCUS line begins in a range, which may end past it, and whether each is such a line."""
    with io.BufferedReader(_open(file), BLOCK) as source:  # lines of packed files are cut by it, not by Python
        at = first
        if first:
            source.seek(first - 1)
            at = first - 1 + len(source.readline())
        source.seek(at)
        inside = False
        for line in source:
            begins = line.startswith(b"LOCUS") and bool(re.match(rb"LOCUS\s", line))
            if at >= last and (begins or not inside):
                return
            inside = inside or begins
            at += len(line)
            if inside:
                yield begins, line.decode("utf-8", "replace").rstrip("\r\n")


def genbank(spark: SparkSession, path: str, size: int = CHUNK, split: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Rows of kind ``record`` (with ``len``) and ``feature`` of GenBank files, and their chunks; a record's lines are read by one task, some at a time.

    Each of the two tables reads the files for itself, so nothing of them is written again and no letters are shuffled.
    """
    parts = ranges(spark, path, split)
    rows = parts.mapInPandas(_genbank_rows, GENBANK + ", len long").drop("seq")
    return rows, parts.mapInArrow(_genbank_chunks(size), CHUNKS)
