"""FASTQ as a Spark data source, batch and streaming: ``spark.read.format("fastq").load(path)``.

A task reads one file, or with the option ``splitBytes`` one byte range of a plain file
(well-formed four-line records are found again from their shape). Files are read in
chunks, so memory is one record. ``read_idx`` is unique over all files of a load and the same
for any ``splitBytes``: the file's ordinal in the high bits, then the byte at which the record
starts. Ordinals are places by name in a batch, and places in the log in a stream.

A stream keeps a log of the files that it has seen (name, size, time), in the order in which it
saw them. New files are appended before an offset names them, and an offset is a length of the
log, so a file that sorts before others but comes later is read once, no file is read twice, and a
restart finds the same files under the same ordinals. Streams with one log share it. A file counts
with the size that it had when it was seen; files must not change afterwards.

Paths with a scheme are read from the cluster's storage. Options: ``path`` (file, folder or glob),
``splitBytes`` (0: whole files), ``issues`` (true: rows on malformed records instead), ``log`` (the
folder of a stream's log; ``stream`` puts it into the shared folder, else it is ``_fastq_log`` beside the files).
"""

from __future__ import annotations

import glob
import gzip
import hashlib
import io
import json
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from helixloom.session import shared_dir

READS = "file string, read_idx long, id string, desc string, seq string, qual string, byte_start long, byte_len long"
FILE_BITS = 44  # read_idx: which file, then a number that is unique in it; files are at most 16 TB
FETCHED = 64 << 20  # records in so many bytes of a file are fetched by one task
HELD = 4 << 20  # letters of a batch of rows
ISSUES = "file string, byte_start long, message string"


@dataclass
class Part(InputPartition):
    file: str
    start: int
    end: int  # -1: to the end
    ordinal: int  # which of the files it is

    def __init__(self, file: str, start: int = 0, end: int = -1, ordinal: int = 0):
        super().__init__(file)
        self.file, self.start, self.end, self.ordinal = file, start, end, ordinal


def _store(path: str):
    """The file system of a path that names one, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def _plain(path: str) -> str:
    """A local path, without its scheme."""
    return re.sub("^file:/*", "/", path)


def _open(name: str):
    """A file of the cluster's storage or a local one, unpacked if it is packed."""
    if _remote(name):
        files_of, inner = _store(name)
        raw = io.BufferedReader(files_of.open_input_file(inner), 1 << 20)
        return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
    name = _plain(name)
    return gzip.open(name, "rb") if name.endswith(".gz") else open(name, "rb")


def _stat(name: str) -> tuple[int, float]:
    """Size and time of a file."""
    if _remote(name):
        files_of, inner = _store(name)
        info = files_of.get_file_info(inner)
        return info.size, (info.mtime_ns or 0) / 1e9
    found = os.stat(_plain(name))
    return found.st_size, found.st_mtime


class SeenLog:
    """The files that a stream has seen, as segments of JSON lines named by the ordinal of their first file.

    A segment is written in whole beside the log and then moved into place under a name that only one
    writer can take, so streams that share a log agree on it.
    """

    def __init__(self, folder: str):
        self.folder, self.entries = folder if _remote(folder) else _plain(folder), []

    def _names(self) -> list[str]:
        if _remote(self.folder):
            from pyarrow import fs

            files_of, inner = _store(self.folder)
            files_of.create_dir(inner, recursive=True)
            names = [f.base_name for f in files_of.get_file_info(fs.FileSelector(inner))]
        else:
            os.makedirs(self.folder, exist_ok=True)
            names = os.listdir(self.folder)
        return sorted(x for x in names if x.endswith(".json") and x[0].isdigit())

    def load(self) -> list[dict]:
        """All entries; only segments past those that are known are read."""
        for name in self._names():
            if int(name[:-5]) == len(self.entries):
                with _open(f"{self.folder}/{name}") as source:
                    self.entries += [json.loads(line) for line in source.read().splitlines()]
        return self.entries

    def _take(self, data: bytes) -> bool:
        """Write the next segment, unless another writer has it by now."""
        name, temporary = f"{len(self.entries):012d}.json", f"_{os.getpid()}-{os.urandom(8).hex()}"
        if _remote(self.folder):
            files_of, inner = _store(self.folder)
            if files_of.get_file_info(f"{inner}/{name}").is_file:
                return False
            with files_of.open_output_stream(f"{inner}/{temporary}") as out:
                out.write(data)
            files_of.move(f"{inner}/{temporary}", f"{inner}/{name}")
            return True
        folder = self.folder
        with open(f"{folder}/{temporary}", "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(f"{folder}/{temporary}", f"{folder}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{folder}/{temporary}")
        return True

    def append(self, names: list[str]) -> list[dict]:
        """The log with the files that it did not have yet, by time and name."""
        while True:
            known = {e["name"] for e in self.load()}
            new = sorted((time, name, size) for name in names if name not in known for size, time in [_stat(name)])
            rows = [{"name": name, "size": size, "time": time} for time, name, size in new]
            if not rows or self._take("".join(json.dumps(r) + "\n" for r in rows).encode()):
                return self.load()


def files(path: str) -> list[str]:
    """The files of a folder, by name, in the cluster's storage (``scheme://...``) or locally."""
    if _remote(path):
        from pyarrow import fs

        files_of, inner = _store(path)
        if files_of.get_file_info(inner).type != fs.FileType.Directory:
            return [path]
        root = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
        found = files_of.get_file_info(fs.FileSelector(inner))
        return sorted(root + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    path = _plain(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))
    return sorted(glob.glob(path)) or [path]


def _exists(name: str) -> bool:
    """Whether the name is a file: a pattern that nothing matches stands for itself."""
    return _remote(name) or os.path.isfile(_plain(name))


def lines(source, start: int) -> Iterator[tuple[int, int, bytes]]:
    """Offset, end and content of each line; one carriage return goes, but not from an unfinished last line."""
    at = start
    for raw in source:
        end = at + len(raw)
        if raw.endswith(b"\n"):
            yield at, end, raw[:-2] if raw.endswith(b"\r\n") else raw[:-1]
        else:
            yield at, end, raw
        at = end


def _resync(source, start: int) -> int:
    """Offset of the first whole record at or after ``start``."""
    source.seek(start - 1)
    at = start - 1 + len(source.readline())
    source.seek(at)
    window: list[tuple[int, bytes]] = []
    for at, _, line in lines(source, at):
        window = [*window[-3:], (at, line)]
        if len(window) == 4 and window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and len(window[1][1]) == len(window[3][1]):
            return window[0][0]
    return source.tell()


def parse(part: Part) -> Iterator[tuple[str, tuple]]:
    """("read", row) and ("issue", row) of a file or a range of it; an unfinished last record is dropped."""
    with _open(part.file) as source:
        begin = _resync(source, part.start) if part.start else 0
        source.seek(begin)
        state, held = 0, []
        for at, end, line in lines(source, begin):
            if state == 0:
                if part.end >= 0 and at >= part.end:
                    return
                if not line:
                    continue
                if line[:1] != b"@":
                    yield "issue", (part.file, at, "expected a header")
                    continue
                held = [(at, end, line)]
            else:
                held.append((at, end, line))
            state = (state + 1) % 4
            if state == 0:
                head, seq, _, qual = (x[2].decode("latin-1") for x in held)
                name, _, desc = head[1:].partition(" ")
                if len(seq) != len(qual):
                    yield "issue", (part.file, held[0][0], f"{name}: {len(seq)} bases and {len(qual)} qualities")
                    continue
                yield "read", (part.file, (part.ordinal << FILE_BITS) + held[0][0], name, desc, seq, qual, held[0][0], end - held[0][0])


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.issues = options.get("issues", "false").lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", "0")))

    def parts(self, sized: list[tuple[str, int]], first: int = 0) -> list[Part]:
        out = []
        for ordinal, (name, size) in enumerate(sized, first):
            if self.split and size > self.split and not name.endswith(".gz"):
                out += [Part(name, s, min(size, s + self.split), ordinal) for s in range(0, size, self.split)]
            else:
                out.append(Part(name, 0, -1 if name.endswith(".gz") else size, ordinal))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        kind = "issue" if self.issues else "read"
        return (row for k, row in parse(partition) if k == kind)


def batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about HELD letters: a task holds those of one batch, however many rows Spark would take together."""
    held, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    for row in rows:
        held.append(row)
        weight += 64 + sum(len(x) for x in row if isinstance(x, str))
        if weight >= HELD:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, {"string": pa.string(), "long": pa.int64()}[kind]) for name, kind in (c.split() for c in schema.split(", "))]


class _InBatches(_Reader):
    """A reader as Spark runs it."""

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        return batches(super().read(partition), _kinds(ISSUES if self.issues else READS))


class FastqReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts([(name, _stat(name)[0]) for name in files(self.options["path"])])


class FastqStreamReader(_Reader, DataSourceStreamReader):
    """New files as the log has them; an offset is a length of the log."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        path = options["path"]
        beside = path if _remote(path) or os.path.isdir(_plain(path)) else os.path.dirname(path) or "."
        self.log = SeenLog(options.get("log") or f"{beside.rstrip('/')}/_fastq_log")

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.log.append([f for f in files(self.options["path"]) if _exists(f)]))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        entries = self.log.load()[start["files"] : end["files"]]
        return self.parts([(e["name"], e["size"]) for e in entries], start["files"])

    def commit(self, end: dict) -> None:
        pass


class _BatchReader(_InBatches, FastqReader):
    pass


class _StreamBatchReader(_InBatches, FastqStreamReader):
    pass


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return ISSUES if self.options.get("issues", "false").lower() == "true" else READS

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamBatchReader(dict(self.options))


FETCHED_ROWS = "file string, byte_start long, id string, desc string, seq string, qual string"


def _records(places: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    name, source = None, None
    for batch in places:
        for file, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, _open(file)
            source.seek(start)
            head, seq, _, qual = (x.rstrip("\r") for x in source.read(length).decode("latin-1").split("\n")[:4])
            title, _, desc = head[1:].partition(" ")
            yield file, start, title, desc, seq, qual


def _ranges(places: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches(_records(places), _kinds(FETCHED_ROWS))


def fetch(places: DataFrame) -> DataFrame:
    """file, byte_start, id, desc, seq and qual of the records at rows (file, byte_start, byte_len), each read by its range."""
    ordered = places.select("file", F.col("byte_start").cast("long"), F.col("byte_len").cast("long")).repartition("file", F.floor(F.col("byte_start") / FETCHED)).sortWithinPartitions("file", "byte_start")
    return ordered.mapInArrow(_ranges, FETCHED_ROWS)


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files of a folder or pattern as a stream whose log is in the shared folder, under a name that follows from the path."""
    log = f"{shared_dir(spark)}/fastq-log-{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    return spark.readStream.format("fastq").options(log=log, **options).load(path)


def register(spark: SparkSession) -> None:
    """Make the format known. The source goes to Spark's planners by value, as they do not see the session's files."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FastqSource)
