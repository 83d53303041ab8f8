"""WARC archives with a two-level capture index.

Writing: each task appends its pages as gzip members to archive files in the
shared folder and reports where each record is. Of pages with equal payloads of
MIN_REVISIT bytes or more, the one with the largest page_id is a response and the
others are revisit records that name it.

Indexing: the lines ``reversed-host URL key, archive, offset, length`` are range
partitioned and sorted by key. Each part writes them in compressed blocks of
BLOCK_LINES lines and keeps a sparse directory, the first key and place of each
block, beside them. The first keys of the parts, at most MAX_PARTS, are the level
above.

Reading: a key finds its part and then its block by binary search, and its
record by a range read. Lookups are grouped by part, so that a block is read once
for all its keys; record reads are sorted by archive and offset, and neighbouring
ranges are read at once.

Every file has a name of its own, and only files that a successful task reports
are ever read, so a task that is run again after a lost executor does no harm.
All intermediate tables stand in the shared folder. Only narrow rows are
shuffled, and the payloads that may be revisits.

Defined results: null html is an empty payload, null urls have an empty key; pages
that repeat an id and payload have a record each of the same type; pages that
share an id but not the payload are records of their own, each with the type that
its payload asks for; a null id never owns a payload that a page with an id has
(such a page is a revisit), and payloads of null ids alone are all responses; very
long payloads are one record each; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import Appender, fresh_path, materialize, may_hold, store, table

MIN_REVISIT = 1000
CAPTURE_DATE = "2026-01-01T00:00:00Z"
BLOCK_LINES, PART_LINES, MAX_PARTS = 256, 8192, 4096
READ_BYTES, GAP_BYTES = 8 << 20, 1 << 16
LEVEL, SALTS = 4, 8
RECORDS = "key string, page_id long, archive string, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: host labels from the right, then port, path and query, without fragment."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + quote(url, safe="/:?&=%")
    name = ",".join(reversed(host.removeprefix("www.").split(".")))
    port_part = f":{port}" if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)) else ""
    return quote(f"{name}{port_part}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower(), safe="/:?&=%,)")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Key of a capture: no two captures of one URL share it; it has one space, before the id."""
    return f"{surt(url)} {'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Target-URI: {quote(url or '', safe='/:?&=%#')}",
        f"WARC-Date: {CAPTURE_DATE}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    block = b""
    if refers_to is None:
        payload = (html or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a member; a revisit has no payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    def page(name: str) -> int | None:
        found = fields.get(name, "")[len("<urn:page:") : -1]
        return int(found) if found else None

    if fields["WARC-Type"] == "revisit":
        return page("WARC-Record-ID"), 0, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", page("WARC-Refers-To")
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    return page("WARC-Record-ID"), len(payload), hashlib.sha1(payload).hexdigest(), "response", None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, rows = Appender(folder, ".warc.gz"), []
        for batch in batches:
            ids, urls, _, digests, refers = (c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns))
            for page_id, url, html, digest, refers_to in zip(ids, urls, batch.column(2), digests, refers, strict=True):
                rows.append((capture_key(url, page_id), page_id, *archive.add(record(page_id, url, html.as_py(), digest, refers_to))))
        archive.close()  # places are reported only for files that are complete
        for s in range(0, len(rows), 10_000):
            yield _batch(rows[s : s + 10_000], RECORDS)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages' records under ``folder``; rows (key, page_id, archive, offset, length).

    A page's type follows from its id and digest, so pages that share an id are told apart by
    their payloads. Only payloads that a filter of bounded size takes for revisits meet the
    decisions; all others are written as they are read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    narrow = materialize(rows.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "digests").where(F.col("size") >= MIN_REVISIT)
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    met = narrow.withColumn("salt", _salt("page_id")).join(groups, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = materialize(met.select("page_id", "digest", "refers_to").distinct(), "revisits")
    marked = may_hold(rows, F.xxhash64("page_id", "digest"), revisits.select(F.xxhash64("page_id", "digest").alias("key")), "held")
    other = revisits.select(F.col("page_id").alias("other_id"), F.col("digest").alias("other_digest"), "refers_to")
    decided = marked.where("held").join(other, F.col("page_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest")), "left")
    straight = marked.where("not held").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "url", "html", "digest", "refers_to"]
    return materialize(straight.select(*columns).unionByName(decided.select(*columns)).mapInArrow(_write(folder), RECORDS), "records")


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, directory, lines = Appender(folder, ".cdx.z"), [], []

        def close_block() -> None:
            if lines:
                directory.append((lines[0].partition("\t")[0], *blocks.add(zlib.compress("\n".join(lines).encode(), LEVEL))))
                lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    close_block()
        close_block()
        blocks.close()
        if directory:
            listing = Appender(folder, ".idx.z")
            place = listing.add(zlib.compress("\n".join("\t".join(map(str, d)) for d in directory).encode(), LEVEL))
            listing.close()
            yield _batch([(directory[0][0], place[0])], "key string, listing string")

    return run


def build_index(records: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write the index under ``folder``; the first key and the directory file of each part, in order."""
    parts = max(1, min(MAX_PARTS, -(-records.count() // PART_LINES)))
    lines = records.select("key", "archive", "offset", "length").repartitionByRange(parts, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return sorted((r["key"], r["listing"]) for r in lines.mapInArrow(_index(folder), "key string, listing string").collect())


class Part:
    """A part of the index: its directory in memory, and the block read last."""

    def __init__(self, folder: str, listing: str):
        self.fs, self.folder = store(folder)
        rows = [d.split("\t") for d in self._read(listing).split("\n")]
        self.keys = [r[0] for r in rows]
        self.places = [(r[1], int(r[2]), int(r[3])) for r in rows]
        self.held, self.lines = -1, []

    def _read(self, name: str, offset: int = 0, length: int | None = None) -> str:
        with self.fs.open_input_file(f"{self.folder}/{name}") as source:
            return zlib.decompress(source.read_at(source.size() if length is None else length, offset)).decode()

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of each record with the key."""
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            if self.held != k:
                self.held, self.lines = k, [x.split("\t") for x in self._read(*self.places[k]).split("\n")]
            at = bisect.bisect_left(self.lines, key, key=lambda x: x[0])
            for line in self.lines[at:]:
                if line[0] != key:
                    break
                yield line[1], int(line[2]), int(line[3])
            k += 1


def _route(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = bounds.value
        for batch in batches:
            rows = []
            for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = capture_key(url, page_id)
                last = max(0, bisect.bisect_right(firsts, key) - 1)
                rows += [(k, key) for k in range(max(0, bisect.bisect_left(firsts, key, 0, last + 1) - 1), last + 1)]  # a key may stand on both sides of a bound
            yield _batch(rows, "part long, key string")

    return run


def _lookup(folder: str, listings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, before = None, None, None
        for batch in batches:
            rows = []
            for at, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, key) == before:
                    continue
                before = (at, key)
                if held != at:
                    held, part = at, Part(folder, listings.value[at])
                rows += part.find(key)
            if rows:
                yield _batch(rows, "archive string, offset long, length long")

    return run


def look_up(keys: DataFrame, index: list[tuple[str, str]], folder: str) -> DataFrame:
    """The places of the captures of rows (page_id, url)."""
    if not index:
        return keys.sparkSession.createDataFrame([], "archive string, offset long, length long")
    context = keys.sparkSession.sparkContext
    bounds, listings = context.broadcast([k for k, _ in index]), context.broadcast([x for _, x in index])  # at most MAX_PARTS
    routed = keys.select(F.col("page_id").cast("long"), "url").mapInArrow(_route(bounds), "part long, key string")
    sorted_keys = routed.repartition(len(index), "part").sortWithinPartitions("part", "key")
    return sorted_keys.mapInArrow(_lookup(folder, listings), "archive string, offset long, length long")


def _fetch(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        name, source = None, None

        def read(group: list[tuple[int, int]]) -> list[tuple]:
            begin = group[0][0]
            data = source.read_at(group[-1][0] + group[-1][1] - begin, begin)
            return [parse(data[o - begin : o - begin + n]) for o, n in group]

        for batch in batches:
            rows, group = [], []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                far = group and (offset + length - group[0][0] > READ_BYTES or offset - sum(group[-1]) > GAP_BYTES)
                if group and (archive != name or far):
                    rows += read(group)
                    group = []
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, files.open_input_file(f"{base}/{archive}")
                group.append((offset, length))
            if group:
                rows += read(group)
            if rows:
                yield _batch(rows, READ)

    return run


def read_records(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records at the places, revisits resolved."""
    ordered = places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    found = materialize(ordered.mapInArrow(_fetch(folder), READ), "read")
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'").drop("payload_bytes")
    # a response is known by its id and its digest: pages with one id may have several payloads
    wanted = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    owners = responses.join(wanted, ["page_id", "payload_digest"]).groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    resolved = revisits.withColumn("salt", _salt("page_id")).join(owners, ["refers_to", "payload_digest", "salt"], "left")
    return responses.unionByName(resolved.select(*responses.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, index them, find each page by its key and read its record."""
    spark = pages.sparkSession
    archives, index_dir = fresh_path(spark, "warc"), fresh_path(spark, "warc-index")
    records = write_archives(pages, archives)
    index = build_index(records, index_dir)
    return read_records(look_up(pages, index, index_dir), archives, max(1, min(MAX_PARTS, 4 * len(index))))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


QUERIES = {"op4_warc": op4_warc}
ORACLES = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN owner <> page_id THEN owner END AS refers_to FROM q"""
}
