"""Overlap-layout-consensus assembly: minimizers, overlaps, end graph, matching, paths and contigs.

Tables: reads (read_idx, seq); minimizers (read_idx, hash, pos, strand); overlaps (a, b,
orientation, type, match_count, overlap_len, score, a_min, a_max, b_min, b_max).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import layout
from helixloom.operators.tables import repeated
from helixloom.session import materialize

EXPANDED = 1 << 21
SKETCHED = 1 << 19
ADDED = 1 << 20  # rows of hashes that a task adds up, and that a broadcast has at most
K, W, MAX_READS = 10, 5, 40
DRIFT, MIN_MATCHES, MIN_OVERLAP = 60, 4, 200
UNKNOWN = np.int64(1) << 40
COMPLEMENT = np.full(256, ord("N"), np.uint8)
COMPLEMENT[[ord(c) for c in S.BASES]] = [ord(c) for c in S.COMPLEMENTS]
KNOWN = np.zeros(256, bool)
KNOWN[[ord(c) for c in S.BASES]] = True


def sketch(seq: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position and strand of the minimizers of a read; k-mers with other letters take no part."""
    c = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    n = len(c) - k + 1
    if n < w:
        return (np.zeros(0, np.int64),) * 3
    forward, backward = (np.full(n, S.FNV_OFFSET, np.uint32) for _ in range(2))
    turned, prime = COMPLEMENT[c], np.uint32(S.FNV_PRIME)  # products wrap at 32 bits
    for t in range(k):
        forward = (forward ^ c[t : t + n]) * prime
        backward = (backward ^ turned[k - 1 - t : k - 1 - t + n]) * prime
    bad = np.concatenate([[0], np.cumsum(~KNOWN[c])])
    best = np.where(bad[k:] == bad[:-k], np.minimum(forward, backward).astype(np.int64), UNKNOWN)
    least, at = best[: n - w + 1].copy(), np.arange(n - w + 1)
    for t in range(1, w):  # the first of equals stays
        lower = best[t : t + len(at)] < least
        np.copyto(least, best[t : t + len(at)], where=lower)
        np.copyto(at, np.arange(t, t + len(at)), where=lower)
    at = at[best[at] != UNKNOWN]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return best[at], at, np.where(forward[at] <= backward[at], 1, -1)


def _sketched(batch: pa.RecordBatch, k: int, w: int) -> Iterator[tuple[list[int], list[tuple]]]:
    """Reads of about SKETCHED bases and their sketches."""
    ids, found, weight = [], [], 0
    for key, seq in zip(batch.column(0), batch.column(1), strict=True):
        seq = seq.as_py() or ""
        ids.append(key.as_py())
        found.append(sketch(seq, k, w))
        weight += len(seq)
        if weight >= SKETCHED:
            yield ids, found
            ids, found, weight = [], [], 0
    if ids:
        yield ids, found


def minimizers(reads: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """One Arrow pass, each read by itself: nothing is shuffled, and a task holds the minimizers of a read or of SKETCHED bases."""

    def rows(ids: list[int], found: list[tuple]) -> pa.RecordBatch:
        of = np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found])
        h, p, s = (np.concatenate([np.zeros(0, np.int64), *(f[x] for f in found)]) for x in range(3))
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(h), pa.array(p.astype(np.int32)), pa.array(s.astype(np.int32))], names=["read_idx", "hash", "pos", "strand"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found in _sketched(batch, k, w):
                yield rows(ids, found)

    return reads.select("read_idx", "seq").mapInArrow(run, "read_idx long, hash long, pos int, strand int")


def index(sketches: DataFrame, most: int = MAX_READS) -> DataFrame:
    """The minimizers whose hash 2 to ``most`` reads share, before any join: repeats never meet each other.

    ``seen`` is the first place of the hash, by read and position.
    """
    by_read = sketches.groupBy("hash", "read_idx").agg(F.min("pos").alias("pos"))
    kept = by_read.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("read_idx", "pos")).alias("seen")).where(F.col("n").between(2, most)).drop("n")
    return sketches.join(kept, "hash")


def hash_counts(reads: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """hash, reads, entries, seen: how many reads have a hash, how often they have it, and its first place.

    Where each read has one row, tasks add up their reads, so what is shuffled follows the number of hashes, not of minimizers.
    """
    if repeated(reads, "read_idx"):
        by_read = minimizers(reads, k, w).groupBy("hash", "read_idx").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("entries"))
        return by_read.groupBy("hash").agg(F.count(F.lit(1)).alias("reads"), F.sum("entries").alias("entries"), F.min(F.struct("read_idx", "pos")).alias("seen"))

    def summed(h: np.ndarray, n: np.ndarray, entries: np.ndarray, read: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of one hash as one."""
        order = np.argsort(h, kind="stable")
        h, n, entries, read, pos = h[order], n[order], entries[order], read[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(first):
            return h, n, entries, read, pos
        least = np.minimum.reduceat(read, first)
        there = np.repeat(least, np.diff(np.append(first, len(h)))) == read
        return h[first], np.add.reduceat(n, first), np.add.reduceat(entries, first), least, np.minimum.reduceat(np.where(there, pos, np.iinfo(np.int64).max), first)

    def of_reads(ids: list[int], found: list[tuple]) -> tuple[np.ndarray, ...]:
        """Each hash of each read is one row, at its first place there."""
        sizes = [len(f[0]) for f in found]
        h, pos, row = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat(np.arange(len(ids)), sizes)
        _, first, entries = np.unique(h << np.int64(31) | row, return_index=True, return_counts=True)
        return summed(h[first], np.ones(len(first), np.int64), entries.astype(np.int64), np.array(ids, np.int64)[row[first]], pos[first].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["hash", "reads", "entries", "read_idx", "pos"]

        def out() -> Iterator[pa.RecordBatch]:
            columns = held.pop()
            for low in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + (1 << 16)]) for c in columns], names=names)

        def added() -> None:
            held[:] = [summed(*(np.concatenate([h[x] for h in held]) for x in range(5)))]

        for batch in batches:
            for ids, found in _sketched(batch, k, w):
                held.append(of_reads(ids, found))
                if sum(len(h[0]) for h in held) > ADDED:
                    added()
                    if 2 * len(held[0][0]) > ADDED:
                        yield from out()
        if held:
            added()
            yield from out()

    partial = reads.select("read_idx", "seq").mapInArrow(run, "hash long, reads long, entries long, read_idx long, pos long")
    return partial.groupBy("hash").agg(F.sum("reads").alias("reads"), F.sum("entries").alias("entries"), F.min(F.struct("read_idx", F.col("pos").cast("int").alias("pos"))).alias("seen"))


def shared(reads: DataFrame, k: int = K, w: int = W, most: int = MAX_READS) -> DataFrame:
    """As ``index`` of the reads' minimizers: the hashes that are kept are known before any minimizer is written."""
    kept = materialize(hash_counts(reads, k, w).where(F.col("reads").between(2, most)).select("hash", "seen"), "shared")
    return minimizers(reads, k, w).join(F.broadcast(kept) if kept.count() <= ADDED else kept, "hash")


def postings(indexed: DataFrame) -> DataFrame:
    """hash, read_idx, seen, places: one row for each read with a hash. A place is twice its position, plus one on the other strand."""
    place = F.col("pos") * 2 + F.when(F.col("strand") < 0, 1).otherwise(0)
    return indexed.groupBy("hash", "read_idx", "seen").agg(F.array_sort(F.collect_list(place)).alias("places"))


def _sides(posted: DataFrame, *kept: str) -> DataFrame:
    """Pairs of reads a < b that share a hash; a hash has at most as many reads as ``index`` lets it have."""
    a, b = (posted.select("hash", F.col("read_idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in kept]) for s in "ab")
    return a.join(b, "hash").where("a < b")


def pair_counts(posted: DataFrame) -> DataFrame:
    """a, b, matches: how many pairs of places two reads share, from the numbers of places alone."""
    counted = posted.select("hash", "read_idx", F.size("places").cast("long").alias("n"))
    return _sides(counted, "n").groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("matches"))


def chained(places_a: list[np.ndarray], places_b: list[np.ndarray], turn: int, drift: int) -> list[tuple[int, int, int, int, int]]:
    """Of two reads' places for each shared hash: the longest chain (count, least and last place on a and on b) on the same strand and on the other.

    Matches come in the order of their places on a, then on b: each place on a meets the sorted places of its hash on b. They are
    never all held, only EXPANDED at a time; ``turn`` takes a place on b to the other strand.
    """
    group = lambda places: np.repeat(np.arange(len(places)), [len(p) for p in places])
    a, b = np.concatenate(places_a).astype(np.int64), np.concatenate(places_b).astype(np.int64)
    key_a, key_b = group(places_a) * 2 + (a & 1), group(places_b) * 2 + (b & 1)
    order_a, order_b = np.argsort(a >> 1, kind="stable"), np.argsort(key_b, kind="stable")
    key_a, at_a, at_b = key_a[order_a], a[order_a] >> 1, b[order_b] >> 1
    sizes = np.bincount(key_b, minlength=2 * len(places_a))
    firsts = np.cumsum(sizes) - sizes
    out = []
    for other in (0, 1):
        keys, on_b = key_a ^ other, turn - at_b if other else at_b
        n = sizes[keys]
        some = n > 0
        keys, n, on_a = keys[some], n[some], at_a[some]
        upto = np.cumsum(n)
        best, open_, last, row = (0, 0, 0, 0, 0), None, 0, 0

        def chain(x: np.ndarray, y: np.ndarray, before: tuple | None) -> tuple[int, int, int, int, int]:
            found = (len(x), int(x[0]), int(x[-1]), int(y.min()), int(y.max()))
            return found if before is None else (before[0] + found[0], before[1], found[2], min(before[3], found[3]), max(before[4], found[4]))

        while row < len(n):
            done = upto[row] - n[row]
            stop = max(row + 1, int(np.searchsorted(upto, done + EXPANDED, "right")))
            m = n[row:stop]
            total = int(m.sum())
            y = on_b[np.arange(total) + np.repeat(firsts[keys[row:stop]] - (np.cumsum(m) - m), m)]
            x = np.repeat(on_a[row:stop], m)
            diagonal = x - y
            cuts = np.flatnonzero(np.abs(np.diff(diagonal)) > drift) + 1
            bounds = np.concatenate([[0], cuts, [total]])
            if open_ is not None and abs(int(diagonal[0]) - last) > drift:
                best, open_ = max(best, open_, key=lambda c: c[0]), None
            whole = np.diff(bounds)
            first = chain(x[: bounds[1]], y[: bounds[1]], open_)
            if len(whole) == 1:
                open_ = first
            else:
                best = max(best, first, key=lambda c: c[0])
                if len(whole) > 2:
                    k = 1 + int(np.argmax(whole[1:-1]))
                    if whole[k] > best[0]:
                        best = chain(x[bounds[k] : bounds[k + 1]], y[bounds[k] : bounds[k + 1]], None)
                open_ = chain(x[bounds[-2] :], y[bounds[-2] :], None)
            last, row = int(diagonal[-1]), stop
        out.append(max(best, open_, key=lambda c: c[0]) if open_ is not None else best)
    return out


CHAIN = "a long, b long, len_a int, len_b int, found_at struct<seen:struct<read_idx:long,pos:int>,a:long,pos_a:int,b:long,pos_b:int>, orientation string, match_count long, a_min int, a_max int, b_min int, b_max int"


def _chains(k: int, drift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in range(batch.num_rows):
                lists = [x.flatten() for x in batch.column(5)[i].values.flatten()]
                ends = [np.cumsum(pc.list_value_length(x).to_numpy())[:-1] for x in batch.column(5)[i].values.flatten()]
                places = [np.split(x.to_numpy(), e) for x, e in zip(lists, ends, strict=True)]
                for name, (n, a0, a1, b0, b1) in zip(("same", "rev"), chained(*places, batch.column(3)[i].as_py() - k, drift), strict=True):
                    if n:
                        rows.append(i)
                        found.append((name, n, a0, a1 + k, b0, b1 + k))
            if rows:
                kept = batch.select([0, 1, 2, 3, 4]).take(pa.array(rows))
                types = (pa.string(), pa.int64(), *[pa.int32()] * 4)
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, "orientation", "match_count", "a_min", "a_max", "b_min", "b_max"])

    return run


def overlaps(posted: DataFrame, lengths: DataFrame, k: int = K, w: int = W, drift: int = DRIFT, min_matches: int = MIN_MATCHES, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Chains along diagonals, the longest for each pair and orientation, classified by where it ends.

    A chain breaks where the diagonal jumps by more than ``drift``. Pairs with too few matches are known from counts and
    go before any place is joined; the places of a pair are a few arrays in one row, whatever number of matches they make.
    """
    enough = pair_counts(posted).where(F.col("matches") >= min_matches).select("a", "b")
    shared = _sides(posted.select("hash", "read_idx", "places", "seen"), "places", "seen").join(enough, ["a", "b"], "left_semi")
    at = lambda s: F.shiftright(F.col(f"places_{s}")[0], 1)
    found_at = F.struct(F.col("seen_a").alias("seen"), "a", at("a").alias("pos_a"), "b", at("b").alias("pos_b"))
    pairs = shared.groupBy("a", "b").agg(F.min(found_at).alias("found_at"), F.collect_list(F.struct("places_a", "places_b")).alias("places"))
    size = lambda s: lengths.select(F.col("read_idx").alias(s), F.col("length").alias(f"len_{s}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").select("a", "b", "len_a", "len_b", "found_at", "places")
    best = sized.mapInArrow(_chains(k, drift), CHAIN).where(F.col("match_count") >= min_matches)
    span = F.greatest(F.col("a_max") - F.col("a_min"), F.col("b_max") - F.col("b_min"))
    best = best.withColumn("overlap_len", span + 2 * w).where(F.col("overlap_len") >= min_overlap)
    best = best.withColumn("score", F.least(F.lit(1.0), F.col("match_count") / F.greatest(F.lit(1.0), span / float(w))))
    pick = Window.partitionBy("a", "b").orderBy(F.desc("match_count"), F.desc("orientation"))  # "same" before "rev"
    best = best.withColumn("rank", F.row_number().over(pick)).where("rank = 1")
    slack = max(2 * w + 15, 60)
    a0, a1, b0, b1 = F.col("a_min") <= slack, F.col("a_max") >= F.col("len_a") - slack, F.col("b_min") <= slack, F.col("b_max") >= F.col("len_b") - slack
    kind = F.when(a0 & a1, "A_contained_in_B").when(b0 & b1, "B_contained_in_A").when(a1 & b0, "A_to_B").when(b1 & a0, "B_to_A")
    columns = ["a", "b", "orientation", "type", "match_count", "overlap_len", "score", "a_min", "a_max", "b_min", "b_max", "len_a", "len_b", "found_at"]
    return best.withColumn("type", kind).where("type IS NOT NULL").select(*columns)


def contained(found: DataFrame) -> DataFrame:
    """read_idx of the reads inside another."""
    inside = F.when(F.col("type") == "A_contained_in_B", F.col("a")).when(F.col("type") == "B_contained_in_A", F.col("b"))
    return found.select(inside.alias("read_idx")).where("read_idx IS NOT NULL").distinct()


def dovetails(found: DataFrame) -> DataFrame:
    """Overlaps between ends of reads that are not contained, with end_a, end_b (L or R) and flip."""
    inside = contained(found)
    d = found.where(F.col("type").isin("A_to_B", "B_to_A"))
    for side in "ab":
        d = d.join(inside.select(F.col("read_idx").alias(side)), side, "left_anti")
    flip, forward = F.col("orientation") == "rev", F.col("type") == "A_to_B"
    end_b = F.when(forward, F.when(flip, "R").otherwise("L")).otherwise(F.when(flip, "L").otherwise("R"))
    return d.withColumns({"end_a": F.when(forward, "R").otherwise("L"), "end_b": end_b, "flip": flip})


def greedy_matching(edges: DataFrame) -> DataFrame:
    """The edges that a greedy choice takes, most matches first, then the earliest found; an end has one edge at most.

    An edge that is first at both its ends is taken whatever comes elsewhere, so each round
    takes all of those at once; it gives the greedy result in a few rounds.
    """
    order = F.struct((-F.col("match_count")).alias("k"), "found_at", "a", "b")
    ends = {"p": F.concat_ws(":", "a", "end_a"), "q": F.concat_ws(":", "b", "end_b")}
    left = materialize(edges.withColumns(ends).withColumn("order", order), "edges")
    taken = None
    while left.limit(1).count():
        each = left.select(F.explode(F.array("p", "q")).alias("end"), "order").groupBy("end").agg(F.min("order").alias("top"))
        top = materialize(each, "tops")
        side = lambda s: top.select(F.col("end").alias(s), F.col("top").alias(f"top_{s}"))  # noqa: B023, E731
        ranked = left.join(side("p"), "p").join(side("q"), "q")
        won = materialize(ranked.where((F.col("top_p") == F.col("order")) & (F.col("top_q") == F.col("order"))).drop("top_p", "top_q"), "matched")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("p", "q")).alias("end"))
        left = materialize(left.join(used.select(F.col("end").alias("p")), "p", "left_anti").join(used.select(F.col("end").alias("q")), "q", "left_anti"), "edges")
    return (taken if taken is not None else left).drop("p", "q", "order")


def contigs(reads: DataFrame, found: DataFrame) -> DataFrame:
    """contig_id, first_read, seq, length, circular, read_count and members of each path or cycle, longest first, then by first read.

    The layout is ``layout.placements``; ``layout.contig_chunks`` has the same contigs where a row should not hold one.
    """
    matched = materialize(greedy_matching(dovetails(found)), "matching")
    used = materialize(reads.select("read_idx", "seq").join(contained(found), "read_idx", "left_anti"), "used")
    placed = materialize(layout.placements(used.select("read_idx", F.length("seq").alias("length")), matched), "placed")
    members = F.array_sort(F.collect_list(F.struct("rank", "read_idx", "strand", F.col("contig_start").cast("int").alias("contig_start"), F.col("contig_end").cast("int").alias("contig_end"))))
    described = placed.groupBy("start").agg(F.first("length").cast("int").alias("length"), F.first("circular").alias("circular"), F.count(F.lit(1)).cast("int").alias("read_count"), members.alias("members"))
    numbered = described.select("start", "length").withColumn("number", F.row_number().over(Window.orderBy(F.desc("length"), "start"))).select("start", "number")  # two numbers a contig
    texts = layout.pieces(placed, used).groupBy("start").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "piece")))["piece"], "").alias("seq"))
    member = lambda m: F.struct(m["read_idx"].alias("read_idx"), m["strand"].alias("strand"), m["contig_start"].alias("contig_start"), m["contig_end"].alias("contig_end"))
    return described.join(numbered, "start").join(texts, "start").select(
        F.concat(F.lit("contig_"), F.col("number").cast("string")).alias("contig_id"), F.col("start").alias("first_read"), "seq", "length", "circular", "read_count", F.transform("members", member).alias("members")
    )


def assemble(reads: DataFrame, k: int = K, w: int = W, most: int = MAX_READS) -> tuple[DataFrame, DataFrame]:
    """Contigs and overlaps of reads (read_idx, seq)."""
    found = materialize(overlaps(materialize(postings(shared(reads, k, w, most)), "postings"), reads.select("read_idx", F.length("seq").alias("length")), k, w), "overlaps")
    return contigs(reads, found), found


def summary(reads: DataFrame, built: DataFrame, found: DataFrame) -> DataFrame:
    """One row: reads, contained, used, unplaced, overlaps, contigs, lengths, circles, mean score."""
    n = reads.agg(F.count(F.lit(1)).alias("input_reads"))
    c = built.agg(F.sum("read_count").alias("used_reads"), F.count(F.lit(1)).alias("contigs"), F.sum("length").alias("total_length"), F.max("length").alias("longest"), F.count_if("circular").alias("circular"))
    o = found.agg(F.count(F.lit(1)).alias("overlaps"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
    inside = contained(found).agg(F.count(F.lit(1)).alias("contained_reads"))
    row = n.crossJoin(c).crossJoin(o).crossJoin(inside)  # one row each
    return row.withColumn("unplaced_reads", F.col("input_reads") - F.col("contained_reads") - F.coalesce("used_reads", F.lit(0)))


def primary(built: DataFrame, share: float = 0.2) -> DataFrame:
    """Marks contigs of at least a share of the longest."""
    top = built.agg(F.max("length").alias("top"))
    return built.crossJoin(F.broadcast(top)).withColumn("is_primary", F.col("length") >= F.col("top") * share).drop("top")
