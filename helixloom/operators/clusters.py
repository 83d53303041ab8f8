"""Clusters of overlapping intervals, and greedy choices within them.

A cluster ends where no interval is open. Whether one is, the largest end so far says; it is kept as a running maximum within blocks
of positions and over the blocks before, so no task sorts a contig. What happens in one cluster changes nothing in another, so the
greedy rules (first free lane, best genes first) run over one cluster after the other, in tasks that hold one at a time.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = 1 << 18


def clustered(rows: DataFrame, *by: str, block: int = POSITIONS) -> DataFrame:
    """``rows`` (with start and end) and ``cluster``: the start of the first of a chain of intervals that overlap, for each ``by``."""
    keys = [*by, "__block"]
    placed = rows.withColumn("__block", F.floor(F.col("start") / block))
    order = Window.partitionBy(*keys).orderBy("start")
    blocks = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a contig
    ends = placed.groupBy(*keys).agg(F.max("end").alias("end")).withColumn("__open", F.max("end").over(blocks)).drop("end")
    met = placed.withColumn("__before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).join(ends, keys)
    reach = F.greatest("__before", "__open")
    begun = met.withColumn("__begin", F.when(reach.isNull() | (F.col("start") >= reach), F.col("start")))
    firsts = begun.groupBy(*keys).agg(F.max("__begin").alias("begin")).withColumn("__carried", F.max("begin").over(blocks)).drop("begin")
    within = F.max("__begin").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("__within", within).join(firsts, keys).select(*rows.columns, F.coalesce("__within", "__carried").alias("cluster"))


def by_group(rows: DataFrame, keys: list[str], order: list[str], choose: Callable[[list[tuple]], list], schema: str) -> DataFrame:
    """What ``choose`` makes of the rows of each group, in order; ``rows`` has the keys first, and a task holds one group at a time."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[tuple] = []
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:n] != row[:n]:
                    out += choose(held)
                    held = []
                    if len(out) >= 20_000:
                        yield batch_of()
                        out = []
                held.append(row)
        if held:
            out += choose(held)
        if out:
            yield batch_of()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def first_free(rows: list[tuple]) -> list[tuple]:
    """First-fit lanes of rows (contig, strand, cluster, start, feature_id, end) by start: of the free lanes the lowest, else a new one."""
    busy: list[tuple[int, int]] = []
    free: list[int] = []
    out, lanes = [], 0
    for contig, strand, _, start, feature, end in rows:
        while busy and busy[0][0] <= start:
            heapq.heappush(free, heapq.heappop(busy)[1])
        if free:
            lane = heapq.heappop(free)
        else:
            lane, lanes = lanes, lanes + 1
        heapq.heappush(busy, (end, lane))
        out.append((contig, feature, strand, lane))
    return out


def lanes(features: DataFrame) -> DataFrame:
    """contig, feature_id, strand, lane: where no feature is open every lane is free, so each cluster starts anew at lane 0."""
    rows = clustered(features.select("contig", "strand", "start", "feature_id", "end"), "contig", "strand")
    kinds = dict(features.dtypes)
    schema = f"contig {kinds['contig']}, feature_id {kinds['feature_id']}, strand string, lane long"
    keys = ["contig", "strand", "cluster"]
    found = by_group(rows.select(*keys, "start", "feature_id", "end"), keys, ["start", "feature_id"], first_free, schema)
    return found.withColumn("lane", F.col("lane").cast("int"))


def best_first(same_strand: int, opposite_strand: int) -> Callable[[list[tuple]], list[tuple]]:
    def choose(rows: list[tuple]) -> list[tuple]:
        """The rows (contig, cluster, strand, start, end, score) that overlap no better one by more than the allowance of their strands.

        Accepted rows are kept by start; none is longer than the longest so far, so only a stretch of them can overlap.
        """
        taken: list[tuple[int, int, str]] = []
        longest, out = 0, []
        for contig, _, strand, start, end, _ in sorted(rows, key=lambda r: (-r[5], r[2], r[3], r[4])):
            low, high = bisect.bisect_left(taken, (start - longest,)), bisect.bisect_left(taken, (end,))
            if all(min(e, end) - max(s, start) <= (same_strand if t == strand else opposite_strand) for s, e, t in taken[low:high]):
                bisect.insort(taken, (start, end, strand))
                longest = max(longest, end - start)
                out.append((contig, strand, start, end))
        return out

    return choose


def resolved(calls: DataFrame, same_strand: int, opposite_strand: int) -> DataFrame:
    """The calls (contig, strand, start, end, score) that stay, best scores first; no two may have one place and strand. Only these five columns meet in a cluster; all others join them afterwards."""
    kinds = dict(calls.dtypes)
    rows = clustered(calls.select("contig", "strand", "start", "end", "score"), "contig")
    keys = ["contig", "cluster"]
    schema = f"contig {kinds['contig']}, strand string, start long, end long"
    kept = by_group(rows.select(*keys, "strand", "start", "end", "score"), keys, ["start"], best_first(same_strand, opposite_strand), schema)
    kept = kept.select("contig", "strand", *[F.col(c).cast(kinds[c]).alias(c) for c in ("start", "end")])
    return calls.join(kept, ["contig", "strand", "start", "end"], "left_semi")
