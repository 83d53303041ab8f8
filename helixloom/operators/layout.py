"""Contig layout by list ranking: where each read stands on its path, found for all paths at once.

A read can be walked through from either end; such a state has one state before it at most, which the matched edge at its
entered end names. Pointer jumping doubles in each round how far back a state looks, and counts steps and turns of the strand
on the way, so a path of n reads takes log n rounds over narrow rows, and a component is spread over all tasks. Cycles are cut
before the end at which their smallest read is entered. Offsets are sums along the ranks, first in blocks of ranks, then over blocks.

A path begins at the smaller of its two outer reads, a cycle at its smallest; the first read stands forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators.components import components
from helixloom.session import materialize
from helixloom.sources.chunks import CHUNK

BLOCK = 4096


def half_edges(matched: DataFrame) -> DataFrame:
    """Two rows for each edge: read, end, to, to_end, flip, and the overlap on the read (low, high, mirrored)."""
    sides = []
    for one, other in ("ab", "ba"):
        mirrored = F.lit(False) if one == "a" else F.col("orientation") == "rev"
        sides.append(
            matched.select(
                F.col(one).alias("read"), F.col(f"end_{one}").alias("end"), F.col(other).alias("to"), F.col(f"end_{other}").alias("to_end"), "flip",
                F.col(f"{one}_min").alias("low"), F.col(f"{one}_max").alias("high"), mirrored.alias("mirrored"),
            )
        )
    return sides[0].unionByName(sides[1])


def starts(halves: DataFrame, roots: DataFrame) -> DataFrame:
    """read, start, cycle of each read with an edge."""
    degree = halves.groupBy("read").agg(F.count(F.lit(1)).alias("edges"))
    placed = degree.join(roots.select(F.col("u").alias("read"), "root"), "read", "left").withColumn("root", F.coalesce("root", "read"))
    first = placed.groupBy("root").agg(F.min(F.when(F.col("edges") < 2, F.col("read"))).alias("outer")).select("root", F.coalesce("outer", "root").alias("start"), F.col("outer").isNull().alias("cycle"))
    return placed.join(first, "root").select("read", "start", "cycle")


def _state(read: Column, enter: Column) -> Column:
    return read * 2 + F.when(enter == "R", 1).otherwise(0)


def ranked(halves: DataFrame) -> DataFrame:
    """state, head, steps, turns of all states of the reads of paths; a head is entered at an end without an edge."""
    into = halves.select(_state(F.col("read"), F.col("end")).alias("state"), _state(F.col("to"), F.when(F.col("to_end") == "R", "L").otherwise("R")).alias("head"), F.lit(1).cast("long").alias("steps"), F.col("flip").cast("int").alias("turns"))
    heads = halves.select("read").distinct().select(F.explode(F.array(F.col("read") * 2, F.col("read") * 2 + 1)).alias("state")).join(into, "state", "left_anti")
    now = materialize(into.unionByName(heads.select("state", F.col("state").alias("head"), F.lit(0).cast("long").alias("steps"), F.lit(0).alias("turns"))), "states")
    while True:
        back = now.select(F.col("state").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"), F.col("turns").alias("also"))
        met = now.join(back, "head").select("state", F.col("further").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), F.col("turns").bitwiseXOR(F.col("also")).alias("turns"), (F.col("head") != F.col("further")).alias("moved"))
        now = materialize(met, "states")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def _span(length: Column, strand: Column, low: Column, high: Column, mirrored: Column) -> tuple[Column, Column]:
    """An overlap on a read, in the direction in which the read stands."""
    turned = (strand == -1) != mirrored
    return F.when(turned, length - high).otherwise(low), F.when(turned, length - low).otherwise(high)


def placements(lengths: DataFrame, matched: DataFrame) -> DataFrame:
    """start, rank, read_idx, strand, cut, contig_start, contig_end, circular, length: each read of ``lengths`` (read_idx, length) on its contig.

    ``start`` names the contig by its first read, ``cut`` is how much of the read the one before it covers, and ``length`` is the contig's.
    """
    halves = materialize(half_edges(matched), "halves")
    roots = components(matched.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = materialize(starts(halves, roots), "starts")
    met = halves.join(known, "read")
    closes = F.col("cycle") & (((F.col("read") == F.col("start")) & (F.col("end") == "L")) | ((F.col("to") == F.col("start")) & (F.col("to_end") == "L")))
    open_ = materialize(met.where(~closes).select(*halves.columns), "open")
    closing = met.where(closes & (F.col("to") == F.col("start")) & (F.col("to_end") == "L")).select(F.col("read").alias("read_idx"), F.struct("low", "high", "mirrored").alias("closing"))
    states = ranked(open_).select("steps", "turns", F.floor(F.col("state") / 2).alias("read"), F.when(F.col("state") % 2 == 1, "R").otherwise("L").alias("end"), F.floor(F.col("head") / 2).alias("start"))
    walked = states.join(known.select("read", "start"), ["read", "start"]).join(open_.select("read", "end", F.struct("low", "high", "mirrored").alias("into")), ["read", "end"], "left")
    linked = walked.select(F.col("read").alias("read_idx"), "start", F.col("steps").alias("rank"), F.when(F.col("turns") == 1, -1).otherwise(1).alias("strand"), "into")
    alone = lengths.join(known.select(F.col("read").alias("read_idx")), "read_idx", "left_anti").select("read_idx", F.col("read_idx").alias("start"), F.lit(0).cast("long").alias("rank"), F.lit(1).alias("strand"))
    rows = linked.unionByName(alone, allowMissingColumns=True).join(lengths.select("read_idx", F.col("length").alias("size")), "read_idx").join(closing, "read_idx", "left")
    covered = _span(F.col("size"), F.col("strand"), F.col("into.low"), F.col("into.high"), F.col("into.mirrored"))[1]
    rows = rows.withColumn("cut", F.when(F.col("into").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(covered, "size"))).cast("int"))
    rows = materialize(rows.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("adds", (F.col("size") - F.col("cut")).cast("long")), "laid")
    blocks = rows.groupBy("start", "block").agg(F.sum("adds").alias("adds"))
    before = blocks.select("start", "block", F.coalesce(F.sum("adds").over(Window.partitionBy("start").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("adds").over(Window.partitionBy("start", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("within", within).join(before, ["start", "block"]).withColumn("contig_start", F.col("before") + F.col("within")).withColumn("contig_end", F.col("contig_start") + F.col("adds"))
    stop = F.col("contig_start") + _span(F.col("size"), F.col("strand"), F.col("closing.low"), F.col("closing.high"), F.col("closing.mirrored"))[0] - F.col("cut")
    at = at.withColumn("stop", F.when((stop > F.col("contig_start")) & (stop < F.col("contig_end")), stop))  # the last read of a cycle ends where the first begins
    total = at.groupBy("start").agg(F.max("contig_end").alias("full"), F.max("stop").alias("closed"))
    at = at.join(total, "start").withColumn("contig_end", F.coalesce("stop", "contig_end"))
    return at.select("start", "rank", "read_idx", "strand", "cut", "contig_start", "contig_end", F.col("closed").isNotNull().alias("circular"), F.coalesce("closed", "full").alias("length"))


def pieces(placed: DataFrame, reads: DataFrame) -> DataFrame:
    """start, rank, contig_start, piece: what each read adds to its contig."""
    turned = F.reverse(F.translate("seq", S.BASES, S.COMPLEMENTS))
    standing = F.when(F.col("strand") == 1, F.col("seq")).otherwise(turned)
    piece = F.substring(standing, F.col("cut") + 1, (F.col("contig_end") - F.col("contig_start")).cast("int"))
    return placed.join(reads.select("read_idx", "seq"), "read_idx").select("start", "rank", "contig_start", "contig_end", "length", piece.alias("piece"))


def contig_chunks(placed: DataFrame, reads: DataFrame, size: int = CHUNK) -> DataFrame:
    """The contigs as a chunk table (contig, len, start, seq), named by their first reads: no row holds a contig."""
    cut = pieces(placed, reads).where("contig_end > contig_start")
    grid = cut.withColumn("grid", F.explode(F.sequence(F.floor(F.col("contig_start") / size) * size, F.col("contig_end") - 1, F.lit(size).cast("long"))))
    low = F.greatest("grid", "contig_start")
    part = F.substring("piece", (low - F.col("contig_start") + 1).cast("int"), (F.least(F.col("contig_end"), F.col("grid") + size) - low).cast("int"))
    whole = grid.groupBy(F.col("start").alias("contig"), F.col("length").alias("len"), F.col("grid").alias("start_at")).agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("part")))).alias("parts"))
    return whole.select("contig", "len", F.col("start_at").alias("start"), F.array_join(F.col("parts.part"), "").alias("seq"))
