"""Connected components by alternating large-star and small-star rounds.

Each round groups with partial sums and joins on unique keys, so that a node
with very many links needs no group of its own in memory; its rows may be split
by the skew join. Each round's edges are a table in the shared folder, which
cuts the lineage. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.session import materialize


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))


def _spread(edges: DataFrame, what: str) -> DataFrame:
    """The edges with the smallest neighbour m of u."""
    return edges.join(materialize(_smallest(edges), what), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _spread(both, "large-star").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _spread(down, "small-star").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return met.select("e.*").where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (u, root) for every node of the edges (u, v) but the roots; root is the smallest node."""
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "edges")), "edges")
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select("u", F.col("v").alias("root"))
