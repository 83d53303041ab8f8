"""Functions for SQL: ``register(spark)`` names them in a session.

    SELECT d.contig, m.* FROM contigs d, LATERAL find_motif(d.seq, 'GRTAYC') m
    SELECT * FROM resolve_overlaps(TABLE(calls))

A call of the first kind sees one row; a null input gives no rows. The second kind takes a table with the named columns and
keeps all others; it asks for its rows by contig and start itself, and lets go of a cluster of overlapping intervals as soon as
nothing is open, so it holds no contig.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StructField, StructType

from helixloom.functions import stats, trees
from helixloom.operators import annotate, assembly, clusters, explorer
from helixloom.session import ensure_package
from helixloom.sources import sequences

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@udtf(returnType="start long, end long, strand string, match string")
class FindMotif:
    """Hits of an IUPAC motif on both strands, non-overlapping on each."""

    def eval(self, seq: str, motif: str) -> Iterator[tuple]:
        if seq is None or motif is None:
            return
        pattern, upper = re.compile(explorer.motif_pattern(motif)), seq.upper()
        turned = re.sub("[^ACGTN]", "N", upper)[::-1].translate(COMPLEMENT)
        for hit in pattern.finditer(upper) if pattern.pattern else ():
            yield hit.start(), hit.end(), "+", hit[0]
        for hit in pattern.finditer(turned) if pattern.pattern else ():
            start, end = len(seq) - hit.end(), len(seq) - hit.start()
            yield start, end, "-", re.sub("[^ACGTN]", "N", upper[start:end])


@udtf(returnType="hash long, pos int, strand int")
class Minimizers:
    """Minimizers of a read, in the order of their places."""

    def eval(self, seq: str, k: int, w: int) -> Iterator[tuple]:
        if seq is not None:
            for row in zip(*assembly.sketch(seq, k, w), strict=True):
                yield tuple(map(int, row))


@udtf(returnType="node int, parent int, name string, length double, support int")
class ParseNewick:
    """Nodes of a tree, children before their parent; the root has no parent."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        tree = trees.parse_newick(text)
        parent = {child: at for at, node in enumerate(tree.nodes) for child in node.children}
        for at, node in enumerate(tree.nodes):
            yield at, parent.get(at), node.name, float(node.length), node.support


@udtf(returnType="key string, value string")
class ParseGffAttributes:
    """Attributes of a GFF3 or GTF row."""

    def eval(self, raw: str) -> Iterator[tuple]:
        yield from sequences.attributes(raw).items()


def _asked(rows: AnalyzeArgument, needed: tuple[str, ...], by: tuple[str, ...], order: tuple[str, ...], added: tuple[StructField, ...] = ()) -> AnalyzeResult:
    """The result's columns, and how the function wants the table's rows."""
    if not rows.isTable:
        raise ValueError("the argument must be a table: TABLE(name)")
    if missing := set(needed) - set(rows.dataType.names):
        raise ValueError(f"the table needs the columns {sorted(missing)}")
    return AnalyzeResult(schema=StructType([*rows.dataType.fields, *added]), partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order])


class _Clusters:
    """Rows in the order of their starts, let go cluster by cluster."""

    def __init__(self):
        self.held: list[Row] = []
        self.reach = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.reach is not None and row["start"] >= self.reach:
            yield from self.chosen()
            self.held = []
        self.held.append(row)
        self.reach = row["end"] if self.reach is None else max(self.reach, row["end"])

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self.chosen()


@udtf
class ResolveOverlaps(_Clusters):
    """The rows (contig, strand, start, end, score, ...) that overlap no better one of their contig by more than the allowance."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _asked(rows, ("contig", "strand", "start", "end", "score"), ("contig",), ("start",))

    def chosen(self) -> Iterator[tuple]:
        named = [(k, None, r["strand"], r["start"], r["end"], r["score"]) for k, r in enumerate(self.held)]
        for k, *_ in clusters.best_first(annotate.SAME_STRAND, annotate.OPPOSITE_STRAND)(named):
            yield tuple(self.held[k])


@udtf
class PackLanes(_Clusters):
    """The rows (contig, strand, feature_id, start, end, ...) and the first free lane of each."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _asked(rows, ("contig", "strand", "feature_id", "start", "end"), ("contig", "strand"), ("start", "feature_id"), (StructField("lane", LongType()),))

    def chosen(self) -> Iterator[tuple]:
        placed = clusters.first_free([(None, None, None, r["start"], k, r["end"]) for k, r in enumerate(self.held)])
        for _, k, _, lane in placed:
            yield (*self.held[k], lane)


TABLE_FUNCTIONS = {"find_motif": FindMotif, "minimizers": Minimizers, "parse_newick": ParseNewick, "parse_gff_attributes": ParseGffAttributes, "resolve_overlaps": ResolveOverlaps, "pack_lanes": PackLanes}
SCALARS = {"betai": stats.betai, "chi_square_sf1": stats.chi_square_sf1}


def register(spark: SparkSession) -> None:
    ensure_package(spark)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    for name, function in SCALARS.items():
        spark.udf.register(name, function)
