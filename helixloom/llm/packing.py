"""Packing token streams into fixed windows by an order-preserving dynamic programme.

Documents stay in the order in which their partition holds them. Windows may be
cut after a document, after a sentence, or, where a sentence is longer than
FORCED tokens, after each FORCED tokens of it at a higher penalty. The programme picks the cuts that minimise padding
plus a penalty for each cut inside a document: with tokens c_i before cut i,

    f_j = penalty_j + min over i with c_j - c_i <= window of (f_i + window - (c_j - c_i))

and since f_i + c_i does not depend on j, a monotone queue of the candidates
inside the window gives each minimum in constant time.

No row is shuffled: a task tokenizes and packs its own rows in chunks of about
CHUNK tokens, and hands the open last window of a chunk on to the next chunk.
Only the last window of a task is padded for lack of text. Memory is a chunk
plus one document.

Token ids are those of the vocabulary file in the ``tokenizers`` library. The
same vocabulary as ranks in ``tiktoken`` gives equal ids about five times as
fast and is used for texts without a special-token string; the tests hold the
two against each other.

Defined results: a null or empty text is the end id alone (one token); very
long documents are cut into many pieces; repeated rows are packed as often as
they occur; an empty table gives no piece; other columns are never read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from helixloom.llm.common import table

VOCABULARY, RANKS, END_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 0
WINDOW = 1024
SENTENCE_PENALTY, FORCED_PENALTY, FORCED = 4, 24, 48
CHUNK = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Tokens:
    """The ids of a text, and which ids end a sentence."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.exact.get_vocab_size(), bool)
        for token, rank in found.items():
            self.ends[rank] = b"\n" in token or token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


@cache
def tokens() -> Tokens:
    return Tokens()


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions at which a window may be cut, from 0 to len(ids), and the penalty of each."""
    n = len(ids)
    stop = ends[ids]
    stop[:-1] &= ~stop[1:]
    penalty = np.full(n + 1, -1, np.int64)
    penalty[1:][stop] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[[0, n]] = 0
    at = np.flatnonzero(penalty >= 0)
    step = min(FORCED, window)
    for k in np.flatnonzero(np.diff(at) > step):
        inside = np.arange(at[k] + step, at[k + 1], step)
        penalty[inside] = FORCED_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The positions, first and last included, of the cheapest windows."""
    c, p = at.tolist(), penalty.tolist()
    m = len(c)
    value, back, queue, head = [0] * m, [0] * m, [0], 0  # value[i] = f_i + c_i
    for j in range(1, m):
        here = c[j]
        while here - c[queue[head]] > window:
            head += 1
        i = back[j] = queue[head]
        v = value[j] = p[j] + window + value[i]
        while len(queue) > head and value[queue[-1]] > v:
            queue.pop()
        queue.append(j)
        if head > 4096:
            del queue[:head]
            head = 0
    cuts, j = [c[-1]], m - 1
    while j:
        j = back[j]
        cuts.append(c[j])
    return cuts[::-1]


class Packer:
    """Packs what it is given, keeping the open last window until more comes."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.sequence, self.tokens = window, first_sequence, tokens()
        self.parts: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        ids = np.append(self.tokens.ids(text or ""), np.uint32(END_ID)).astype("<u4", copy=False)
        self.parts.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        ids = np.concatenate([part[2] for part in self.parts])
        edges = np.concatenate([[0], np.cumsum([len(part[2]) for part in self.parts])])
        cuts = np.array(best_cuts(*candidates(ids, edges[1:], self.tokens.ends, self.window), self.window))
        starts = np.union1d(edges[:-1], cuts[:-1])
        stops = np.append(starts[1:], edges[-1])
        sequence = np.searchsorted(cuts, starts, "right") - 1
        doc = np.searchsorted(edges, starts, "right") - 1
        keep = len(starts) if last else int(np.searchsorted(sequence, len(cuts) - 2))
        rows = {name: [] for name in ARROW.names}
        for s, e, q, d in zip(*(x[:keep].tolist() for x in (starts, stops, sequence, doc)), strict=True):
            doc_id, begin, _, total = self.parts[d]
            for name, value in zip(ARROW.names, (doc_id, begin + s - int(edges[d]), e - s, zlib.crc32(ids[s:e]), total, self.sequence + q, s - int(cuts[q])), strict=True):
                rows[name].append(value)
        rest = []
        for s, e, d in zip(*(x[keep:].tolist() for x in (starts, stops, doc)), strict=True):
            doc_id, begin, _, total = self.parts[d]
            rest.append((doc_id, begin + s - int(edges[d]), ids[s:e].copy(), total))
        self.sequence += len(cuts) - 1 - (not last)
        self.parts, self.held = rest, sum(len(part[2]) for part in rest)
        return pa.RecordBatch.from_pydict(rows, schema=ARROW) if keep else None


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = Packer(TaskContext.get().partitionId() << 40)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packer.add(doc_id, text.as_py())
            if packer.held >= CHUNK and (out := packer.flush(last=False)):
                yield out
    if out := packer.flush(last=True):
        yield out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: where it stands in its document and in its sequence."""
    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_pack, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
