r"""Spelling variants by composing finite-state machines: vocabulary, one edit, vocabulary.

The vocabulary's words form an acceptor. Composed with a transducer that replaces, inserts or deletes one letter, and with
the acceptor again, it accepts exactly the pairs of words that are one edit apart. Before its edit a path of the composed
machine is in the same state on both sides; after it, the rest of both words must be the same, so it walks what the two
states reached have in common. In a minimised acceptor equal sets of endings are one state, so a pair of states stands for
many pairs of prefixes. Each state carries a mask of sums over the letters of its endings; states whose masks are
disjoint have nothing in common, and the walk does not enter them, so its time follows what it finds.

The work is dealt by initial state: the state that a prefix reaches. A prefix that more than ``block`` words have is
split by one letter more, so a task composes at most ``block`` words at a time, and a hot prefix is many tasks. Edits
inside the split prefixes lead from one part into another: there the two states' common endings are a join of the words
without the edited letter, whose groups are at most as large as the alphabet. An insertion into a run of equal letters
counts at the run's end, so every pair is found once. ``block`` grows with the vocabulary past 2**26 words, so that at most
4096 prefixes of each length are split; their list is all that reaches the driver.

Words come from whole texts: maximal runs of letters, A-Z lower-cased, some of which lose a letter by a rule that depends
on document and run only. Runs are counted in each task before they are shuffled.

Defined results: null texts have no runs; a null id counts as an empty one; repeated rows count each; words below the
least length or count take no part; a word without near words has none, no form, and is its own root; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import materialize, table

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
LOSES, BLOCK, PREFIXES = 199, 1 << 13, 4096
HELD, PAIRS, KNOWN, SUMS = 400_000, 100_000, 10_000, 4093
RUNS = "[a-zÀ-ÿ]"
PAIR = "word string, near string, near_n long"


def _count(least: int, loses: int):
    runs = re.compile(f"{RUNS}{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter(runs.findall(text.as_py().encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % loses == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return run


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LETTERS, min_count: int = MIN_COUNT, loses: int = LOSES) -> DataFrame:
    """word, n: the words of at least ``least`` letters that occur at least ``min_count`` times."""
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_count(least, loses), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def acceptor(words: list[str]) -> tuple[list[tuple[bool, dict[str, int]]], int]:
    """The minimal acceptor of sorted words: states (final, arcs), and the first state."""
    states: list[tuple[bool, dict[str, int]]] = []
    known: dict[tuple, int] = {}
    path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
    letters: list[str] = []

    def settle(final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        if key not in known:
            known[key] = len(states)
            states.append((final, arcs))
        return known[key]

    def close(upto: int) -> None:
        while len(path) > upto + 1:
            (final,), arcs = path.pop()
            path[-1][1][letters.pop()] = settle(final, arcs)

    for word in words:
        shared = 0
        while shared < min(len(letters), len(word)) and letters[shared] == word[shared]:
            shared += 1
        close(shared)
        for letter in word[shared:]:
            letters.append(letter)
            path.append(([False], {}))
        path[-1][0][0] = True
    close(0)
    return states, settle(path[0][0][0], path[0][1])


def masks(states: list[tuple[bool, dict[str, int]]]) -> list[int]:
    """For each state the sums, modulo SUMS, of its endings' letters, as a set of bits; an ending adds its letter to what follows it."""
    out: list[int] = []
    full = (1 << SUMS) - 1
    for final, arcs in states:  # states come after those that they lead to
        bits = int(final)
        for letter, to in arcs.items():
            by = ord(letter) * 2971 % SUMS
            bits |= (out[to] << by | out[to] >> (SUMS - by)) & full
        out.append(bits)
    return out


def composed(words: list[str]) -> Iterator[tuple[str, str]]:
    """The pairs of sorted words that acceptor, one edit and acceptor accept, each pair once."""
    states, root = acceptor(words)
    sums = masks(states)
    found: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """The endings that lead from both states to a final one."""
        if not sums[p] & sums[q]:
            return []
        key = (p, q) if p < q else (q, p)
        if key not in found:
            if len(found) >= KNOWN:
                found.clear()
            out, todo = [], [(*key, "")]
            while todo:
                a, b, ending = todo.pop()
                (final_a, arcs_a), (final_b, arcs_b) = states[a], states[b]
                if final_a and final_b:
                    out.append(ending)
                if len(arcs_a) > len(arcs_b):
                    arcs_a, arcs_b = arcs_b, arcs_a
                todo += [(to, arcs_b[letter], ending + letter) for letter, to in arcs_a.items() if letter in arcs_b and sums[to] & sums[arcs_b[letter]]]
            found[key] = out
        return found[key]

    walk, prefix = [iter([("", root)])], []
    while walk:
        step = next(walk[-1], None)
        if step is None:
            walk.pop()
            if prefix:
                prefix.pop()
            continue
        letter, state = step
        prefix.append(letter)
        arcs = list(states[state][1].items())
        for k, (a, to) in enumerate(arcs):
            for b, other in arcs[k + 1 :]:
                if endings := common(to, other):
                    head = "".join(prefix)
                    yield from ((f"{head}{a}{e}", f"{head}{b}{e}") for e in endings)
            if len(arcs) > 1 or states[state][0]:
                if endings := [e for e in common(to, state) if e[:1] != a]:
                    head = "".join(prefix)
                    yield from ((f"{head}{a}{e}", f"{head}{e}") for e in endings)
        walk.append(iter(arcs))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each part of rows (prefix, word, n), sorted by prefix and word."""

    def pairs(prefix: str, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int]] = []
        for a, b in composed([w[len(prefix) :] for w in counts]):
            a, b = prefix + a, prefix + b
            rows += [(a, b, counts[b]), (b, a, counts[a])]
            if len(rows) >= PAIRS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["word", "near", "near_n"])

    held, part = {}, None
    for batch in batches:
        for prefix, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if prefix != part and held:
                yield from pairs(part, held)
                held = {}
            part = prefix
            held[word] = n
    if held:
        yield from pairs(part, held)


def _placing(split: frozenset):
    """Rows (prefix, word, n): each word with the prefix of its part; a word that is a split prefix has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            prefixes = [next((w[:d] for d in range(len(w) + 1) if w[:d] not in split), None) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), *batch.columns], names=["prefix", "word", "n"])

    return run


def _edited(split: frozenset):
    """Rows (key, longer, word, n): what is left of a word without the letter after a split prefix, and the word to insert one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(len(word) + 1):
                    if word[:at] not in split:
                        break
                    rows.append((f"i{at}:{word}", False, word, n))
                    if at < len(word):
                        rest = word[:at] + word[at + 1 :]
                        rows.append((f"r{at}:{rest}", None, word, n))
                        if word[at : at + 1] != word[at + 1 : at + 2]:
                            rows.append((f"i{at}:{rest}", True, word, n))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["key", "longer", "word", "n"])

    return run


def split_prefixes(words: DataFrame, block: int, size: int) -> frozenset:
    """The prefixes that more than ``block`` words have, the empty one included; of each length at most ``size`` / ``block``."""
    heavy = [""] if size > block else []
    found, depth, held = set(heavy), 0, words
    while heavy:
        held = held.where(F.substring("word", 1, depth).isin(heavy) & (F.char_length("word") > depth))
        depth += 1
        counts = held.groupBy(F.substring("word", 1, depth).alias("prefix")).count().where(F.col("count") > block)
        heavy = [r.prefix for r in counts.collect()]
        found.update(heavy)
    return frozenset(found)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: every pair of words (word, n) that are one edit apart, in both directions."""
    size = words.count()
    block = max(block, -(-size // PREFIXES))
    split = split_prefixes(words, block, size)
    placed = words.select("word", "n").mapInArrow(_placing(split), "prefix string, word string, n long").where(F.col("prefix").isNotNull())
    within = placed.repartition("prefix").sortWithinPartitions("prefix", "word").mapInArrow(_compose, PAIR)
    if not split:
        return within
    edited = words.select("word", "n").mapInArrow(_edited(split), "key string, longer boolean, word string, n long")
    groups = edited.groupBy("key").agg(F.collect_list(F.struct("word", "n", "longer")).alias("group")).where(F.size("group") > 1)
    one = groups.select("group", F.explode("group").alias("one"))
    other = F.filter("group", lambda o: (o["word"] != F.col("one.word")) & (F.col("one.longer").isNull() | (o["longer"] != F.col("one.longer"))))
    across = one.select(F.col("one.word").alias("word"), F.explode(other).alias("o")).select("word", F.col("o.word").alias("near"), F.col("o.n").alias("near_n"))
    return within.unionByName(across)


def roots(links: DataFrame) -> DataFrame:
    """word, root of links (word, form): each round doubles how far a word looks, so a chain of n links takes log n rounds."""
    ends = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = materialize(ends.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not ends.where("moved").limit(1).count():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = materialize(words.select("word", "n"), "words")
    best = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    holds = -F.col("best.k") >= F.col("n") * ratio
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.k")).alias("form_n")
    )
    formed = materialize(formed, "formed")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


QUERIES = {"op13_spelling": op13_spelling}
#: DuckDB has no crc32; the tests hold the query against plain Python.
ORACLES: dict[str, str] = {}
