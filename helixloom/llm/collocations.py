r"""Collocations by dynamic itemset counting: phrases of all lengths are counted at once, in cyclic scans over shards.

The corpus is dealt into SHARDS shards, and step t scans shard t mod SHARDS. Words are counted from step 0 on. A longer
phrase becomes active as soon as both phrases that it has without its last and without its first word have reached the
threshold, at whichever step that is, and is counted until it has completed one full cycle from there. So long phrases
start while short ones are still being counted, and no length waits for the end of a pass.

During the scans a phrase is a 64-bit hash. Counts are summed in each chunk and shuffled as blocks: a row holds the
hashes of one range and their counts as arrays, ranges being narrow enough for a task to add up a few at a time (about
BLOCK_BYTES of text a range). The state is a table of blocks in the shared folder: the phrases whose cycle runs and that
are below the threshold. What has reached it goes into an array of bytes by hash, which says from which step on a phrase can extend others; tasks get it
by broadcast. It has at most MAX_SLOTS bytes (64 MiB), whatever the corpus. Two phrases in one slot make more phrases
active, never fewer: a phrase is active from the step that its slots say, always the same, for one full cycle. When no
cycle runs any more, a last scan spells out the phrases that reached the threshold and counts their texts, so that a
count never depends on a hash.

Scores, as integers: cutting a phrase into a first part and a rest gives floor(2000000 a / (l + r)), a, l and r being the
counts of the phrase and its parts; the lowest-scoring cut counts, of equal ones the first.

Defined results: a null text has no words and a null language is ``und``; a text without words counts nothing; repeated
rows count each; ties are ranked by count, then by the bytes of the phrase; a very long text is read in chunks that end
where a phrase ends; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.llm.common import BITMAP_SHIFT, bitmaps, fresh_path, materialize, table
from helixloom.session import delete

SHARDS, LONGEST = 4, 4
LEAST, TOP, ABSORBED = 30, 2000, 80
MIN_SLOTS, MAX_SLOTS, BYTES_PER_SLOT = 1 << 16, 1 << 26, 48
CHUNK, KEYS, HASHED = 8 << 20, 1 << 22, 1 << 20
RANGES, BLOCK_BYTES, MERGED = 1 << 13, 4 << 20, 1 << 21
BLOCK = "bucket int, seen int, done boolean, keys binary, n binary"
SALTS = 8
PRIME = 0x9E3779B97F4A7C15
LETTERS = bytearray(range(256))
LETTERS[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    LETTERS[_c] = 10
LETTERS[9] = 32
TAG = np.uint64(3)  # the low bits of a hash say how many words the phrase has, less one


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: differences of running sums of bytes times powers, taken back to the word's start."""
    out = np.empty(len(begins), np.uint64)
    at, powers, inverse = 0, np.zeros(0, np.uint64), pow(PRIME, -1, 1 << 64)
    while at < len(begins):
        upto = max(at + 1, int(np.searchsorted(ends, begins[at] + HASHED, "right")))
        low, size = begins[at], int(ends[upto - 1] - begins[at])
        if len(powers) < size:
            powers, back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(max(size, HASHED), p, np.uint64))) for p in (PRIME, inverse))
        sums = np.append(np.uint64(0), np.cumsum(data[low : low + size] * powers[:size], dtype=np.uint64))
        b, e = begins[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[e] - sums[b]) * back[b]
        at = upto
    return out


class Words:
    """The words of some documents: places, pieces, languages, and hashes of the phrases that start at each word."""

    def __init__(self, data: bytes, edges: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        self.data = np.frombuffer(data, np.uint8)
        gap = (self.data == 32) | (self.data == 10)
        edge = np.zeros(len(gap) + 1, bool)
        edge[edges] = True
        self.begins = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | edge[:-1]))
        self.ends = np.flatnonzero(~gap & (np.append(gap[1:], True) | edge[1:])) + 1
        self.piece = np.cumsum((self.data == 10) | edge[:-1], dtype=np.int32)[self.begins]
        self.lang = np.repeat(langs, np.diff(np.searchsorted(self.begins, edges)))
        first = _mix(_hashes(self.data, self.begins, self.ends) + seeds[self.lang])
        self.hash = [first & ~TAG]
        for n in range(1, LONGEST):
            if len(first) <= n:
                break
            longer = _mix(self.hash[-1][:-1] * np.uint64(PRIME) + first[n:])
            self.hash.append(longer & ~TAG | np.uint64(n))

    def whole(self, n: int) -> np.ndarray:
        """Where n + 1 words stand in one piece."""
        return self.piece[: len(self.piece) - n] == self.piece[n:]

    def text(self, of: np.ndarray) -> pa.Array:
        """The words at places ``of``, as an array of strings."""
        sizes = self.ends[of] - self.begins[of]
        upto = np.append(0, np.cumsum(sizes))
        at = np.arange(upto[-1]) + np.repeat(self.begins[of] - upto[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(of), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(self.data[at]))


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(b"\n", at, at + CHUNK)
        cut = cut if cut > at else text.find(b"\n", at + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of rows (lang, text), some documents at a time, and the names of their languages."""
    import xxhash

    table_, held, size = bytes(LETTERS), [], 0

    def words() -> tuple[Words, list[str]]:
        names = sorted({lang for lang, _ in held})
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
        edges = np.append(0, np.cumsum([len(t) for _, t in held]))
        return Words(b"".join(t for _, t in held), edges, np.searchsorted(names, [lang for lang, _ in held]), seeds), names

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            for part in _parts(text.as_py().translate(table_)):
                held.append((lang, part))
                size += len(part)
                if size >= CHUNK:
                    yield words()
                    held, size = [], 0
    if held:
        yield words()


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(2)) & np.uint64(slots - 1)


def _blocks(keys: np.ndarray, n: np.ndarray, seen: int, done: bool, ranges: int) -> pa.RecordBatch:
    """Sorted hashes and their counts as blocks, one for each range of hashes that has some."""
    bucket = (keys >> np.uint64(65 - ranges.bit_length())).astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]])
    packed = lambda x: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    shared = lambda x, kind: pa.array(np.full(len(cuts) - 1, x), kind)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), shared(seen, pa.int32()), shared(done, pa.bool_()), packed(keys), packed(n.astype(np.uint32))], names=["bucket", "seen", "done", "keys", "n"])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of the blocks of a column, one after the other, and how many each block has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _merging(least: int, ranges: int) -> Callable:
    """Blocks that come by range, added up: the hashes below the threshold by the step at which they were first seen, and those that reach it."""

    def merged(keys: np.ndarray, n: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n, seen = keys[starts], np.minimum(np.add.reduceat(n[order], starts, dtype=np.int64), least), np.minimum.reduceat(seen[order], starts)
        done = n >= least
        for step in np.unique(seen):
            for kind in (False, True):
                of = (seen == step) & (done == kind)
                if of.any():
                    yield _blocks(keys[of], n[of], int(step), kind, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = _unpacked(batch.column(3), np.uint64)
            held.append((keys, _unpacked(batch.column(4), np.uint32)[0], np.repeat(batch.column(1).to_numpy().astype(np.int16), sizes)))
            size += len(keys)
            if size >= MERGED:  # all but the last range, of which more may come
                keys, n, seen = (np.concatenate(x) for x in zip(*held, strict=True))
                last = keys >= np.uint64(batch.column(0)[-1].as_py() << (65 - ranges.bit_length()))
                if not last.all():
                    yield from merged(keys[~last], n[~last], seen[~last])
                held, size = [(keys[last], n[last], seen[last])], int(last.sum())
        if size:
            yield from merged(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _extending(slots: int) -> Callable:
    """The slots of the hashes in blocks; the longest phrases have slots of their own, past the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _unpacked(batch.column(0), np.uint64)[0]
                longest = (keys & TAG) == np.uint64(LONGEST - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(keys, slots).astype(np.int64) + longest * slots))], names=["slot"])

    return run


def _counting(since, step: int, shards: int, least: int, ranges: int) -> Callable:
    """Blocks of counts of the phrases that are active at a step; ``since`` has the step from which a slot extends others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_step, held, size = since.value, [], 0

        def counts() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return _blocks(keys, np.minimum(n, least), step, False, ranges)

        for words, _ in chunks(batches):
            if step < shards:
                held.append(words.hash[0])
            for n in range(1, len(words.hash)):
                shorter = from_step[_slot(words.hash[n - 1], len(from_step))]
                if n > 1:
                    shorter = np.where(words.whole(n - 1), shorter, 0)
                first, rest = shorter[:-1], shorter[1:]
                begun = np.maximum(first, rest)
                active = (first > 0) & (rest > 0) & (step < begun.astype(np.int16) + shards) & words.whole(n)
                held.append(words.hash[n][active])
            size = sum(map(len, held))
            if size >= KEYS:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    return run


def _places(rows: list) -> np.ndarray:
    """The slots that are set in the bitmaps of rows (bucket, bits)."""
    found = [(r.bucket << BITMAP_SHIFT) + np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")) for r in rows]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def frequent_slots(spark: SparkSession, path: str, slots: int, least: int, shards: int, ranges: int = RANGES) -> np.ndarray:
    """The dynamic count over the shards at ``path``: for each slot the step from which its phrases extend others, 0 for none."""
    since = np.zeros(slots, np.uint8)
    state, before, step, last, dealt = None, None, 0, -1, spark.read.parquet(path)
    while step - last <= shards:  # a phrase that the last new one makes active has its cycle from step last + 1 on
        shared = spark.sparkContext.broadcast(since)
        shard = dealt.where(F.col("shard") == step % shards).select("lang", "text")
        running = shard.mapInArrow(_counting(shared, step, shards, least, ranges), BLOCK)
        if state is not None:
            running = running.unionByName(state.where(~F.col("done") & (F.col("seen") + shards > step)))
        now = fresh_path(spark, f"phrases-{step}")
        running.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merging(least, ranges), BLOCK).write.option("compression", "zstd").parquet(now)
        shared.destroy()
        state = spark.read.schema(BLOCK).parquet(now)
        if before:
            delete(spark, before)
        before = now
        places = _places(bitmaps(state.where("done").select("keys").mapInArrow(_extending(slots), "slot long")).collect())  # at most slots / 4 bytes
        new = places[since[places % slots] == 0]
        since[new % slots] = step + 1
        last = step if np.any(new < slots) else last
        step += 1
    delete(spark, before)
    return since


def _spelling(kept) -> Callable:
    """Counts (lang, words, phrase, n) of the phrases whose slots are kept, by their texts; with no words, all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = kept.value
        for words, names in chunks(batches):
            n_words = np.bincount(words.lang, minlength=len(names))
            out = [(np.arange(len(names)), 0, pa.array([""] * len(names), pa.large_string()), n_words)]
            masks = [since[_slot(h, len(since))] > 0 for h in words.hash]
            masks = [m & words.whole(n) for n, m in enumerate(masks)]
            for n in range(1, len(masks)):  # what has reached the threshold has parts that have
                masks[n] &= masks[n - 1][:-1] & masks[n - 1][1:]
            used = np.zeros(len(words.begins), bool)
            for n, mask in enumerate(masks):
                for k in range(n + 1):
                    used[k : k + len(mask)] |= mask
            of = np.flatnonzero(used)
            if len(of):
                encoded = words.text(of).dictionary_encode()
                code = np.full(len(used), -1, np.int64)
                code[of] = encoded.indices.to_numpy()
                spelled, size = encoded.dictionary, len(encoded.dictionary)
                for n, mask in enumerate(masks):
                    at = np.flatnonzero(mask)
                    key = words.lang[at] * size + code[at]
                    for k in range(1, n + 1):
                        key = np.unique(key, return_inverse=True)[1] * size + code[at + k]
                    _, first, count = np.unique(key, return_index=True, return_counts=True)
                    at = at[first]
                    parts = [spelled.take(pa.array(code[at + k])) for k in range(n + 1)]
                    out.append((words.lang[at], n + 1, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), count))
            for lang, n, phrase, count in out:
                columns = [pa.array(np.array(names, object)[lang], pa.string()), pa.array(np.full(len(lang), n, np.int32)), phrase.cast(pa.string()), pa.array(count, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])

    return run


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, shards: int = SHARDS, max_slots: int = MAX_SLOTS) -> DataFrame:
    """lang, words, phrase, n: all phrases of one to four words with a count of ``least`` or more, and one row without words for each language."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    seen, path = Observation(), fresh_path(spark, "shards")
    dealt = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"), shard.alias("shard")).observe(seen, F.sum(F.octet_length("text")).alias("bytes"))
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    wanted = (seen.get.get("bytes") or 0) // BYTES_PER_SLOT
    slots = min(max_slots, max(MIN_SLOTS, 1 << wanted.bit_length()))
    if not seen.get.get("bytes"):
        return spark.createDataFrame([], "lang string, words int, phrase string, n long")
    ranges = max(RANGES, 1 << min(30, (seen.get["bytes"] // BLOCK_BYTES).bit_length()))
    kept = spark.sparkContext.broadcast(frequent_slots(spark, path, slots, least, shards, ranges))
    spelled = spark.read.parquet(path).select("lang", "text").mapInArrow(_spelling(kept), "lang string, words int, phrase string, n long")
    return materialize(spelled.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least)), "counts")


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def ranked(counts: DataFrame, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The collocations of each language by score, of the counts that ``phrase_counts`` gives."""
    split = F.split("phrase", " ")
    found = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), split.alias("w"))
    joined = lambda w, start, size: F.array_join(F.slice(w, start, size), " ")
    cut = found.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.col("w"), F.lit(1), F.col("k")).alias("first"), joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    parts = counts.where(F.col("words").between(1, LONGEST - 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    for name, size in (("first", "l"), ("rest", "r")):
        cut = cut.join(parts.select("lang", "salt", F.col("phrase").alias(name), F.col("n").alias(size)), ["lang", "salt", name])
    score = F.call_function("div", _exact(F.col("a")) * F.lit(2000000).cast("decimal(7,0)"), _exact(F.col("l")) + _exact(F.col("r")))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spans = [(start, size) for size in range(2, LONGEST) for start in range(1, LONGEST - size + 2)]
    inner = F.array(*[F.when((F.col("words") > size) & (F.col("words") >= start + size - 1), joined(F.col("w"), F.lit(start), F.lit(size))) for start, size in spans])
    longer = found.where("words > 2").select("lang", "a", F.explode(F.array_compact(F.array_distinct(inner))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(_exact(F.col("longer")) * 100 < _exact(F.col("a")) * absorbed, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    return first.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(phrase_counts(table(spark, sf_dir, "documents")))


def oracle(least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cuts = "\nUNION ALL ".join(f"SELECT lang, w, a, {k} AS k, w[1:{k}] AS x, w[{k + 1}:] AS y FROM c WHERE len(w) > {k}" for k in (1, 2, 3))
    inner = "\nUNION ALL ".join(f"SELECT lang, w[{s}:{s + n - 1}] AS w, a FROM c WHERE len(w) > {n} AND len(w) >= {s + n - 1}" for n in (2, 3) for s in range(1, 6 - n))
    return f"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        s AS (SELECT lang, list_filter(string_split(translate(p, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM t),
        g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s WHERE len(w) > 0),
        n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, w, count(*) AS a FROM ({" UNION ALL ".join(f"SELECT lang, w[i:i + {k}] AS w FROM g WHERE i + {k} <= len(w)" for k in range(4))}) GROUP BY lang, w HAVING count(*) >= {least}),
        c AS (SELECT * FROM f WHERE len(w) > 1),
        cut AS ({cuts}),
        scored AS (SELECT cut.lang, cut.w, cut.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * cut.a // (l.a + r.a))::BIGINT AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.w = x JOIN f r ON r.lang = cut.lang AND r.w = y),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
        longer AS (SELECT lang, w, max(a) AS b FROM ({inner}) GROUP BY lang, w),
        free AS (SELECT best.*, array_to_string(best.w, ' ') AS phrase FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.w = best.w WHERE b IS NULL OR 100 * b < {absorbed} * a)
        SELECT free.lang, row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM free JOIN n ON n.lang = free.lang
        QUALIFY row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, phrase) <= {top}"""


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": oracle()}
