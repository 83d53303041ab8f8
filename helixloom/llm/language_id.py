"""Language identification by hyperdimensional profiles.

Each letter (and the word gap) has a random vector of +1 and -1, drawn from its
code point. A trigram binds its letters, each permuted by its place:
``v(abc) = rot(rot(A)) * rot(B) * C``. A text bundles (adds) the vectors of all
its trigrams; a language's prototype bundles the unit vectors of its texts. A
text gets the language whose prototype has the largest cosine with it.

Prototypes are learned from at most ``per_language`` texts of each label, drawn by
a hash of the id from the rows that are not held out: a sample of bounded size,
which is a parameter. All labels are learned. All rows are predicted, whole texts,
in one pass without a shuffle. Each task holds one block of texts, a cache of
trigram vectors of 128 MB at most, and what it adds up for SLICE trigrams at a
time, however many letters a script has.

Defined results: null texts and texts without a letter are ``und`` with score
0; a very long text is counted in pieces, exactly; ties go to the first label in
order; with nothing to learn from, all rows are ``und``; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import held_out, materialize, table

UNDETERMINED = "und"
DIMENSIONS, SEED = 1024, 17
BLOCK_DOCS, BLOCK_LETTERS, CACHED_GRAMS, SLICE, COUNTS = 128, 1 << 19, 1 << 15, 1 << 12, 1 << 22
GAP = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1 << 14)
def letter(code: int) -> np.ndarray:
    """The vector of a code point, the same in every process."""
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def letters(text: str | None) -> np.ndarray | None:
    """Code points of the lower-case letters with single gaps between and around words; None if there is no letter."""
    if not text or not LETTER.search(text):
        return None
    return np.frombuffer(f" {GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32)


class Grams:
    """Trigram vectors, bound on demand and kept for later blocks, CACHED_GRAMS at most."""

    def __init__(self):
        self.keys, self.slots, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.vectors = np.empty((CACHED_GRAMS, DIMENSIONS), np.float32)  # takes memory as it fills

    def _bind(self, keys: np.ndarray) -> np.ndarray:
        codes, place = np.unique(np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]), return_inverse=True)
        base = np.stack([letter(int(c)) for c in codes])
        a, b, c = place.reshape(3, -1)
        return np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct keys, SLICE at most."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = keys[self.keys[at] != keys] if len(self.keys) else keys
        if self.used + len(new) > CACHED_GRAMS:
            self.keys, self.slots, self.used, new = self.keys[:0], self.slots[:0], 0, keys
        if len(new):
            self.vectors[self.used : self.used + len(new)] = self._bind(new)
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged)
            self.keys, self.slots = merged[order], np.concatenate([self.slots, np.arange(self.used, self.used + len(new))])[order]
            self.used += len(new)
        return self.vectors[self.slots[np.searchsorted(self.keys, keys)]]


def add_up(row: np.ndarray, gram: np.ndarray, rows: int, found: np.ndarray, grams: Grams) -> np.ndarray:
    """For each row the sum of the vectors of its trigrams (row, place in ``found``), a slice of trigrams at a time."""
    out = np.zeros((rows, DIMENSIONS))
    whole = rows * len(found) <= COUNTS
    if whole:
        table = np.bincount(row * len(found) + gram, minlength=rows * len(found)).reshape(rows, -1)
    else:  # many scripts: the counts of all at once would not fit
        order = np.argsort(gram)
        row, gram = row[order], gram[order]
        cuts = np.searchsorted(gram, np.arange(0, len(found) + SLICE, SLICE))
    for k, s in enumerate(range(0, len(found), SLICE)):
        keys = found[s : s + SLICE]
        if whole:
            counts = table[:, s : s + SLICE]
        else:
            a, b = cuts[k], cuts[k + 1]
            counts = np.bincount(row[a:b] * len(keys) + gram[a:b] - s, minlength=rows * len(keys)).reshape(rows, -1)
        out += counts.astype(np.float32) @ grams.of(keys)
    return out


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigram keys of the parts in order, and for each trigram its place among them."""
    codes = np.concatenate(parts)
    seen = np.flatnonzero(np.bincount(codes))
    symbol = np.zeros(seen[-1] + 1, np.int64)
    symbol[seen] = np.arange(len(seen))
    s, n = symbol[codes], len(seen)
    gram = (s[:-2] * n + s[1:-1]) * n + s[2:]
    inner = np.ones(len(gram), bool)  # without the trigrams that two parts would share
    for end in np.cumsum([len(p) for p in parts])[:-1]:
        inner[end - 2 : end] = False
    gram = gram[inner]
    if n**3 <= 1 << 23:  # a table of all possible trigrams is cheaper than sorting
        used = np.flatnonzero(np.bincount(gram, minlength=n**3))
        place = np.zeros(n**3, np.int32)
        place[used] = np.arange(len(used))
        place = place[gram]
    else:
        used, place = np.unique(gram, return_inverse=True)
    return seen[used // (n * n)] << 42 | seen[used // n % n] << 21 | seen[used % n], place


def bundle(texts: list[str | None], grams: Grams) -> np.ndarray:
    """Unit vectors of the texts, zero for a text without a letter."""
    out = np.zeros((len(texts), DIMENSIONS))
    keys, rows, held = [], [], 0

    def add() -> None:
        nonlocal keys, rows, held
        if keys:
            found, gram = distinct(keys)
            docs = np.unique([r[0] for r in rows])
            row = np.searchsorted(docs, np.concatenate(rows))
            out[docs] += add_up(row, gram, len(docs), found, grams)
        keys, rows, held = [], [], 0

    for k, text in enumerate(texts):
        if (codes := letters(text)) is None:
            continue
        for start in range(0, len(codes) - 2, BLOCK_LETTERS):
            part = codes[start : start + BLOCK_LETTERS + 2]
            keys.append(part)
            rows.append(np.full(len(part) - 2, k))
            held += len(part)
            if held >= BLOCK_LETTERS:
                add()
    add()
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, text): the sum of the unit vectors of each language."""
    grams, sums = Grams(), {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for start in range(0, len(langs), BLOCK_DOCS):
            unit = bundle(batch.column(1).slice(start, BLOCK_DOCS).to_pylist(), grams)
            for lang in set(langs[start : start + BLOCK_DOCS]):
                sums[lang] = sums.get(lang, 0) + unit[langs[start : start + BLOCK_DOCS] == lang].sum(0)
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "bundle": [v.tolist() for v in sums.values()]})


def learn(labelled: DataFrame, per_language: int = 4000) -> tuple[list[str], np.ndarray]:
    """Labels in order and their unit prototypes, from at most about ``per_language`` rows (doc_id, lang, text) of each label."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    rows = counts.agg(F.sum(F.least("n", F.lit(per_language)))).first()[0]
    if not rows:
        return [], np.zeros((0, DIMENSIONS))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(counts, "lang").where(draw < F.lit(per_language) / F.col("n"))
    parts = max(1, min(64, rows // 500))
    dealt = sample.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("share")).repartition(parts, "lang", "share")
    sums = dealt.select("lang", "text").mapInArrow(_bundles, "lang string, bundle array<double>").collect()  # a few rows a label
    labels = sorted({r["lang"] for r in sums})
    total = np.zeros((len(labels), DIMENSIONS))
    for r in sorted(sums, key=lambda r: (r["lang"], r["bundle"])):  # one order of summing for any order of tasks
        total[labels.index(r["lang"])] += r["bundle"]
    return labels, total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def predict(df: DataFrame, labels: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of rows (doc_id, held_out, text)."""
    model = df.sparkSession.sparkContext.broadcast((labels, prototypes))  # 8 KB a label

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, target = model.value
        grams = Grams()
        for batch in batches:
            pred, value = [], []
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                unit = bundle(batch.column(2).slice(start, BLOCK_DOCS).to_pylist(), grams)
                cosine = unit @ target.T if names else np.zeros((len(unit), 1))
                best = cosine.argmax(1)
                lost = ~unit.any(1) | (not names)
                pred += [UNDETERMINED if x else names[b] for x, b in zip(lost, best, strict=True)]
                value += np.where(lost, 0, np.clip(cosine[np.arange(len(best)), best], 0, 1)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(value, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(score, SCHEMA)


def identify(df: DataFrame, per_language: int = 4000) -> DataFrame:
    rows = df.select("doc_id", held_out().alias("held_out"), "lang", "text")
    return predict(rows, *learn(rows.where(~F.col("held_out")), per_language))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
