"""Toxicity scores by gradient-boosted trees over dense features, calibrated isotonically.

Features of a text: densities of a fixed lexicon and of a lexicon learned from
the labels (whole words and stems), nearness of lexicon words to second-person
pronouns, rates of capitals, punctuation and obfuscated words, and lengths.

Learning uses at most ``max_labelled`` labelled rows, drawn by a hash of the id
from those that are not held out; the bound is a parameter. The sample is split
in three by another hash: the first part gives the learned lexicon, the second
the trees, the third the isotonic map. Only counts of stems that are frequent
among toxic texts, dense features and labels reach the driver. Scoring is one
pass over whole texts without a shuffle.

Defined results: null and empty texts have all features zero and get the score
of such a text; repeated rows get equal scores; without labelled rows of both
kinds the score is the share of toxic labels (0 with none); an empty table
gives an empty result; other columns are never read, and lang, source, labels
and doc_id are no features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.boosting import Forest, Isotonic, fit_forest, fit_isotonic
from helixloom.llm.common import held_out, table

THRESHOLD = 0.3
LEXICON = frozenset(
    "asshole bastard bitch clown crap cretin damn degenerate disgusting dumb dumbass filth freak fuck garbage hate hateful "
    "idiot idiotic imbecile kill loser lowlife moron parasite pathetic pig retard scum shit shut slut stupid trash ugly "
    "vermin whore worthless abruti connard connasse con crétin débile imbécile merde ordure pute salaud salope arschloch "
    "blödmann depp dreck dummkopf hurensohn idiotin scheiße schlampe schwein trottel wichser cabrón estúpido gilipollas "
    "idiota imbécil maldito mierda pendejo puta zorra".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros vuestro".split())
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that the learned lexicon may hold
NEAR = 5
MIN_TOXIC, STRONG, WEAK = 5, 0.8, 0.5
WORD = re.compile(r"\w+")
OBFUSCATED = re.compile(r"(?<!\S)\w*[^\W\d_][0-9@$*!.\-_]+[^\W\d_]\w*", re.ASCII)
LEET = str.maketrans("013457@$", "oieastas", "*.-_!")
RUNS = re.compile(r"(.)\1{3,}")
FEATURES = (
    "lexicon", "lexicon_share", "learned", "learned_share", "weak", "weak_share", "near", "near_share", "second_person", "capitals",
    "capital_words", "exclaims", "questions", "marks", "digits", "obfuscated", "leet_hits", "runs", "words", "word_length", "distinct",
)


def _grams(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


class Features:
    """Dense features of texts, given the learned lexicon: stem or word -> share of toxic texts."""

    def __init__(self, learned: dict[str, float]):
        self.learned, self.known = learned, {}

    def _kind(self, word: str) -> int:
        """Bits of a word: 1 fixed lexicon, 2 learned strong, 4 learned weak, 8 second person."""
        share = max((self.learned.get(g, 0.0) for g in _grams(word)), default=0.0)
        kind = (word in LEXICON) | (share >= STRONG) << 1 | (WEAK <= share < STRONG) << 2 | (word in SECOND_PERSON) << 3
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = kind
        return kind

    def of(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words = WORD.findall(text.lower())
        n, chars, known = max(1, len(words)), len(text), self.known
        kinds = [k if (k := known.get(w)) is not None else self._kind(w) for w in words]
        fixed = strong = weak = you = near = 0
        if any(kinds):
            addressed = -NEAR - 1
            pending: list[int] = []  # places of hits that no pronoun has followed or preceded so far
            for at, kind in enumerate(kinds):
                if not kind:
                    continue
                fixed += kind & 1
                strong += kind >> 1 & 1
                weak += kind >> 2 & 1
                if kind & 8:
                    you += 1
                    near += sum(at - p <= NEAR for p in pending)
                    pending, addressed = [], at
                if kind & 3:
                    if at - addressed <= NEAR:
                        near += 1
                    else:
                        pending.append(at)
        odd = OBFUSCATED.findall(text)
        leet = sum(w.lower().translate(LEET) in LEXICON for w in odd)
        exclaims, questions = text.count("!"), text.count("?")
        capitals = sum(map(str.isupper, text)) if not text.islower() else 0
        return [
            fixed, fixed / n, strong, strong / n, weak, weak / n, near, near / n, you / n, capitals / chars,
            sum(w.isupper() and len(w) > 1 for w in text.split()) / n if capitals > 0.1 * chars else 0.0, exclaims / chars, questions / chars,
            (exclaims + questions + sum(map(text.count, "*$#%&@"))) / chars, sum(map(text.count, "0123456789")) / chars, len(odd) / n, leet,
            len(RUNS.findall(text)) / n, np.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n,
        ]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.of(t) for t in texts], np.float32).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    learned: dict[str, float]
    forest: Forest
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.forest(x)), 0.0, 1.0)


def _counted(wanted: frozenset[str] | None):
    """Of rows (toxic, text): in how many toxic and other texts each gram occurs; of the wanted grams, if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = {g for w in set(WORD.findall((text or "").lower())) for g in _grams(w)}
                seen[toxic].update(grams if wanted is None else grams & wanted)
        for toxic, counts in seen.items():
            yield pa.RecordBatch.from_pydict({"gram": list(counts), "toxic": [toxic] * len(counts), "n": list(counts.values())}, schema=pa.schema([("gram", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    return count


def _counts(sample: DataFrame, wanted: frozenset[str] | None) -> dict[str, int]:
    """The grams of the sample and in how many texts each is; without ``wanted``, those in MIN_TOXIC texts or more."""
    counted = sample.select("toxic", "text").mapInArrow(_counted(wanted), "gram string, toxic int, n long")
    total = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= (MIN_TOXIC if wanted is None else 1))
    return {r["gram"]: r["n"] for r in total.collect()}


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems of which at least WEAK of the texts that hold them are toxic."""
    toxic = _counts(sample.where("toxic = 1"), None)
    others = _counts(sample.where("toxic = 0"), frozenset(toxic)) if toxic else {}
    share = {g: n / (n + others.get(g, 0)) for g, n in toxic.items()}
    return {g: s for g, s in share.items() if s >= WEAK}


def _featured(df: DataFrame, learned: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` and the features of rows with a text."""
    lexicon = df.sparkSession.sparkContext.broadcast(learned)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(lexicon.value)
        for batch in batches:
            x = make.matrix(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(x), pa.list_(pa.float32()))], names=[*keep, "x"])

    types = dict(df.dtypes)
    return df.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keep) + ", x array<float>")


def learn(labelled: DataFrame, max_labelled: int = 12_000) -> Model:
    """From rows (doc_id, text, toxic), of which at most about ``max_labelled`` are used."""
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(10))
    sample = labelled.where(draw < min(1.0, max_labelled / max(n, 1))).withColumn("part", part.cast("int"))
    sample = sample.select("toxic", "part", "text").repartition(max(1, min(64, min(n, max_labelled) // 250))).persist()
    try:
        learned = learned_lexicon(sample.where("part < 4"))
        rows = _featured(sample.where("part >= 4"), learned, ["toxic", "part"]).collect()
        prior = sample.agg(F.avg("toxic")).first()[0] or 0.0
    finally:
        sample.unpersist()
    if not rows:
        return Model(learned, Forest(), Isotonic.constant(prior))
    x, y, fold = np.array([r["x"] for r in rows], np.float32), np.array([r["toxic"] for r in rows]), np.array([r["part"] for r in rows])
    order = np.lexsort((*x.T[::-1], y, fold))  # collected rows come in any order
    x, y, fold = x[order], y[order], fold[order]
    trees, check = fold < 8, fold >= 8
    if len(set(y[trees])) < 2 or not check.any():
        return Model(learned, Forest(), Isotonic.constant(prior))
    forest = fit_forest(x[trees], y[trees])
    return Model(learned, forest, fit_isotonic(forest(x[check]), y[check]))


def predict(df: DataFrame, model: Model, keep: list[str], with_text: bool = False) -> DataFrame:
    """``keep``, the text if asked for, and the score of every row with a text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    given = [*keep, "text"] if with_text else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(shared.value.learned)
        for batch in batches:
            texts = batch.column(len(keep))
            score = [shared.value.score(make.matrix(texts.slice(s, 512).to_pylist())) for s in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(np.concatenate([[], *score]), pa.float64())], names=[*given, "score"])

    types = dict(df.dtypes)
    return df.select(*[F.col(k) for k in keep], "text").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in given) + ", score double")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text, toxic) that may be learned from, one label for an id."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id", "text").where(~held_out()).join(known, "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(labelled_rows(docs, labels), max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
