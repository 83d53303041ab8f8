"""Quality scores by co-training a text view and a metadata view.

The text view is boosted trees over dense statistics of the text; the metadata
view is a logistic regression over length, language and source as the table
states them. Both start from the labelled rows. In each round, each view looks
at all unlabelled rows that are not held out and hands the other view the
``per_round`` different rows of which it is most sure, in the proportion of the
labels; the other view is then fitted anew. A view may only hand labels beyond
the score from which it was right, by an exact test on labelled rows held back
for this alone: more often than CONFIDENT and than the label's share among all of
them. The test is made for TESTS scores and corrected for their number, so a view
without signal gets to hand a label in under one percent of all cases. At the end
each view is calibrated isotonically on other rows held back from both views, and
a logistic regression over both calibrated log odds gives the score; it is fitted
on what maps say of rows from which they were not fitted.

The features of all rows are written once, whole texts, and both the rounds and
the scoring read that narrow table. Fitting uses at most about ``max_labelled``
labelled rows, a parameter; only they and the handed rows reach the driver.

Defined results: a null or empty text has all text features zero, null metadata
has a category of its own, and both get a score; repeated rows get equal scores
and are handed once; without labels of both kinds the score is the share of good
labels (0.5 with none); an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.llm.boosting import Forest, Isotonic, fit_forest, fit_isotonic, fit_logistic, sigmoid
from helixloom.llm.common import held_out, materialize, table

SYMBOLS = "#$%&*+<=>@[]^_{|}~\\"
SENTENCE_END = re.compile(r"[.!?](?=\s|$)")
TEXT_FEATURES = 18
LANG_BUCKETS, SOURCE_BUCKETS = 16, 64
META_FEATURES = 2 + LANG_BUCKETS + SOURCE_BUCKETS
CONFIDENT, CHANCE, TESTS, ROUNDS, PER_ROUND = 0.9, 0.0075, 20, 3, 600


def text_features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * TEXT_FEATURES
    words, lines, chars = text.split(), text.split("\n"), len(text)
    n = max(1, len(words))
    counts = Counter(words)
    filled = [x for x in lines if x]
    symbols = sum(map(text.count, SYMBOLS))
    upper = 0 if text.islower() else sum(map(str.isupper, text))
    stops = len(SENTENCE_END.findall(text))
    most = counts.most_common(1)[0][1] if counts else 0
    weights = np.fromiter(counts.values(), float) / n if counts else np.ones(1)
    return [
        math.log1p(chars), math.log1p(n), symbols / chars, upper / chars, sum(map(text.count, "0123456789")) / chars, text.count("!") / n,
        sum(map(text.count, ".,;:?")) / n, len(counts) / n, most / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(filled)) / max(1, len(filled)), chars / n, stops / n, math.log1p(len(filled)), n / max(1, len(filled)),
        float(-(weights * np.log(weights)).sum() / max(1.0, math.log(n + 1))), sum(w[-1] in SYMBOLS for w in words) / n, len(text.split("http")) / n,
    ]


def meta_matrix(chars: np.ndarray, lang_at: np.ndarray, source_at: np.ndarray) -> np.ndarray:
    """Of lengths (NaN where unknown) and the buckets of language and source."""
    m, rows = np.zeros((len(chars), META_FEATURES)), np.arange(len(chars))
    m[:, 0], m[:, 1] = np.log1p(np.maximum(0, np.nan_to_num(chars))), np.isnan(chars)
    m[rows, 2 + lang_at] = 1
    m[rows, 2 + LANG_BUCKETS + source_at] = 1
    return m


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


@dataclass
class Model:
    prior: float = 0.5
    forest: Forest = field(default_factory=Forest)
    linear: np.ndarray = field(default_factory=lambda: np.zeros(META_FEATURES + 1))
    text_map: Isotonic | None = None
    meta_map: Isotonic | None = None
    mix: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def raw(self, x: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
        return {"text": self.forest(x), "meta": np.column_stack([m, np.ones(len(m))]) @ self.linear}

    def views(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.raw(x, m)
        return self.text_map(raw["text"]), self.meta_map(raw["meta"])

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text_map is None:
            same = np.full(len(x), self.prior)
            return same, same, same
        a, b = self.views(x, m)
        return a, b, sigmoid(np.column_stack([_log_odds(a), _log_odds(b), np.ones(len(a))]) @ self.mix)


def _at_least(n: int, right: int, p: float) -> float:
    """The chance that of n tries ``right`` or more succeed, each with chance p."""
    k = np.arange(right, n + 1)
    factorial = np.cumsum(np.log(np.maximum(1, np.arange(n + 1))))
    logs = factorial[n] - factorial[k] - factorial[n - k] + k * math.log(p) + (n - k) * math.log1p(-p)
    return float(np.exp(logs).sum())


def bar(sure: np.ndarray, right: np.ndarray) -> float:
    """The lowest score that is calibrated as confident and from which a view was right on enough held-back rows; infinite if there is none.

    Tried are at most TESTS scores, at even places in their order. Where all rows have the label, only CONFIDENT is tested.
    """
    if not len(sure):
        return float("inf")
    order = np.argsort(-sure, kind="stable")
    sure, right = sure[order], right[order]
    ends = np.flatnonzero(np.diff(sure, append=-np.inf) < 0) + 1  # ends of equal scores only
    wanted = np.ceil(np.arange(1, TESTS + 1) * len(sure) / TESTS)
    tried = np.unique(ends[np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)])
    share = right.mean()
    chance = max(CONFIDENT, share) if share < 1 else CONFIDENT
    upto, calibrated = np.cumsum(right), fit_isotonic(sure, right.astype(float))(sure)
    good = [n for n in tried.tolist() if calibrated[n - 1] >= CONFIDENT and _at_least(n, int(upto[n - 1]), chance) <= CHANCE / len(tried)]
    return float(sure[good[-1] - 1]) if good else float("inf")


#: What one view hands to another: who gets it, the label, how sure, and both feature rows.
Hand = tuple[str, int, float, np.ndarray, np.ndarray]
KINDS = [("meta", "text", 1), ("meta", "text", 0), ("text", "meta", 1), ("text", "meta", 0)]  # to, from, label


def surest(model: Model, bars: dict[tuple[str, int], float], most: dict[int, int], x: np.ndarray, m: np.ndarray) -> list[Hand]:
    """The different rows of which each view is most sure, ``most`` for each label."""
    raw, out = model.raw(x, m), []
    for to, view, label in KINDS:
        sure = raw[view] if label else -raw[view]
        at = np.flatnonzero(sure >= bars[view, label])
        rows = np.ascontiguousarray(np.column_stack([x[at], m[at]]))
        _, first = np.unique(rows, axis=0, return_index=True)  # in the order of the features
        at = at[first]
        at = at[np.argsort(-sure[at], kind="stable")][: most[label]]
        out += [(to, label, float(sure[k]), x[k], m[k]) for k in at]
    return out


Pool = Callable[[Model, dict[tuple[str, int], float], dict[int, int]], list[Hand]]


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND, pool: Pool | None = None) -> Model:
    """From features of both views and labels (1, 0, or -1 for unlabelled rows, unless ``pool`` looks them up)."""
    known = np.flatnonzero(y >= 0)
    if not len(known):
        return Model()
    prior = float(y[known].mean())
    check = known[np.arange(len(known)) % 4 == 3]
    train = known[np.arange(len(known)) % 4 != 3]
    judge, check = check[::2], check[1::2]
    if len(set(y[train])) < 2 or len(set(y[check])) < 2:
        return Model(prior)
    if pool is None:
        free = np.flatnonzero(y < 0)
        pool = lambda model, bars, most: surest(model, bars, most, x[free], m[free])
    given = {v: (x[train], m[train], y[train].astype(float)) for v in ("text", "meta")}  # the rows that each view learns from
    model, most, handed = Model(prior), {1: max(1, round(per_round * prior)), 0: max(1, round(per_round * (1 - prior)))}, set()
    for turn in range(rounds + 1):
        model.forest = fit_forest(given["text"][0], given["text"][2], trees=40)
        model.linear = fit_logistic(given["meta"][1], given["meta"][2], ridge=2.0)
        raw = model.raw(x[judge], m[judge])
        bars = {(v, label): bar(raw[v] if label else -raw[v], y[judge] == label) for v in raw for label in (0, 1)}
        if turn == rounds or all(np.isinf(b) for b in bars.values()):
            break
        fresh = []
        for to, label, _, a, b in pool(model, bars, {k: n * (turn + 1) for k, n in most.items()}):  # earlier rows may lead again
            key = (to, a.tobytes(), b.tobytes())
            if key not in handed and sum(f[:2] == (to, label) for f in fresh) < most[label]:
                handed.add(key)
                fresh.append((to, label, a, b))
        for to in given:
            new = [f for f in fresh if f[0] == to]
            if new:
                old = given[to]
                given[to] = (np.vstack([old[0], [f[2] for f in new]]), np.vstack([old[1], [f[3] for f in new]]), np.append(old[2], [f[1] for f in new]))
    raw, half = model.raw(x[check], m[check]), np.arange(len(check)) % 2 == 0
    model.text_map, model.meta_map = (fit_isotonic(raw[v], y[check]) for v in ("text", "meta"))
    seen = {v: np.zeros(len(check)) for v in raw}
    for v, part in ((v, part) for v in raw for part in (half, ~half)):  # each half is mapped by the other
        seen[v][part] = fit_isotonic(raw[v][~part], y[check][~part])(raw[v][part]) if (~part).any() else prior
    model.mix = fit_logistic(np.column_stack([_log_odds(seen["text"]), _log_odds(seen["meta"])]), y[check].astype(float), ridge=0.1)
    return model


PASSED = ["doc_id", "held_out", "draw", "label", "chars", "lang_at", "source_at"]
FEATURES = "doc_id long, held_out boolean, draw long, label int, chars double, lang_at int, source_at int, x array<float>"


def _text_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            x = pa.array([text_features(t.as_py()) for t in part.column("text")], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in PASSED), x], names=[*PASSED, "x"])


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The narrow table of both views' inputs: whole texts are read once, and only the ids meet the labels."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    bucket = lambda c, n: (F.crc32(F.coalesce(c, F.lit("\0"))) % n).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.xxhash64(F.lit(3), "doc_id").alias("draw"), F.lit(None).cast("int").alias("label"),
        F.col("n_chars").cast("double").alias("chars"), bucket("lang", LANG_BUCKETS).alias("lang_at"), bucket("source", SOURCE_BUCKETS).alias("source_at"), "text",
    )
    made = rows.mapInArrow(_text_columns, FEATURES).drop("label").join(known, "doc_id", "left")
    return materialize(made.select(*PASSED, "x"), "quality")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    chars, lang_at, source_at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chars", "lang_at", "source_at"))
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, TEXT_FEATURES)
    return x, meta_matrix(chars.astype(float), lang_at.astype(np.int64), source_at.astype(np.int64))


def _pool(rows: DataFrame) -> Pool:
    """Looks all unlabelled rows up on the executors; a bounded number of rows comes back."""
    context = rows.sparkSession.sparkContext

    def look_up(model: Model, bars: dict[tuple[str, int], float], most: dict[int, int]) -> list[Hand]:
        shared = context.broadcast((model, bars, most))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, m, found = np.zeros((0, TEXT_FEATURES), np.float32), np.zeros((0, META_FEATURES)), []
            for batch in batches:
                more_x, more_m = _views(batch)
                found = surest(*shared.value, np.vstack([x, more_x]), np.vstack([m, more_m]))
                if found:  # a task carries only its best rows on
                    x, m = np.stack([h[3] for h in found]), np.stack([h[4] for h in found])
            columns = [[h[k] for h in found] for k in range(5)]
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["to", "label", "sure", "x", "m"])

        found = rows.mapInArrow(run, "to string, label int, sure double, x array<float>, m array<double>").distinct()
        rank = F.row_number().over(Window.partitionBy("to", "label").orderBy(F.desc("sure"), "x", "m"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0])).where(F.col("rank") <= max(most.values())).collect()
        best.sort(key=lambda r: (KINDS.index(next(k for k in KINDS if (k[0], k[2]) == (r["to"], r["label"]))), r["rank"]))
        shared.unpersist()
        return [(r["to"], r["label"], r["sure"], np.array(r["x"], np.float32), np.array(r["m"])) for r in best]

    return look_up


def learn(rows: DataFrame, max_labelled: int = 8000, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model:
    """From the table of ``features``; rows that are held out take no part."""
    rows = rows.where(~F.col("held_out"))
    known, unknown = rows.where(F.col("label").isNotNull()), rows.where(F.col("label").isNull())
    share = min(1.0, max_labelled / max(1, known.count()))
    drawn = known.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < share).select(*PASSED[2:], "x").distinct().toArrow()
    batch = drawn.sort_by([("draw", "ascending"), ("label", "ascending"), ("chars", "ascending"), ("lang_at", "ascending"), ("source_at", "ascending")]).combine_chunks()
    if not batch.num_rows:
        return Model()
    return co_train(*_views(batch.to_batches()[0]), batch.column("label").to_numpy().astype(np.int64), rounds, per_round, _pool(unknown))


SCHEMA = "doc_id long, held_out boolean, p_text double, p_meta double, score double"


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> DataFrame:
    """doc_id, held_out, the calibrated views p_text and p_meta, score and predicted of every document."""
    rows = features(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(learn(rows, max_labelled, rounds, per_round))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.score(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(p, pa.float64()) for p in scores)], names=["doc_id", "held_out", "p_text", "p_meta", "score"])

    return rows.mapInArrow(run, SCHEMA).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
