"""op7 against features, lexicon, splits and calibration written out plainly."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixloom.llm import boosting, toxicity


def plain_features(text, learned):
    if not text:
        return [0.0] * len(toxicity.FEATURES)
    words = re.findall(r"\w+", text.lower())
    n = max(1, len(words))
    share = lambda w: max([learned.get(w, 0.0)] + [learned.get(w[:k] + "*", 0.0) for k in (4, 5, 6, 7) if k < len(w)])
    fixed = [w in toxicity.LEXICON for w in words]
    strong = [share(w) >= 0.8 for w in words]
    weak = [0.5 <= share(w) < 0.8 for w in words]
    you = [k for k, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(k - y) <= 5 for y in you) for k in range(len(words)) if fixed[k] or strong[k])
    odd = re.findall(r"(?<!\S)(?:[A-Za-z0-9_]*[A-Za-z][0-9@$*!.\-_]+[A-Za-z][A-Za-z0-9_]*)", text)
    upper = sum(c.isupper() for c in text)
    swap = {**dict(zip("013457@$", "oieastas", strict=True)), **dict.fromkeys("*.-_!", "")}
    leet = sum("".join(swap.get(c, c) for c in w.lower()) in toxicity.LEXICON for w in odd)
    runs = len(list(re.finditer(r"(.)\1\1\1+", text)))
    return [
        sum(fixed), sum(fixed) / n, sum(strong), sum(strong) / n, sum(weak), sum(weak) / n, near, near / n, len(you) / n, upper / len(text),
        len([w for w in text.split() if w.isupper() and len(w) > 1]) / n if upper > 0.1 * len(text) else 0.0, text.count("!") / len(text), text.count("?") / len(text),
        len([c for c in text if c in "!?*$#%&@"]) / len(text), len([c for c in text if c in "0123456789"]) / len(text), len(odd) / n, leet, runs / n, np.log(1 + len(words)),
        sum(len(w) for w in words) / n, len(set(words)) / n,
    ]


def plain_lexicon(rows):
    grams = [(toxic, {g for w in set(re.findall(r"\w+", (t or "").lower())) for g in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if k < len(w))]}) for t, toxic in rows]
    counts = {}
    for toxic, found in grams:
        for g in found:
            counts.setdefault(g, [0, 0])[toxic] += 1
    return {g: t / (t + o) for g, (o, t) in counts.items() if t >= 5 and t / (t + o) >= 0.5}


def made(n=1500):
    rng = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(200)] + ["you", "Your", "NO!!!!", "sh1t", "i.d.i.o.t", "4242"]
    rows = []
    for k in range(n):
        toxic = int(rng.random() < 0.2)
        words = list(rng.choice(plain, int(rng.integers(1, 40))))
        if toxic and rng.random() < 0.9:
            words.insert(int(rng.integers(len(words) + 1)), rng.choice(["zorbling", "zorbles", "idiot", "TRASH", "quibbed"]))
        rows.append((k, None if k % 101 == 0 else "" if k % 103 == 0 else " ".join(words), toxic))
    return [*rows, rows[5], rows[5]]


def test_features_equal_plain_features():
    learned = {"zorb*": 0.95, "word1": 0.6, "quibbed": 0.8, "word19*": 0.79}
    rng = np.random.default_rng(8)
    texts = [t for _, t, _ in made(300)] + ["".join(rng.choice(list("aaYOUyou idiot!?.@$*01é_\n"), 80)) for _ in range(300)] + ["A" * 50, "!!!! ????", "you zorbling you zorbling a b c d e f zorbling"]
    make = toxicity.Features(learned)
    for t in texts:
        assert np.allclose(make.of(t), plain_features(t, learned), atol=1e-12), t


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (200, 4)).astype(np.float32)
    y = ((x[:, 2] > 4) ^ (rng.random(200) < 0.1)).astype(int)
    forest = boosting.fit_forest(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda part: g[part].sum() ** 2 / (h[part].sum() + 2.0)
    best = max(((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(4) for c in range(8)), key=lambda b: b[0])
    assert int(forest.feature[0][0]) == best[1] and np.array_equal(x[:, best[1]] > forest.cut[0][0], x[:, best[1]] > best[2])
    for side, leaf in ((x[:, best[1]] <= best[2], 0), (x[:, best[1]] > best[2], 1)):
        assert np.isclose(forest.leaf[0][leaf], -0.15 * g[side].sum() / (h[side].sum() + 2.0))


def test_isotonic_is_the_least_greatest_mean():
    rng = np.random.default_rng(5)
    z, y = rng.permutation(60).astype(float), rng.integers(0, 2, 60).astype(float)
    order = np.argsort(z)
    ys = y[order]
    mean = lambda a, b: ys[a : b + 1].mean()
    plain = [max(min(mean(j, k) for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    assert np.allclose(boosting.fit_isotonic(z, y)(z[order]), plain)


def test_scores_equal_those_of_plain_features_and_lexicon(spark):
    rows = made()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(sorted({(k, x) for k, _, x in rows if k % 5}), "doc_id long, toxic int")
    label = {k: x for k, _, x in rows if k % 5}
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(10)).alias("p")).collect()}
    usable = [(k, t, label[k]) for k, t, _ in rows if k in label and zlib.crc32(str(k).encode()) % 4 != 2]
    learned = plain_lexicon([(t, x) for k, t, x in usable if part[k] < 4])
    assert learned and toxicity.learned_lexicon(spark.createDataFrame([(x, t) for k, t, x in usable if part[k] < 4], "toxic int, text string")) == learned
    fold = sorted(((part[k], x, np.array(plain_features(t, learned), np.float32)) for k, t, x in usable if part[k] >= 4), key=lambda r: (r[0], r[1], r[2].tolist()))
    x, y, f = np.stack([r[2] for r in fold]), np.array([r[1] for r in fold]), np.array([r[0] for r in fold])
    forest = boosting.fit_forest(x[f < 8], y[f < 8])
    calibration = boosting.fit_isotonic(forest(x[f >= 8]), y[f >= 8])
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    plain = np.clip(calibration(forest(np.array([plain_features(t, learned) for _, t, _ in rows], np.float32))), 0, 1)
    for (k, _, _), score in zip(rows, plain, strict=True):
        assert abs(found[k].score - score) < 1e-9 and found[k].predicted == int(score >= 0.3)
