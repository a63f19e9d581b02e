"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins; shallow trees are boosted feature by feature in a cycle,
then on the pairs of features that explain most of what is left.  Every tree is folded into lookup
tables, so scoring is a sum of table cells.

The model is fitted on a bounded sample of about ``SAMPLE`` labelled rows, picked by a hash of the id;
its tables have a fixed size.  Scoring reads every text whole and no label.

Cases: a null text is an empty one, and an empty text has a score like any other; without labels, or
with labels of one kind alone, every score is the share of label 1 (0.5 without any); several labels of
one id count as their smallest; null ids and null labels are not learned from.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import base

SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 120, 6, 60, 0.1
#: A score from which a text counts as good.
GOOD = 0.7
FEATURES = ("words", "word_length", "upper", "symbols", "bars", "exclamations", "stops", "digits", "distinct", "repeated_lines", "line_length", "ended_lines", "wide", "commonest", "marked_words", "longest_word")

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_WIDE = bytes(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """The values of :data:`FEATURES` for one text."""
    text = text or b""
    size = max(1, len(text))
    without = lambda chars: len(text) - len(text.translate(None, chars))  # noqa: E731  how many of these bytes
    words = text.split()
    n = max(1, len(words))
    counted = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, wide = without(_UPPER), without(_WIDE)
    letters = max(1, upper + without(_LOWER) + wide)
    return [
        np.log1p(len(words)),
        len(text) / n,
        upper / letters,
        without(_SYMBOL) / size,
        text.count(b"|") / n,
        text.count(b"!") / n,
        without(b".,;:?") / n,
        without(_DIGIT) / size,
        len(counted) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
        sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":") for x in lines) / max(1, len(lines)),
        wide / size,
        max(counted.values(), default=0) / n,
        sum(c for w, c in counted.items() if w[-1:] in _SYMBOL or w[-1:] == b"!") / n,
        np.log1p(max(map(len, counted), default=0)),
    ]


def feature_column(text: Column) -> Column:
    """Array of the features of each text."""
    base.small_batches()

    def run(column: pa.Array) -> pa.Array:
        base.built(("features",), dict)
        return pa.array([features(t) for t in base.texts(column)], pa.list_(pa.float64()))

    return arrow_udf(run, "array<double>")(text)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree over one feature's bins; g, h: sums of gradients and curvatures by bin."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
        gains[(left_h < 1e-3) | (all_h - left_h < 1e-3)] = 0
        at = int(gains.argmax()) + 1
        if gains[at - 1] > 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), all_g / (all_h + 1.0))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of the best tree with one cut on each axis, and its gain over no cut."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    quarters = list(zip(parts(cg), parts(ch), strict=True))
    gains = sum(_gain(a, b) for a, b in quarters)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    leaf = np.empty_like(g)
    for (a, b), where in zip(quarters, ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        leaf[where] = a[i, j] / (b[i, j] + 1.0)
    return leaf, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Model of feature rows ``x`` and labels ``y`` (0 or 1)."""
    prior = float(y.mean()) if len(y) else 0.5
    model = {"id": uuid.uuid4().hex, "prior": prior, "edges": [], "tables": [], "pairs": []}
    if not len(y) or not 0 < prior < 1:
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    tables = [np.zeros(len(e) + 1) for e in edges]
    score = np.full(len(y), np.log(prior / (1 - prior)))

    def slopes():
        p = 1 / (1 + np.exp(-score))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, t in enumerate(tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, len(t)), np.bincount(bins[:, k], h, len(t)), 2)
            t += step
            score += step[bins[:, k]]
    g, h = slopes()
    cells = lambda a, b: bins[:, a] * len(tables[b]) + bins[:, b]
    shape = lambda a, b: (len(tables[a]), len(tables[b]))
    hist = lambda v, a, b: np.bincount(cells(a, b), v, len(tables[a]) * len(tables[b])).reshape(shape(a, b))
    ranked = sorted(((_pair_tree(hist(g, a, b), hist(h, a, b))[1], -a, -b) for a in range(len(tables)) for b in range(a)), reverse=True)
    pairs = [(-a, -b, np.zeros(shape(-a, -b))) for gain, a, b in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in pairs:
            g, h = slopes()
            step = RATE * _pair_tree(hist(g, a, b), hist(h, a, b))[0]
            t += step
            score += step.ravel()[cells(a, b)]
    return model | {"edges": edges, "tables": tables, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each feature row, by adding up table cells."""
    if not model["tables"] or not len(x):
        return np.full(len(x), model["prior"])
    bins = [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(model["edges"])]
    total = np.full(len(x), np.log(model["prior"] / (1 - model["prior"])))
    for b, t in zip(bins, model["tables"], strict=True):
        total += t[b]
    for a, b, t in model["pairs"]:
        total += t[bins[a], bins[b]]
    return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model of the labelled rows of ``docs``; leave out beforehand the labels that must not be learned from."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if share < 1 or picked.count() <= sample:  # at most about `sample` rows of two numbers
        picked = F.broadcast(picked)
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select(feature_column(F.col("text")).alias("x"), "quality").toArrow()
    y = np.array(rows.column("quality").to_pylist(), dtype=float)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, (y == 1).astype(float))


def predict(text: Column, model: dict, spark) -> Column:
    """Score of each text, 0 to 1."""
    base.small_batches()
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        model = base.built(("quality", sent.value["id"]), lambda: sent.value)
        rows = [features(t) for t in base.texts(column)]
        return pa.array(score(model, np.array(rows, dtype=float).reshape(-1, len(FEATURES))), pa.float64())

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, learning from labels whose fold (mod 4) is not 2."""
    model = train(docs, labels.where(~base.held_out(4, 2)))
    scored = docs.select("doc_id", (base.fold(4) == 2).alias("held_out"), predict(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))
