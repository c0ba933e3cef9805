"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed into ``DIMENSIONS``: words (1 and 2) and shapes of words (1 to 3; a shape is
the case, the digits and the closing marks of a word, or that it repeats the word before). An indicator's value is its
class log-count ratio r = log(p / |p| : q / |q|), with p and q the smoothed numbers of rows of each class that hold it. A
linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent, mixed with the Naive Bayes
weights, and its margins are mapped to probabilities by a logistic curve fitted on rows kept out of the descent.

The fit uses a bounded sample of the labelled rows, ``SAMPLE_PER_CLASS`` of each class, first in order of a hash of the
id; the sample's ids are broadcast, so texts are not shuffled. The classes' shares are counted over all labelled rows.
Every text is scored whole.

Defined cases: null and empty texts have no n-grams and get the score of the model's bias. Labels other than 0 and 1 and
null ids are left out of training; an id with several labels counts once, as 1 if any is, and one with several rows is
learned from one of them, the first in order of a hash of the text. Without labelled rows of both
classes the score is the smoothed share of class 1 (0.5 where there are none). Repeated rows are scored alike. Only id
and text are read when scoring.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_rows

DIMENSIONS = 1 << 18
SAMPLE_PER_CLASS = 3000
EPOCHS, COST, NAIVE_SHARE, SMOOTHING = 10, 1.0, 0.25, 1.0
CACHE_WORDS = 400_000
REPEAT = 1


@lru_cache(maxsize=1)
def features_here() -> Features:
    """One extractor a worker: its cache serves all its tasks."""
    return Features()


def shape_of(word: str) -> int:
    """A number (over 1, below 2^16) for the case, digits and closing marks of a word."""
    body = word.rstrip("".join({c for c in word if not c.isalnum()})) if not word.isalnum() else word
    case = 0 if not body else 1 if body.islower() else 2 if body.isupper() and len(body) > 1 else 3 if body[:1].isupper() and body[1:].islower() or len(body) == 1 else 4
    marks = word[len(body) :][:3]
    digits = any(c.isdigit() for c in body)
    return 2 + zlib.crc32(f"{case}{digits:d}{marks}".encode()) % 65_534


class Features:
    """Hashed n-gram indicators of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32)
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = set(words)
        known.update((word, shape_of(word) << 32 | zlib.crc32(word.encode())) for word in fresh)
        both = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > CACHE_WORDS:
            known.clear()
        names = both & np.uint64(0xFFFFFFFF)
        shapes = both >> np.uint64(32)
        shapes[1:][names[1:] == names[:-1]] = REPEAT
        grams = [_mix(names, 1), _mix(shapes, 2)]
        if len(words) > 1:
            grams += [_mix(names[:-1] * np.uint64(1_000_003) + names[1:], 3), _mix(shapes[:-1] << np.uint64(16) | shapes[1:], 4)]
        if len(words) > 2:
            grams.append(_mix(shapes[:-2] << np.uint64(32) | shapes[1:-1] << np.uint64(16) | shapes[2:], 5))
        return np.unique(np.concatenate(grams)).astype(np.int32)


def _mix(values: np.ndarray, kind: int) -> np.ndarray:
    mixed = (values + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)


class Model:
    """weights over hashed n-grams, bias, and the logistic map of margins; a constant score where untrained."""

    def __init__(self, weights: np.ndarray | None, ratios: np.ndarray | None, bias: float, slope: float, offset: float, constant: float):
        self.weights, self.ratios, self.bias, self.slope, self.offset, self.constant = weights, ratios, bias, slope, offset, constant

    def margin(self, features: np.ndarray) -> float:
        scaled = self.ratios[features]
        norm = float(np.sqrt(scaled @ scaled)) or 1.0
        return float(self.weights[features] @ scaled) / norm + self.bias

    def score(self, features: np.ndarray) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -35, 35))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: (weights, bias), the bias as a constant feature 1."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(rows))
    squares = np.array([v @ v for v in values]) + 1
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, value, sign = rows[i], values[i], signs[i]
            gradient = sign * (weights[at] @ value + bias) - 1
            fresh = min(max(alpha[i] - gradient / squares[i], 0.0), costs[i])
            if fresh != alpha[i]:
                step = (fresh - alpha[i]) * sign
                weights[at] += step * value
                bias += step
                alpha[i] = fresh
    return weights, bias


def logistic(margins: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to class 1, by Newton's method, rows weighted by shares."""
    a, b = 1.0, 0.0
    counts = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (counts[1] + 1) / (counts[1] + 2), 1 / (counts[0] + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        miss, curve = shares * (p - target), shares * p * (1 - p) + 1e-9
        gradient = np.array([miss @ margins, miss.sum()]) + np.array([1e-3 * a, 0])
        inner = np.array([[(curve * margins) @ margins + 1e-3, curve @ margins], [curve @ margins, curve.sum()]])
        step = np.linalg.solve(inner, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, totals: tuple[int, int]) -> Model:
    """totals: rows of class 0 and 1 among all that are labelled."""
    constant = (totals[1] + 1) / (sum(totals) + 2)
    counts = np.bincount(labels, minlength=2)
    if counts.min() < 2:
        return Model(None, None, 0, 0, 0, constant)
    holds = [np.full(DIMENSIONS, SMOOTHING), np.full(DIMENSIONS, SMOOTHING)]
    for at, label in zip(rows, labels, strict=True):
        holds[label][at] += 1
    ratios = np.log(holds[1] / holds[1].sum()) - np.log(holds[0] / holds[0].sum())
    values = [ratios[at] for at in rows]
    values = [v / (np.sqrt(v @ v) or 1) for v in values]
    signs = np.where(labels == 1, 1.0, -1.0)
    costs = np.where(labels == 1, COST * len(labels) / (2 * counts[1]), COST * len(labels) / (2 * counts[0]))
    order = np.random.default_rng(1).permutation(len(rows))
    kept, out = order[len(order) // 5 :], order[: len(order) // 5]
    if np.bincount(labels[kept], minlength=2).min() < 1 or np.bincount(labels[out], minlength=2).min() < 1:
        kept = out = order
    pick = lambda where, xs: [xs[i] for i in where]
    weights, bias = descend(pick(kept, rows), pick(kept, values), signs[kept], costs[kept])
    weights = mixed_weights(weights, holds[0] + holds[1] > 2 * SMOOTHING)
    margins = np.array([weights[rows[i]] @ values[i] + bias for i in out])
    shares = np.where(labels[out] == 1, totals[1] / counts[1], totals[0] / counts[0])
    slope, offset = logistic(margins, labels[out], shares / shares.mean())
    return Model(weights.astype(np.float32), ratios.astype(np.float32), bias, slope, offset, constant)


def mixed_weights(weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Interpolates between the mean size of the weights, which is Naive Bayes on scaled indicators, and the weights, for
    all n-grams seen in training, in a support vector or not."""
    mean = np.abs(weights[seen]).mean() if seen.any() else 0.0
    return np.where(seen, (1 - NAIVE_SHARE) * weights + NAIVE_SHARE * mean, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits the model to the labelled rows of docs."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("key")).agg(F.max(label_column).cast("int").alias("label"))
    totals = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    order = ("xxhash64(key)", "key")
    picked = [known.where(F.col("label") == c).orderBy(F.expr(order[0]), order[1]).limit(per_class) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).join(sample, "key").select("key", "label", F.xxhash64("text").alias("place"), "text")

    def extract(source):
        features = features_here()
        for key, label, place, text in source:
            yield key, label, place, features(text).tolist()

    kind = docs.schema[id_column].dataType.simpleString()
    found = map_rows(rows, extract, f"key {kind}, label int, place bigint, features array<int>", flush=100)
    found = found.groupBy("key", "label").agg(F.min(F.struct("place", "features"))["features"].alias("features")).toArrow()  # one row an id
    order = np.argsort(found["key"].to_numpy(), kind="stable")
    lists = found["features"].combine_chunks() if found.num_rows else []
    features = [lists[int(i)].values.to_numpy() for i in order]
    return fit(features, found["label"].to_numpy()[order].astype(np.int64), (totals.get(0, 0), totals.get(1, 0)))


def score_rows(model: Model, source):
    """(other columns..., score) for rows whose last column is the text."""
    features = features_here()
    for row in source:
        yield *row[:-1], model.score(features(row[-1]))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs.select(id_column, text_column), lambda source: score_rows(shared.value, source), f"{id_column} {kind}, score double")
