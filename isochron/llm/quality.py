"""Quality classifier: Bradley-Terry pairwise ranking of documents.

From labelled documents, pairs (better, worse) are drawn; the score of a document is a linear function of its features,
and P(better beats worse) = logistic(score difference), so that the weights minimise the logistic loss on feature
differences (Newton steps with a ridge). Scores become probabilities by a quantile: the score below which the labelled
documents' share of bad ones lies maps to THRESHOLD.

Features are read from whole texts in one map-only pass: shares of letters, capitals, digits, symbols and other bytes,
repeated words and lines, words without letters, words that end in symbols, and lengths. The model is fitted on at most
FIT_ROWS labelled documents (by keyed hash of the id) and PAIRS pairs, both bounds independent of the input; everything
else covers all rows.

Defined results: null text is the empty text and gets a score like any other; where the labelled rows lack one of the
classes, every document scores 0.5; labels that are null or contradict each other are left out; repeated rows each get
a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import binary, fold, slices

FIT_ROWS, PAIRS, THRESHOLD = 20_000, 100_000, 0.3
SCALE = 0.25

_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True
_marks = np.zeros(256, bool)
_marks[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?!"]] = True
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def features(text: bytes) -> list[float]:
    """Features of a whole text."""
    size = len(text)
    if not size:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    high = int(counts[128:].sum())
    letters, marks, space = int(counts[_letters].sum()), int(counts[_marks].sum()), int(counts[_space].sum())
    capitals, digits, stops = int(counts[65:91].sum()), int(counts[48:58].sum()), int(counts[[33, 46, 63]].sum())
    shown = max(size - space, 1)
    words = text.split()
    n = max(len(words), 1)
    folded = [w.strip(b".,;:!?") for w in words]
    distinct = len(set(folded))
    again = sum(map(eq, folded, folded[1:]))
    pairs = len(set(zip(folded, folded[1:], strict=False))) if n > 1 else 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    bare = sum(not w.isalnum() and not any(_letters[b] or b > 127 for b in w) for w in set(words) if len(w) <= 4)
    pipes = words.count(b"|")
    ends = sum(w[-1] in b"&%$#*~^=@_<>|+" for w in words)
    shouts = text.count(b"!!")
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    longest = max(map(len, words), default=0)
    expected = n ** 0.5
    return [
        marks / shown, capitals / max(letters, 1), digits / shown, high / shown, stops / n, (letters + high) / size,
        pipes / n, ends / n, shouts / n, upper / n, again / n, 1 - pairs / max(n - 1, 1), distinct / n, distinct / (n + expected),
        1 - len(set(lines)) / n_lines, shown / n / 10, np.log1p(n) / 10, np.log1p(n / n_lines) / 10, bare / 10, np.log1p(longest) / 10,
        min(1.0, 5 * pipes / n), min(1.0, 5 * ends / n), min(1.0, 5 * shouts / n), min(1.0, 5 * again / n), min(1.0, 3 * upper / n), float(n < 8),
        max(0.0, 1 - pairs / max(n - 1, 1) - 0.3), float(marks > 0),
    ]


N_FEATURES = 28


def _rows(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches):
        yield batch, np.array([features(x) for x in binary(batch.column(at))], float).reshape(-1, N_FEATURES)


class Ranking:
    """score = logistic((features . weights - cut) / scale + logit(threshold))."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, threshold: float = THRESHOLD, seed: int = 7) -> None:
        self.usable = bool(good.any() and not good.all())
        if not self.usable:
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self.standard(x)
        random = np.random.default_rng(seed)
        better, worse = np.flatnonzero(good), np.flatnonzero(~good)
        count = int(min(pairs, max(5_000, len(better) * len(worse))))
        difference = z[random.choice(better, count)] - z[random.choice(worse, count)]
        w = np.zeros(z.shape[1])
        ridge = 1e-3 * count * np.eye(len(w))
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
            step = np.linalg.solve((difference * (p * (1 - p))[:, None]).T @ difference + ridge, difference.T @ p - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        utility = np.sort(z @ w)
        k = int((~good).sum())
        self.cut = float((utility[k - 1] + utility[min(k, len(utility) - 1)]) / 2)
        self.scale = float(max(np.std(utility), 1e-9) * SCALE)
        self.offset = float(np.log(threshold / (1 - threshold)))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self.standard(x) @ self.weights - self.cut) / self.scale + self.offset, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most fit_rows labelled documents outside the held-out fold, the same ones on each run.

    The ids are chosen before the texts are touched: of labels only, by keyed hash, with a hash threshold that leaves
    about fit_rows; so the texts join a bounded set of ids. An id whose labels contradict each other is left out; of
    several rows with one id, the smallest text counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"), F.max(F.col(label).cast("int")).alias("other"))
    known = known.filter("label = other").select("doc_id", "label")
    total = known.count()
    if total > fit_rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 11) < int((1 << 53) * fit_rows / total)).limit(2 * fit_rows)
    known = F.broadcast(known)  # 2 * fit_rows rows of two numbers at most
    return docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranking:
    schema = "label int, x array<double>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, 0):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample(docs, labels, "quality", fit_rows).mapInArrow(each, schema).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, np.array(rows["label"], float)])  # rows arrive in any order
    return Ranking(x[order], np.array(rows["label"], float)[order] > 0)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """The documents with a column quality_score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    out = docs.withColumn("quality_score", F.lit(0.0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(x))], names=batch.schema.names)

    return out.mapInArrow(each, out.schema)


def keep(docs: DataFrame, model: Ranking, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, at):
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(each, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
