"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the matches.

The lexicon is a trie of terms with weights: the seeds below, and terms learned from the labelled rows of the training
folds (words, and beginnings of words, whose document frequency differs between toxic and other documents). A word of a
text is looked up exactly, by its beginnings, and for misspellings of one edit by running the word's Levenshtein automaton
along the trie: below the node of the word's first letters, and backwards below that of its last letters, because one
edit leaves one half of a term whole.

Each match has a context window of words: inside quotation marks or next to a word of reporting it counts as quotation,
else as abuse. A logistic model over the summed weights of each kind of match gives the score.

Lexicon statistics and the model are fitted on at most FIT_ROWS labelled documents of the training folds; every text is
scored as a whole in one map-only pass with the broadcast lexicon, whose size the fitted rows bound.

Defined results: null text is the empty text; a text without matches gets the model's score for none; with no labelled
toxic row the seeds alone decide; repeated rows each get a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import binary, fold, slices
from isochron.llm.quality import sample

FIT_ROWS, MIN_DOCS = 20_000, 2
#: Terms of abuse known beforehand.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown")
#: Words of reporting that mark a quotation nearby.
REPORTING = frozenset("said says wrote called quote quoted quotes term word words phrase slur insult insulting reported alleged".split())
SEED_WEIGHT, PREFIXES = 2.0, (4, 5, 6)
WINDOW, FUZZY_FROM = 4, 5
WORD = re.compile(r"[^\W_]+")
#: Words whose lookups a worker keeps.
MEMO = 1 << 19


def grown(words: dict[str, float]) -> list:
    """Trie of the words; a node is [children, weight or None]."""
    root: list = [{}, None]
    for word, weight in words.items():
        node = root
        for c in word:
            node = node[0].setdefault(c, [{}, None])
        node[1] = weight
    return root


def within_one(node: list, word: str) -> float | None:
    """Largest weight of a word below the node that is within one edit (insertion, deletion, substitution, swap).

    The states of the Levenshtein automaton of bound one are (place in the word, edits so far); they advance together
    with the trie's branches, so branches that no state survives are never entered.
    """
    best: float | None = None
    size = len(word)
    stack = [(node, 0, 0)]
    seen = set()
    while stack:
        node, at, edits = stack.pop()
        if (id(node), at, edits) in seen:
            continue
        seen.add((id(node), at, edits))
        if node[1] is not None and size - at + edits <= 1 and (best is None or node[1] > best):
            best = node[1]
        children = node[0]
        if at < size and word[at] in children:
            stack.append((children[word[at]], at + 1, edits))
        if edits:
            continue
        if at < size:
            stack.append((node, at + 1, 1))
        for c, child in children.items():
            stack.append((child, at, 1))
            if at < size and c != word[at]:
                stack.append((child, at + 1, 1))
                if at + 1 < size and c == word[at + 1] and word[at] in child[0]:
                    stack.append((child[0][word[at]], at + 2, 1))
    return best


class Trie:
    """The lexicon: a trie for exact words and beginnings, and tries of misspellable terms in both directions.

    One edit leaves the first or the last (length - 1) // 2 letters of a term whole. So a word is looked for below the
    nodes of its own first letters, and, read backwards, below those of its last letters, and nowhere else.
    """

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float], fuzzy: set[str]) -> None:
        self.terms, self.beginnings = terms, beginnings
        self.sizes = sorted({len(t) for t in beginnings})
        near = {t: w for t, w in terms.items() if t in fuzzy}
        self.ways: list[dict[int, dict[str, list]]] = []
        for turn in (slice(None), slice(None, None, -1)):
            heads: dict[int, dict[str, dict[str, float]]] = {}
            for term, weight in near.items():
                k, term = (len(term) - 1) // 2, term[turn]
                heads.setdefault(k, {}).setdefault(term[:k], {})[term[k:]] = weight
            self.ways.append({k: {head: grown(rest) for head, rest in found.items()} for k, found in heads.items()})

    def exact(self, word: str) -> float | None:
        """Weight of the word, or of its longest beginning in the lexicon."""
        found = self.terms.get(word)
        if found is None:
            for k in self.sizes:
                if (weight := self.beginnings.get(word[:k])) is not None:
                    found = weight
        return found

    def near(self, word: str) -> float | None:
        """Largest weight of a term within one edit of the word."""
        best = None
        for way, text in zip(self.ways, (word, word[::-1]), strict=True):
            for k, heads in way.items():
                node = heads.get(text[:k])
                if node is not None:
                    weight = within_one(node, text[k:])
                    if weight is not None and (best is None or weight > best):
                        best = weight
        return best


class Lookup(dict):
    """(exact weight, fuzzy weight) by word, None for neither; for at most MEMO words at a time."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie

    def __missing__(self, word: str) -> tuple[float, float] | None:
        if len(self) >= MEMO:
            self.clear()
        exact = self.trie.exact(word)
        near = self.trie.near(word) if exact is None else None
        self[word] = out = None if exact is None and near is None else (exact or 0.0, near or 0.0)
        return out


QUOTES = "\"“”„«»‹›"
N_FEATURES = 9


def features(text: str, lookup: Lookup) -> list[float]:
    """Summed and largest weights of exact and fuzzy matches in abuse and in quotation, and their rates."""
    text = text.lower()
    words = WORD.findall(text)
    hits = {w for w in set(words) if lookup[w] is not None}
    if not hits:
        return [0.0] * N_FEATURES
    places = list(WORD.finditer(text))
    exact, fuzzy, quoted, largest, largest_fuzzy, kinds = 0.0, 0.0, 0.0, 0.0, 0.0, set()
    for k, m in enumerate(places):
        if m.group() not in hits:
            continue
        weight, near = lookup[m.group()]
        low, high = places[max(0, k - WINDOW)].start(), places[min(len(places) - 1, k + WINDOW)].end()
        before, after = text[low : m.start()], text[m.end() : high]
        inside = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or any(w in REPORTING for w in WORD.findall(before))
        kinds.add(m.group())
        if inside:
            quoted += weight + near
        elif weight:
            exact += weight
            largest = max(largest, weight)
        else:
            fuzzy += near
            largest_fuzzy = max(largest_fuzzy, near)
    n = len(words)
    return [math.log1p(max(exact, 0.0)), largest, math.log1p(max(fuzzy, 0.0)), largest_fuzzy, math.log1p(max(quoted, 0.0)), 10 * exact / (n + 20), 10 * fuzzy / (n + 20), float(exact > 0), math.log1p(len(kinds))]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) to (term, beginning, toxic, other): documents of each class that have the word or beginning."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(binary(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall(text.decode(errors="replace").lower()))
            counts[label > 0].update((w, False) for w in words)
            counts[label > 0].update({(w[:k], True) for w in words for k in PREFIXES if len(w) > k})
    terms = list({**counts[0], **counts[1]})
    for low in range(0, len(terms), 50_000):
        part = terms[low : low + 50_000]
        arrays = [pa.array([t for t, _ in part]), pa.array([b for _, b in part]), *(pa.array([counts[k][t] for t in part], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(arrays, names=["term", "beginning", "toxic", "other"])


class Model:
    """Lexicon and logistic weights."""

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float], fuzzy: set[str]) -> None:
        self.terms, self.beginnings, self.fuzzy = terms, beginnings, fuzzy
        self.mean, self.spread = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        #: Without labelled rows: a match of a seed is toxic, none is not.
        self.weights = np.array([1.0, 1.0, 0.5, 0.5, 0.0, 0.0, 0.0, 2.0, 0.0])
        self.bias = -3.0

    def lookup(self) -> Lookup:
        return Lookup(Trie(self.terms, self.beginnings, self.fuzzy))

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        if not y.any() or y.all():
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * N_FEATURES + [1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        # 0.5 lies where F1 of the fitted rows is best, in the middle of the gap between the rows on either side.
        order = np.argsort(-(z @ w), kind="stable")
        value, hits = (z @ w)[order], np.cumsum(y[order])
        last = np.flatnonzero(np.append(value[1:] < value[:-1], True))
        best = last[np.argmax(2 * hits[last] / (last + 1 + y.sum()))]
        edge = (value[best] + value[min(best + 1, len(value) - 1)]) / 2
        self.weights, self.bias = w[:-1], float(w[-1] - edge)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.spread @ self.weights + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    rows = sample(docs, labels, "toxic", fit_rows)
    totals = {bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    terms, beginnings, fuzzy = dict.fromkeys(SEEDS, SEED_WEIGHT), {}, set(SEEDS)
    #: The same lexicon as a toxic row would see it that had not been counted itself.
    left_terms, left_beginnings = dict(terms), {}
    if n_toxic and n_other:
        counts = rows.mapInArrow(counted, "term string, beginning boolean, toxic long, other long").groupBy("term", "beginning").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        weight = F.log((F.col("toxic") + 0.2) / (n_toxic + 0.4)) - F.log((F.col("other") + 0.2) / (n_other + 0.4))
        strong = counts.filter(F.col("toxic") >= MIN_DOCS).withColumn("weight", weight).filter(F.col("weight") >= 2.0)
        for row in strong.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term", "beginning").collect():  # words of the fitted rows at most
            held = beginnings if row["beginning"] else terms
            held[row["term"]] = row["weight"] * (1 - 1 / (1 + row["toxic"]))
            if row["toxic"] > MIN_DOCS:
                less = row["weight"] + math.log((row["toxic"] - 0.8) / (row["toxic"] + 0.2))
                (left_beginnings if row["beginning"] else left_terms)[row["term"]] = less * (1 - 1 / row["toxic"])
            # A term that many toxic documents share is worth looking for in misspelled form.
            if not row["beginning"] and row["toxic"] >= max(4, 0.005 * n_toxic) and row["other"] <= 0.02 * row["toxic"] and len(row["term"]) >= FUZZY_FROM:
                fuzzy.add(row["term"])
    model = Model(terms, beginnings, fuzzy)

    shared = docs.sparkSession.sparkContext.broadcast((model, Model(left_terms, left_beginnings, fuzzy)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [m.lookup() for m in shared.value]
        for batch in batches:
            x = [features(t.decode(errors="replace"), lookups[label > 0]) for t, label in zip(binary(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    seen = rows.mapInArrow(each, "label int, x array<double>").toArrow()
    x, y = np.array(seen["x"].to_pylist(), float).reshape(-1, N_FEATURES), np.array(seen["label"], float) > 0
    order = np.lexsort([*x.T, y])
    model.train(x[order], y[order].astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a column toxic_score."""
    out = docs.withColumn("toxic_score", F.lit(0.0))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value.lookup()
        for batch in slices(batches):
            x = np.array([features(t.decode(errors="replace"), lookup) for t in binary(batch.column(at))], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(x))], names=batch.schema.names)

    return out.mapInArrow(each, out.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
