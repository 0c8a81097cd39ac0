"""Benchmark decontamination: a generalised suffix automaton of the items' words, streamed over the documents' words.

The automaton holds every word sequence that occurs in an item. While a document's words pass, it tracks the longest
suffix that occurs in some item; wherever that suffix covers a window (WINDOW consecutive words of an item, or a shorter
item as a whole), the window's words are hit. Words that no item has reset the automaton, so that only runs of known
words are walked. Items are dealt into automata of at most MAX_WORDS words each (the bound on what is broadcast). A
larger benchmark costs a reading of the texts for each automaton, one after the other: each writes only what it finds, by
a key of the text, and one join brings the finds to the rows, so memory does not grow with the benchmark.

Defined results: null or wordless text has no words, no hits and is not contaminated; items without words are left out;
a null item_id counts as the empty text; repeated rows each get their own result row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.llm.common import SEPARATORS, binary, cut, slices

WINDOW = 10
#: Words of items in one automaton; about 400 bytes a word on each worker.
MAX_WORDS = 500_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least = min([window, *(len(words) for _, words in items if words)])
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        own: dict[int, dict[int, set[str]]] = {}
        for item, words in coded:
            size, state, matched = min(window, len(words)), 0, 0
            for word in words:
                state, matched = self.step(state, matched, word)
                at = state
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                if matched >= size:
                    own.setdefault(at, {}).setdefault(size, set()).add(item)
        #: By state: (window's words, items) of every window that is a suffix of the state's sequences.
        self.out: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            mine = tuple((size, frozenset(ids)) for size, ids in sorted(own.get(state, {}).items()))
            self.out[state] = self.out[self.link[state]] + mine

    def _split(self, state: int, word: int, target: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        following = self.next[state].get(word)
        return (0, 0) if following is None else (following, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that have a window here."""
        hit, found = np.zeros(len(words) + 1, np.int64), set()
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).astype(np.int8), [0]))))
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if high - low < self.least:
                continue
            state = matched = 0
            for at, word in enumerate(codes[low:high].tolist(), low + 1):
                state, matched = self.step(state, matched, word)
                longest = 0
                for size, items in self.out[state]:
                    if size <= matched:
                        longest = max(longest, size)
                        found |= items
                if longest:
                    hit[at - longest] += 1
                    hit[at] -= 1
        return np.cumsum(hit[:-1]) > 0, found


def shards(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, a bounded number of words at a time."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        words = WORD.findall(row["text"].encode().lower())
        if held and size + len(words) > max_words:
            yield held
            held, size = [], 0
        held.append((row["item"], words))
        size += len(words)
    if held:
        yield held


_spans = "array<struct<start:long,end:long>>"
_kinds = (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.int64())


def _found(batch: pa.RecordBatch, at: int, automaton: Automaton | None) -> tuple[list, list, list]:
    """(spans, items, words) of each row of a batch whose last three columns hold finds made before."""
    before = batch.num_columns - 3
    spans, items, n_words = [], [], []
    for raw, old_spans, old_items in zip(binary(batch.column(at)), batch.column(before).to_pylist(), batch.column(before + 1).to_pylist(), strict=True):
        words = WORD.findall(raw.lower())
        hit, found = automaton.scan(words) if automaton else (np.zeros(len(words), bool), set())
        for span in old_spans:
            hit[span["start"] : span["end"]] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
        spans.append([{"start": low, "end": high} for low, high in zip(edges[::2], edges[1::2], strict=True)])
        items.append(sorted(found.union(old_items)))
        n_words.append(len(words))
    return spans, items, n_words


def _no_finds() -> dict[str, Column]:
    return {"hit_spans": F.expr(f"cast(array() as {_spans})"), "hit_items": F.expr("cast(array() as array<string>)"), "hit_words": F.lit(0).cast("long")}


def _finds(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """(hit_spans, hit_words, hit_items): key, spans and items of each different text in which this automaton finds windows.

    docs: hit_spans (the key), text. Only finds are written; then the automaton is given up on every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, spans, items = [], [], []
            for k, raw in enumerate(binary(batch.column(1))):
                hit, found = shared.value.scan(WORD.findall(raw.lower()))
                if found:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
                    keys.append(k)
                    spans.append([{"start": low, "end": high} for low, high in zip(edges[::2], edges[1::2], strict=True)])
                    items.append(sorted(found))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(spans, _kinds[0]), pa.array(items, _kinds[1])], names=["hit_spans", "hit_words", "hit_items"])

    schema = f"hit_spans struct<h:bigint,g:bigint>, hit_words {_spans}, hit_items array<string>"
    found = docs.mapInArrow(each, schema).groupBy("hit_spans").agg(F.first("hit_words").alias("hit_words"), F.first("hit_items").alias("hit_items"))
    out = cut(found)
    shared.destroy()
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, window: int, max_words: int, last=None, schema: T.StructType | None = None) -> DataFrame | None:
    """Each row's finds, handed to `last` in the same pass; None without items.

    A benchmark of one automaton takes one map-only pass. Of a larger one each automaton has a pass that writes its finds
    by a 128-bit key of the text, and one join brings all finds to the rows; one automaton is alive at a time.
    """
    waiting = shards(benchmark, max_words)
    items, following = next(waiting, None), next(waiting, None)
    if items is None:
        return None
    automaton = None
    if following is None:
        out, automaton = docs.withColumns(_no_finds()), docs.sparkSession.sparkContext.broadcast(Automaton(items, window))
    else:
        whole = F.coalesce(F.col(text), F.lit(""))
        keyed = docs.withColumn("hit_spans", F.struct(F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(9), whole).alias("g")))
        read = keyed.select("hit_spans", F.col(text))
        finds = _finds(read, Automaton(items, window))
        while following is not None:
            items, following = following, next(waiting, None)
            finds = finds.union(_finds(read, Automaton(items, window)))
        # A list for each automaton at most, so a text's row is bounded by their number.
        merged = finds.groupBy("hit_spans").agg(F.flatten(F.collect_list("hit_words")).alias("hit_words"), F.flatten(F.collect_list("hit_items")).alias("hit_items"))
        joined = keyed.join(merged, "hit_spans", "left").drop("hit_spans").withColumnRenamed("hit_words", "hit_spans")
        out = joined.withColumns({name: value if name == "hit_words" else F.coalesce(F.col(name), value) for name, value in _no_finds().items()})
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            finds = _found(batch, at, automaton and automaton.value)
            if last is not None:
                yield last(batch, *finds)
            else:
                arrays = [*batch.columns[:-3], *(pa.array(x, kind) for x, kind in zip(finds, _kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return out.mapInArrow(each, out.schema if last is None else schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Adds hit_spans (word spans [start, end)), hit_items (sorted) and hit_words (all words) to each row.

    The documents must not have columns of these names; `report` and `remove` take any.
    """
    if clash := {"hit_spans", "hit_items", "hit_words"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns that the scan would overwrite: {sorted(clash)}")
    found = _passes(docs, benchmark, text, window, max_words)
    if found is not None:
        return found
    n = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")).cast("long")
    return docs.withColumns(_no_finds() | {"hit_words": n})


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document with the counts of hit words and items."""
    found = scan(docs.select("doc_id", "text"), benchmark, window=window, max_words=max_words)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return found.select("doc_id", F.col("hit_words").alias("n_words"), hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without their hit spans; one of whose words more than max_coverage are hit goes as a whole.

    Clean documents keep their text byte for byte; n_chars, where there is one, is counted anew for changed texts.
    """
    at, columns = docs.columns.index("text"), docs.columns
    # Numbered names: whatever the columns are called, none clashes with those that the scan adds.
    numbered = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    chars = columns.index("n_chars") if "n_chars" in columns else -1
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def cleaned(batch: pa.RecordBatch, spans: list, items: list, total: list) -> pa.RecordBatch:
        kept = [k for k, x in enumerate(spans) if sum(s["end"] - s["start"] for s in x) <= max_coverage * max(total[k], 1)]
        if len(kept) < batch.num_rows:
            batch = batch.take(pa.array(kept, pa.int64()))
        arrays = batch.columns[: len(columns)]
        if any(spans[k] for k in kept):
            texts, sizes = arrays[at].to_pylist(), arrays[chars].to_pylist() if chars >= 0 else []
            for row, k in enumerate(kept):
                if spans[k]:
                    texts[row] = without(texts[row], spans[k])
                    if chars >= 0:
                        sizes[row] = len(texts[row])
            arrays[at] = pa.array(texts, arrays[at].type)
            if chars >= 0:
                arrays[chars] = pa.array(sizes, arrays[chars].type)
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    found = _passes(numbered, benchmark, f"c{at}", window, max_words, cleaned, schema)
    return docs if found is None else found


def without(text: str, spans: list[dict[str, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    pieces, last = [], 0
    for s in spans:
        pieces.append(raw[last : places[s["start"]][0]])
        last = places[s["end"] - 1][1]
    return b"".join([*pieces, raw[last:]]).decode()
