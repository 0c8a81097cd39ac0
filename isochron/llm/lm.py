"""LM scoring: a bigram model in an Elias-Fano trie.

Level 1 holds the words: their sorted 64-bit hashes as Elias-Fano sequences, dealt into shards by leading bits, with
counts; a word's number is its rank. Level 2 holds the bigrams, dealt into shards by context: per shard the contexts
(Elias-Fano), monotone pointers to their ranges (Elias-Fano), and the successors' word numbers, made monotone by adding
to each context's words the last value of the range before (Elias-Fano), so that a lookup is a successor search relative
to its context; discounted probabilities and backoff weights are quantised to 256 values a shard. A context with many
tokens (heavy) has its successors dealt over all shards, so no shard grows with a hot word; its number of successors is
summed over them, so that the probabilities are the same whatever the number of shards.

Probabilities are interpolated absolute discounting over the base unigram model:
    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    p(w | h) = max(c(h w) - D, 0) / c(h) + D * n(h) / c(h) * p(w),  n(h) distinct successors of h
and p(w) alone after an unseen h. The trie has the first term of each bigram and the weight of p(w) of each context.
Every token of every training text is counted, nothing is pruned.

The shards are files of the shared folder, written whole under another name and then renamed (a task that runs again
writes the same), and memory-mapped where they are read; folders that are no local path are read through pyarrow's file
systems, a shard at a time. Documents are never shuffled: counts leave the map side as sorted, compressed blocks.

Defined results: null text is the empty text, with one token, its end; repeated rows each count; a null doc_id counts as
an empty text in the choice of training rows; without training texts every token has p = 1.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import binary, checkpoint_dir, cut, fold, runs

#: Words of a shard of level 1, bigram tokens of a shard of level 2, on average; bytes of text worked on at a time.
WORDS, TOKENS, BYTES = 1_000_000, 4_000_000, 4_000_000
DISCOUNT, LEVELS = 0.75, 256
#: Files that a worker keeps open: maps, which cost no memory of their own, and copies of what can't be mapped.
OPEN_MAPS, OPEN_COPIES = 256, 8
#: The end of a text as a word: no word has a space.
END = xxhash.xxh3_64_intdigest(b" end")


class EliasFano:
    """Non-decreasing numbers: upper halves in unary with rank directory, lower halves in whole bytes."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.n, self.bits = int(parts["meta"][0]), int(parts["meta"][1])
        self.tops = int(parts["meta"][2])

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = 0
        while last >> bits > 4 * max(n, 1):
            bits += 8
        top = (values >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(n, np.int64)
        tops = (last >> bits) + 1
        words = (n + tops) // 64 + 1
        flags = np.zeros(words * 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))[:-1].astype(np.uint32)
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : bits // 8]) if n else np.empty((0, bits // 8), np.uint8)
        return {"low": low, "high": high, "ones": ones, "meta": np.array([n, bits, tops], np.int64)}

    def _within(self, words: np.ndarray, nth: np.ndarray) -> np.ndarray:
        place = np.zeros(len(words), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
            go = nth >= below
            place += go * width
            nth = nth - go * below
            words = np.where(go, words >> np.uint64(width), words)
        return place

    def select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k.astype(np.uint32), "right") - 1
        return word * 64 + self._within(self.high[word], k - self.ones[word].astype(np.int64))

    def select0(self, k: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(zeros, k, "right") - 1
        return word * 64 + self._within(~self.high[word], k - zeros[word])

    def _lower(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.uint64)
        for at in range(self.bits // 8):
            out |= self.low[k, at].astype(np.uint64) << np.uint64(8 * at)
        return out

    def get(self, k: np.ndarray) -> np.ndarray:
        return ((self.select1(k) - k).astype(np.uint64) << np.uint64(self.bits)) | self._lower(k) if self.bits < 64 else self._lower(k)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element >= x where it equals x, else -1: a successor search inside x's upper half."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        known = np.flatnonzero(top < self.tops)
        top, x = top[known], x[known]
        start = np.zeros(len(top), np.int64)
        some = top > 0
        start[some] = self.select0(top[some] - 1) - (top[some] - 1)
        end = self.select0(top) - top
        want = x & np.uint64((1 << self.bits) - 1)
        low, high = start, end.copy()
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                break
            middle = (low[active] + high[active]) // 2
            less = self._lower(middle) < want[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
        found = low < end
        found[found] = self._lower(low[found]) == want[found]
        out[known[found]] = low[found]
        return out


class Store:
    """Files of named arrays in a folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        parsed = urlparse(folder)
        self.local = parsed.path if parsed.scheme in ("", "file") else None
        #: The files that were read last: maps of local ones, contents of others.
        self._open: OrderedDict[str, dict[str, np.ndarray] | None] = OrderedDict()

    def __reduce__(self):
        return Store, (self.folder,)

    def _remote(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder)

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        places, at, body = {}, 0, []
        for key, array in arrays.items():
            raw = np.ascontiguousarray(array).tobytes()
            places[key] = (array.dtype.str, array.shape, at)
            pad = -len(raw) % 8
            body += [raw, b"\0" * pad]
            at += len(raw) + pad
        head = json.dumps(places).encode()
        head += b" " * (-len(head) % 8)
        data = b"".join([len(head).to_bytes(8, "little"), head, *body])
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            other = f"{self.local}/{name}.{uuid.uuid4().hex}"
            with open(other, "wb") as f:
                f.write(data)
            os.replace(other, f"{self.local}/{name}")
        else:
            system, path = self._remote()
            system.create_dir(path)
            with system.open_output_stream(f"{path}/{name}.{(other := uuid.uuid4().hex)}") as f:
                f.write(data)
            system.move(f"{path}/{name}.{other}", f"{path}/{name}")

    def _bytes(self, name: str) -> np.ndarray:
        if self.local:
            return np.memmap(f"{self.local}/{name}", np.uint8, "r")
        system, path = self._remote()
        with system.open_input_stream(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), np.uint8)

    def read(self, name: str) -> dict[str, np.ndarray] | None:
        """The arrays of a file; None where there is none, as for a shard without entries."""
        if name in self._open:
            self._open.move_to_end(name)
            return self._open[name]
        out: dict[str, np.ndarray] | None = {}
        try:
            data = self._bytes(name)
        except FileNotFoundError:
            out = None
        if out is not None:
            size = int.from_bytes(data[:8].tobytes(), "little")
            for key, (kind, shape, at) in json.loads(data[8 : 8 + size].tobytes()).items():
                n = int(np.prod(shape)) * np.dtype(kind).itemsize
                out[key] = data[8 + size + at : 8 + size + at + n].view(kind).reshape(shape)
        self._open[name] = out
        if len(self._open) > (OPEN_MAPS if self.local else OPEN_COPIES):
            self._open.popitem(last=False)
        return out


def nested(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{key}": x for key, x in parts.items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({key: arrays[f"{name}.{key}"] for key in ("low", "high", "ones", "meta")})


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codebook, codes): at most LEVELS values, each the mean of an equal share of the distinct ones."""
    distinct, inverse = np.unique(values, return_inverse=True)
    if len(distinct) <= LEVELS:
        return distinct.astype(np.float64), inverse.astype(np.uint8)
    edges = np.linspace(0, len(distinct), LEVELS + 1).astype(np.int64)
    book = np.add.reduceat(distinct, edges[:-1]) / np.diff(edges)
    code = np.searchsorted(edges, np.arange(len(distinct)), "right") - 1
    return book, code[inverse].astype(np.uint8)


def trie_level(contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray) -> dict[str, np.ndarray]:
    return nested("contexts", EliasFano.parts(contexts)) | nested("pointers", EliasFano.parts(pointers)) | nested("successors", EliasFano.parts(successors))


_none = np.empty(0, np.int64)
#: A shard without entries.
EMPTY = trie_level(_none, np.zeros(1, np.int64), _none) | {"book": np.zeros(1), "codes": _none.astype(np.uint8), "backoff_book": np.zeros(1), "backoff": _none.astype(np.uint8)}


class Words:
    """Level 1: numbers and counts of words by hash."""

    def __init__(self, store: Store, bits: int, offsets: np.ndarray, total: int) -> None:
        self.store, self.bits, self.offsets, self.total = store, bits, offsets, total
        self.size = int(offsets[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each of the sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s, low, high in _spans(shard):
            if self.offsets[s] == self.offsets[s + 1]:
                continue
            arrays = self.store.read(f"words-{s}")
            rest = hashes[low:high] & np.uint64((1 << (64 - self.bits)) - 1)
            at = sequence(arrays, "hashes").find(rest)
            known = at >= 0
            number[low:high][known] = at[known] + self.offsets[s]
            count[low:high][known] = arrays["counts"][at[known]]
        return number, count

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.size + 1)))


def _spans(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, low, high) of the runs of sorted values."""
    if len(values):
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield int(values[low]), low, high


class Model:
    """The trie with its words; the start of a text is the context after all words' numbers."""

    def __init__(self, words: Words, shards: int, heavy: dict[int, float] | None = None) -> None:
        self.words, self.shards, self.start = words, shards, words.size
        #: Contexts whose successors lie in all shards, with their backoff weights.
        self.heavy = heavy or {}
        self.heavy_ids = np.array(sorted(self.heavy), np.int64)

    def shard_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        spread = np.isin(context, self.heavy_ids)
        key[spread] ^= word[spread].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((key ^ (key >> np.uint64(33))) % np.uint64(self.shards)).astype(np.int64)

    def log_probability(self, context: np.ndarray, word: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of distinct pairs; base: log10 p(word)."""
        out = base.copy()
        usable = np.flatnonzero(context >= 0)
        weights = np.array([self.heavy[c] for c in self.heavy_ids.tolist()])
        shard = self.shard_of(context[usable], word[usable])
        order = np.argsort(shard, kind="stable")
        usable, shard = usable[order], shard[order]
        for s, low, high in _spans(shard):
            rows = usable[low:high]
            arrays = self.words.store.read(f"bigrams-{s}") or EMPTY
            c, inverse = np.unique(context[rows], return_inverse=True)
            at = sequence(arrays, "contexts").find(c.astype(np.uint64))
            known = at >= 0
            backoff, first, base_of = np.zeros(len(c)), np.zeros(len(c), np.int64), np.zeros(len(c), np.uint64)
            if known.any():
                first[known] = sequence(arrays, "pointers").get(at[known]).astype(np.int64)
                backoff[known] = arrays["backoff_book"][arrays["backoff"][at[known]]]
                inner = known & (first > 0)
                successors = sequence(arrays, "successors")
                base_of[inner] = successors.get(first[inner] - 1) + np.uint64(1)
            if len(self.heavy_ids):
                spot = np.searchsorted(self.heavy_ids, c)
                spot[spot == len(self.heavy_ids)] = 0
                is_heavy = self.heavy_ids[spot] == c
                backoff[is_heavy] = weights[spot[is_heavy]]
            seen_context = backoff[inverse] != 0
            out[rows[seen_context]] += backoff[inverse][seen_context]
            look = np.flatnonzero(known[inverse] & (word[rows] >= 0))
            if len(look):
                which = inverse[look]
                hit = successors.find(base_of[which] + word[rows[look]].astype(np.uint64))
                after = np.append(first, 0)
                # A found value belongs to the context if it lies in the context's range.
                bounds = sequence(arrays, "pointers").get(np.minimum(at[known] + 1, len(arrays["backoff"])))
                ends = np.zeros(len(c), np.int64)
                ends[known] = bounds.astype(np.int64)
                good = (hit >= after[which]) & (hit < ends[which])
                found = rows[look[good]]
                out[found] = np.log10(10 ** arrays["book"][arrays["codes"][hit[good]]] + 10 ** out[found])
        return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token codes of all texts with ends, offsets, hashes by code in rising order)."""
    codes: dict[bytes, int] = {}
    lists = [x.lower().split() for x in texts]
    flat = [w for words in lists for w in words]
    for w in flat:
        if w not in codes:
            codes[w] = len(codes)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes), np.uint64, len(codes))
    hashes = np.append(hashes, np.uint64(END))
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = np.array([len(x) + 1 for x in lists], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(int(offsets[-1]), place[-1], np.int64)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = place[np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))]
    return out, offsets, hashes[order]


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of at most about BYTES bytes of text."""
    for whole in batches:
        texts = binary(whole.column(column))
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= BYTES):
                size += len(texts[high])
                high += 1
            yield whole.slice(low, high - low), texts[low:high]
            low = high


def contexts_of(numbers: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; a text's first token follows the start."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[offsets[:-1]] = start
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in pieces(batches, 0):
        found: Counter = Counter()
        for x in texts:
            found.update(x.lower().split())
        hashes = [*(xxhash.xxh3_64_intdigest(w) for w in found), END]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array([*found.values(), len(texts)], pa.int64())], names=["hash", "n"])


def build_words(training: DataFrame, store: Store) -> tuple[Words, int, dict[int, int]]:
    """The words of the texts, the number of bigram shards, and the counts of heavy words by number."""
    counts = cut(training.mapInArrow(count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, size / WORDS))))
    # A signed hash's leading bits in unsigned order.
    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)

    shards = max(1, math.ceil(total / TOKENS))
    limit = max(1, total // (4 * shards))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes shards; yields a row with each one's words, and one for each of its heavy words."""
        for group in runs(batches, 1):
            s = group["shard"][0].as_py()
            hashes, n = group["hash"].to_numpy().view(np.uint64), group["n"].to_numpy()
            order = np.argsort(hashes)
            rest = hashes[order] & np.uint64((1 << (64 - bits)) - 1)
            store.write(f"words-{s}", nested("hashes", EliasFano.parts(rest)) | {"counts": n[order]})
            heavy = np.flatnonzero(n[order] > limit)
            columns = (np.full(len(heavy) + 1, s, np.int32), np.append(-1, heavy), np.append(len(n), n[order][heavy]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "at", "n"])

    # Heavy words have over a quarter of a bigram shard's tokens: fewer than four for each of those shards.
    written = counts.withColumn("shard", shard).select("shard", "hash", "n").repartition("shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, at long, n long").collect()
    sizes = np.zeros((1 << bits) + 1, np.int64)
    for row in written:
        if row["at"] < 0:
            sizes[row["shard"] + 1] = row["n"]
    offsets = np.cumsum(sizes)
    heavy = {int(offsets[row["shard"]] + row["at"]): row["n"] for row in written if row["at"] >= 0}
    return Words(store, bits, offsets, int(total)), shards, heavy


def build(training: DataFrame, folder: str, discount: float = DISCOUNT) -> Model:
    """Count and write the model of the texts (column text) under the folder."""
    store = Store(folder)
    words, shards, heavy = build_words(training, store)
    n_texts = int(words.find(np.array([END], np.uint64))[1][0]) if words.size else 0
    totals = heavy | {words.size: n_texts}  # the start of a text comes after all words' numbers
    shared = training.sparkSession.sparkContext.broadcast((Model(words, shards, dict.fromkeys(totals, 0.0)), totals))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the distinct bigrams of each shard: contexts as differences, words, counts."""
        packer = zstandard.ZstdCompressor(level=1)
        model = shared.value[0]
        for _, texts in pieces(batches, 0):
            codes, offsets, hashes = tokens(texts)
            numbers = np.append(model.words.find(hashes)[0], model.start)
            keys, n = np.unique(contexts_of(codes, offsets, len(hashes)) * (len(hashes) + 1) + codes, return_counts=True)
            context, word = (numbers[x] for x in np.divmod(keys, len(hashes) + 1))
            shard = model.shard_of(context, word)
            order = np.argsort(shard, kind="stable")
            rows: list[list] = [[], [], [], []]
            for s, low, high in _spans(shard[order]):
                own = order[low:high]
                for k, v in enumerate((s, *(packer.compress(x.tobytes()) for x in (np.diff(context[own], prepend=0), word[own], n[own].astype(np.uint32))))):
                    rows[k].append(v)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names=["shard", "contexts", "words", "counts"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        model, totals = shared.value
        for group in runs(batches, 1):
            s = group["shard"][0].as_py()
            block = lambda name, kind: [np.frombuffer(unpack.decompress(x), kind) for x in group[name].to_pylist()]  # noqa: B023, E731
            context = np.concatenate([np.cumsum(x) for x in block("contexts", np.int64)])
            word, n = np.concatenate(block("words", np.int64)), np.concatenate(block("counts", np.uint32)).astype(np.int64)
            order = np.lexsort((word, context))
            context, word, n = context[order], word[order], n[order]
            firsts = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]))))
            context, word, n = context[firsts], word[firsts], np.add.reduceat(n, firsts)
            heads = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            sizes = np.diff(np.append(heads, len(context)))
            own = context[heads]
            # Each token but an end is followed by one, so a context's tokens are those of its bigrams, all of them here.
            total = np.add.reduceat(n, heads).astype(np.float64)
            spread = np.isin(own, model.heavy_ids)
            total[spread] = [totals[c] for c in own[spread].tolist()]
            book, codes = quantised(np.log10((n - discount) / np.repeat(total, sizes)))
            backoff_book, backoff = quantised(np.log10(discount * sizes / total))
            lasts = word[heads + sizes - 1].astype(np.uint64) + np.uint64(1)
            bases = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lasts)[:-1]))
            model.words.store.write(f"bigrams-{s}", trie_level(own, np.append(heads, len(context)), np.repeat(bases, sizes) + word.astype(np.uint64)) | {"book": book, "codes": codes, "backoff_book": backoff_book, "backoff": backoff})
            yield pa.RecordBatch.from_arrays([pa.array(own[spread]), pa.array(sizes[spread].astype(np.int64))], names=["context", "n"])

    blocks = training.mapInArrow(count, "shard int, contexts binary, words binary, counts binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    # A row for each heavy context.
    found = blocks.mapInArrow(write, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).collect()
    return Model(words, shards, {r["context"]: math.log10(discount * r["n"] / totals[r["context"]]) for r in found})


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with n_tokens, n_known, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    out = docs.withColumns({"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in pieces(batches, at):
            codes, offsets, hashes = tokens(texts)
            number, count = model.words.find(hashes)
            base = model.words.base(count) if model.words.total else np.zeros(len(hashes))
            context = np.concatenate((np.zeros(1, np.int64), codes[:-1]))
            context[offsets[:-1]] = len(hashes)
            keys, inverse = np.unique(context * (len(hashes) + 1) + codes, return_inverse=True)
            left, right = np.divmod(keys, len(hashes) + 1)
            p = model.log_probability(np.append(number, model.start)[left], number[right], base[right]) if model.words.total else np.zeros(len(keys))
            sums = [np.add.reduceat(x, offsets[:-1]) for x in ((count > 0)[codes].astype(np.int64), base[codes], p[inverse])]
            arrays = [*batch.columns[: len(batch.columns) - 4], pa.array(np.diff(offsets)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return out.mapInArrow(each, out.schema)


def report(docs: DataFrame) -> DataFrame:
    folder = f"{checkpoint_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    model = build(docs.filter(fold() != 1).select("text"), folder)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score")
