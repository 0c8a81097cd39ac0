"""N-gram Jaccard join by MinHash banding.

Each text is a set of hashed shingles of five consecutive words. Texts with equal sets are one class, represented by
its smallest doc_id, so copies are never paired. A class's MinHash signature is cut into BANDS bands of ROWS values;
two classes with Jaccard similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, and BANDS is the least
number that reaches RECALL at the threshold. Classes are shuffled on their band hashes and each is linked with the
smallest class of its band: buckets become stars, not pairs. Within each connected part of these stars all pairs are
verified on the full shingle sets, by matrix products over the shingles that occur at least twice; a large part is dealt
into blocks, and each pair of blocks is a task of its own, so a hot part is spread over many tasks with bounded memory.
No partner or candidate is dropped.

Defined results: words are those of lower-cased A-Z; a text of one to four words has one shingle, all of it; a text
without words (or null) links with nothing; null doc_ids link with nothing and are kept; rows with one doc_id are one
document, and stay or go together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import binary, cut, lists, runs, slices
from isochron.llm.components import components

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99999, 5
#: Shingles and classes of a block, the blocks of a part at most while blocks stay under MAX_BLOCK shingles.
BLOCK, BLOCK_ROWS, MAX_BLOCKS, MAX_BLOCK = 65_536, 1_000, 16, 2_000_000
#: Ids (two numbers each) up to which a table of candidates is broadcast rather than shuffled against the texts.
MAX_BROADCAST = 1_000_000
#: Distinct words whose hashes a worker keeps.
MEMO = 1 << 18


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands of `rows` values that finds a pair at the threshold with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Hashes(dict):
    """Hash by word, for at most MEMO words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, hashes: Hashes, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = (total + codes[k : len(codes) - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(31)
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) hashes of the bands of each non-empty set's MinHash signature."""
    random = np.random.default_rng(2024)
    odd = random.integers(0, 1 << 63, (bands * rows,), np.uint64) * np.uint64(2) + np.uint64(1)
    flip = random.integers(0, 1 << 63, (bands * rows,), np.uint64)
    out = np.empty((len(sets), bands), np.uint64)
    low = 0
    while low < len(sets):  # about 64k shingles at a time stay in cache
        high, size = low, 0
        while high < len(sets) and (high == low or size + len(sets[high]) <= 65_536):
            size += len(sets[high])
            high += 1
        joined = np.concatenate(sets[low:high])
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sets[low : high - 1]]))).astype(np.int64)
        for band in range(bands):
            key = np.full(high - low, band + 1, np.uint64)
            for k in range(band * rows, band * rows + rows):
                key = mixed(key + np.minimum.reduceat((joined ^ flip[k]) * odd[k], starts))
            out[low:high, band] = key
        low = high
    return out


def fingerprints(docs: DataFrame, n: int = N, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """(doc_id, h1, h2, n, bands) of each row: 128-bit hash of its shingle set, its size, its band hashes."""
    count = bands or bands_for()
    schema = "doc_id long, h1 long, h2 long, n int, bands array<long>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches):
            if batch.num_rows:
                sets = [shingles(x, hashes, n) for x in binary(batch.column(1))]
                digests = np.array([(h & (1 << 64) - 1, h >> 64) for h in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)], np.uint64).reshape(-1, 2).view(np.int64)
                full = [k for k, s in enumerate(sets) if len(s)]
                signed = signatures([sets[k] for k in full], count, rows).view(np.int64) if full else np.empty((0, count), np.int64)
                sizes = np.zeros(len(sets) + 1, np.int64)
                sizes[[k + 1 for k in full]] = count
                arrays = [batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(signed.ravel()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h1", "h2", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    width = max(64, min(4096, (1 << 24) // m))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, (low, low + width)))
        dense = np.zeros((m, width), np.float32)
        dense[owner[part], column[part] - low] = 1
        out += dense @ dense.T
    return out


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id it reaches through `linked` (a symmetric matrix)."""
    best = ids.copy()
    while True:
        least = np.array([min(best[k], best[row].min()) if row.any() else best[k] for k, row in enumerate(linked)], np.int64)
        if (least == best).all():
            return best
        best = least


def verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, i, j, block, id, copies, shingles), sorted by the first three: links in and between blocks."""
    ids_out, roots_out, links_out = [], [], []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids_out, roots_out, links_out)], names=["id", "root", "links"])
        for x in (ids_out, roots_out, links_out):
            x.clear()
        return batch

    for group in runs(batches, 3):
        ids, copies, block = (group[name].to_numpy() for name in ("id", "copies", "block"))
        values, offsets = lists(group["shingles"])
        sets = [values[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.diff(offsets).astype(np.float64)
        shared = overlaps(sets).astype(np.float64)
        linked = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1) >= threshold
        np.fill_diagonal(linked, False)
        if group["i"][0] != group["j"][0]:
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        if links.any():
            some = links > 0
            ids_out.append(ids[some])
            roots_out.append(roots(linked[np.ix_(some, some)], ids[some]))
            links_out.append(links[some].astype(np.int64))
        if sum(map(len, ids_out)) > 10_000:
            yield flushed()
    if ids_out:
        yield flushed()


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, class_id, n_copies, n_links, component_id, kept of each row."""
    prints = cut(fingerprints(docs, n, bands_for(threshold, recall, rows), rows))
    known = prints.filter("doc_id is not null and n > 0")
    classes = cut(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max("n").alias("n")))
    firsts = known.join(classes.select("h1", "h2", "class_id"), ["h1", "h2"]).filter("doc_id = class_id")
    banded = firsts.select("class_id", F.explode("bands").alias("band")).distinct()
    heads = banded.groupBy("band").agg(F.min("class_id").alias("head"), F.count("*").alias("size")).filter("size > 1")
    # What many classes share, a band or a component, is no hot key: adaptive joins split it.
    parts = components(banded.join(heads.drop("size"), "band").filter("class_id != head").select(F.col("class_id").alias("a"), F.col("head").alias("b")))

    sized = parts.join(classes.groupBy(F.col("class_id").alias("id")).agg(F.sum("copies").alias("copies"), F.sum("n").alias("n")), "id")
    totals = sized.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    wanted = F.greatest(F.least(F.ceil(F.col("total") / BLOCK), F.lit(MAX_BLOCKS)), F.ceil(F.col("total") / MAX_BLOCK), F.ceil(F.col("members") / BLOCK_ROWS))
    candidates = cut(sized.join(totals.select("component", wanted.cast("int").alias("blocks")), "component").select("id", "component", "copies", "blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    picked = texts.join(F.broadcast(candidates) if candidates.count() <= MAX_BROADCAST else candidates, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches):
            if batch.num_rows:
                found = [shingles(x, hashes, n) for x in binary(batch.column(1))]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in found]))), pa.int32())
                flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "component", "copies", "blocks", "shingles"])

    shingled = picked.mapInArrow(sets, "id long, component long, copies long, blocks int, shingles array<long>")
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    dealt = shingled.withColumn("block", block).withColumn("other", other)
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "shingles")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    links = cut(dealt.mapInArrow(lambda batches: verify(batches, threshold), "id long, root long, links long"))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))

    named = classes.join(counts.join(groups, "id").withColumnRenamed("id", "class_id"), "class_id", "left")
    named = named.select("h1", "h2", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class_id").alias("component"))
    linked = known.select("doc_id", "h1", "h2", "n").join(named, ["h1", "h2"])
    out = linked.select("doc_id", "n", "class_id", "copies", (F.col("copies") - 1 + F.col("links")).alias("links"), "component")
    alone = prints.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"), F.col("doc_id").alias("component"))
    out = out.union(alone)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", F.col("copies").alias("n_copies"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
