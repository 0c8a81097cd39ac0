"""Suffix-array dedup: repeated passages found by deep-shallow sorting of the suffixes that can repeat.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier. Sorting every suffix of the corpus
is not needed for that: in each string of LENGTH bytes the least hash of its GRAM-byte substrings marks an anchor, equal
strings have equal anchors at equal places, and each anchor stands for a run of string starts, its context. So

1. a map-only pass finds the anchors, (gram hash, context hash, document, row, place); of equal contexts in one batch only
   the first goes on, the later ones are repeats already, which keeps hot passages from gathering;
2. anchors are shuffled by gram hash and sorted; they stream, holding one row. All but the first of equal contexts are
   repeats as a whole. Where one gram has different contexts, each context's first is contested: some of its strings
   may repeat while others don't;
3. the contested contexts are cut from their texts and their suffixes sorted: multikey quicksort on eight-byte characters to
   depth SHALLOW, then blind tries for what still agrees. Neighbours that agree on LENGTH bytes repeat. A gram with more
   contexts than HOT has its suffixes dealt by the hash of their LENGTH bytes, so no task holds a hot gram;
4. the repeated spans are merged for each document and cut out of its bytes.

Each row gets a number of its own, fixed by writing the numbered, compressed texts once; steps 3 and 4 join them with
places by that number, so that neither rows that share a doc_id nor those without one meet in a task. Long texts are
walked in overlapping pieces, so a text's size is bounded by what one value may hold, not by this module.

Document ids must fit a long. Defined results: null text is the empty text; a null doc_id comes after all others; rows
that share a doc_id are sections of one document, in the order in which they are read, and strings never cross sections.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import binary, cut, runs, slices

LENGTH, GRAM = 100, 32
SHALLOW, HOT = 32, 4_096
#: Bytes that are searched for anchors at a time, in pieces of one text or of several; bits of a place within them.
CHUNK, PLACE = 1 << 20, 28
NULL_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place; size is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < size:
        first = h[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width)
        first ^= first >> np.uint64(31)
        h = (first + h[width:]) * np.uint64(0x9E3779B97F4A7C15)
        width *= 2
    return h ^ (h >> np.uint64(32))


def window_least(keys: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` consecutive keys."""
    out, width = keys, 1
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text_bytes: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, before, after, gram hash, context hash) of the anchors of the texts.

    `before` starts of strings lie before the anchor's place (the first at place - before), `after` counts the starts
    after that first one; the context is the bytes that those strings cover.
    """
    joined = b"".join(text_bytes)
    sizes = np.array([len(x) for x in text_bytes], np.int64)
    ends = np.cumsum(sizes)
    none = np.empty(0, np.int64)
    if len(joined) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram)
    mask = np.uint64((1 << PLACE) - 1)
    # Ties go to the leftmost place, which depends on nothing but the string.
    least = window_least((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    at = (least & mask).astype(np.int64)
    inside = np.ones(len(at), bool)  # strings that lie in one text
    for end in ends[:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    place = at[new]
    context = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b], c) for a, b, c in zip(first.tolist(), (last + length).tolist(), (place - first).tolist(), strict=True)), np.uint64, len(first))
    text = np.searchsorted(ends, first, "right")
    return text, place - (ends - sizes)[text], place - first, last - first, hashes[place], context


def pieces(texts: list[bytes], length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text, offset, bytes) lists of about `most` bytes; a longer text comes in pieces that share length - 1 bytes."""
    text: list[int] = []
    offset: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, x in enumerate(texts):
        for low in range(0, max(len(x) - length + 1, 0), most):
            piece = x if len(x) < most + length else x[low : low + most + length - 1]
            if held and size + len(piece) > most + length:
                yield np.array(text), np.array(offset), held
                text, offset, held, size = [], [], [], 0
            text.append(k)
            offset.append(low)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(text), np.array(offset), held


#: A row of the anchors' table; `at` has the anchor's place, the starts before it and those after the first.
KEYS = ["gram", "context", "doc", "row", "at", "kind"]
#: Kinds of rows: an anchor to be shuffled, one whose whole context repeats.
ANCHOR, REPEAT = 0, 1


def packed(place: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return (place << 16) | (before << 8) | after


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first start, last start) of an anchor's strings."""
    first = (at >> 16) - ((at >> 8) & 255)
    return first, first + (at & 255)


def scan(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, packed text) to anchors, of equal contexts in a batch only the first."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for at_row in range(0, whole.num_rows, 2_048):
            batch = whole.slice(at_row, 2_048)
            docs, rows = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            parts = []
            for source, offset, held in pieces([unpack(x) for x in batch.column(2).to_pylist()], length, most):
                text, place, before, after, gram, context = anchors(held, length)
                if len(text):
                    own = source[text]
                    parts.append((gram, context, docs[own], rows[own], packed(offset[text] + place, before, after)))
            if not parts:
                continue
            gram, context, doc, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, row, doc, context, gram))
            gram, context, doc, row, at = (x[order] for x in (gram, context, doc, row, at))
            again = np.concatenate(([False], (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(row), pa.array(at), pa.array(again.astype(np.int8))], names=KEYS)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by KEYS' first five and repeats last to repeats and contested anchors; a gram's last row is carried."""
    carried: tuple[int, int] | None = None  # gram and context of the row before
    waiting: list | None = None  # the gram's only context so far
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, context, *place, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        moved = kind == REPEAT
        out = [(gram[moved], *(x[moved] for x in place), np.full(int(moved.sum()), REPEAT, np.int8))]
        gram, context, *place = (x[~moved] for x in (gram, context, *place))
        if len(gram):
            same = np.empty(len(gram), bool)
            same[1:] = gram[1:] == gram[:-1]
            same[0] = carried is not None and carried[0] == gram[0]
            again = same.copy()
            again[1:] &= context[1:] == context[:-1]
            again[0] = same[0] and carried[1] == context[0]
            out.append((gram[again], *(x[again] for x in place), np.full(int(again.sum()), REPEAT, np.int8)))
            # Firsts of contexts; contested where the gram has another one.
            heads = np.flatnonzero(~again)
            joined = same[heads]
            contested = joined.copy()
            contested[:-1] |= joined[1:] & (gram[heads[1:]] == gram[heads[:-1]]) if len(heads) > 1 else False
            picked = heads[contested]
            out.append((gram[picked], *(x[picked] for x in place), np.full(len(picked), ANCHOR, np.int8)))
            if waiting is not None:
                if len(heads) and joined[0] and gram[heads[0]] == waiting[0]:
                    out.append(tuple(np.array([x]) for x in waiting) + (np.full(1, ANCHOR, np.int8),))
                if gram[-1] != waiting[0] or (len(heads) and joined[0]):
                    waiting = None
            if len(heads) and not contested[-1] and gram[heads[-1]] == gram[-1]:
                waiting = [gram[heads[-1]], *(x[heads[-1]] for x in place)]
            carried = (gram[-1], context[-1])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", *PLACES, "kind"])


#: Columns that say where a string or a run of them starts.
PLACES = ["doc", "row", "at"]


def equal_classes(windows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Numbers of the classes of equal rows of `windows` (n, bytes) within equal `group`s, by deep-shallow sorting.

    Multikey quicksort takes eight bytes a step as one character: rows that share group and prefix are sorted by their
    next character and split, and rows left alone are done. Rows that still agree at depth `shallow` go into blind
    tries, all groups at once: a row branches off the path of its group's first row at their first differing byte; rows
    with the same branch (depth and byte) form the next group, whose first row opens a path of its own.
    """
    n, width = windows.shape
    classes = np.full(n, -1, np.int64)
    order = np.argsort(group, kind="stable")
    groups = _numbered(group[order])
    done = 0

    def alone(order: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal done
        single = np.bincount(groups)[groups] == 1
        rows = order[single]
        classes[rows] = done + np.arange(len(rows))
        done += len(rows)
        return order[~single], _numbered(groups[~single])

    order, groups = alone(order, groups)
    for depth in range(0, shallow, 8):
        if not len(order):
            return classes
        character = np.ascontiguousarray(windows[order, depth : depth + 8]).view(">u8").ravel()
        sorting = np.lexsort((character, groups))
        order, groups, character = order[sorting], groups[sorting], character[sorting]
        split = np.concatenate(([0], (groups[1:] != groups[:-1]) | (character[1:] != character[:-1])))
        order, groups = alone(order, np.cumsum(split))
    while len(order):
        first = np.concatenate(([True], groups[1:] != groups[:-1]))
        path = order[first][groups]
        differs = windows[order, shallow:] != windows[path, shallow:]
        branch = np.where(differs.any(1), differs.argmax(1), width)
        same = branch == width
        classes[order[same]] = done + groups[same]
        done += int(groups[-1]) + 1
        order, groups, branch = order[~same], groups[~same], branch[~same]
        if not len(order):
            break
        byte = windows[order, shallow + branch]
        sorting = np.lexsort((byte, branch, groups))
        order, groups, branch, byte = order[sorting], groups[sorting], branch[sorting], byte[sorting]
        split = np.concatenate(([0], (groups[1:] != groups[:-1]) | (branch[1:] != branch[:-1]) | (byte[1:] != byte[:-1])))
        order, groups = alone(order, np.cumsum(split))
    return classes


def _numbered(sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.concatenate(([0], np.cumsum(sorted_values[1:] != sorted_values[:-1])))


def later(classes: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows have an earlier row of their class."""
    order = np.lexsort((at, row, doc, classes))
    out = np.zeros(len(classes), bool)
    out[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    return out


def sorted_windows(tables: list[pa.Table], length: int) -> pa.RecordBatch:
    """Contexts (gram, doc, row, at, bytes) of whole grams to the (row, at) of the strings that repeat."""
    whole = pa.concat_tables(tables)
    gram, doc, own, at = (whole[k].to_numpy() for k in ("gram", *PLACES))
    texts = whole["bytes"].to_pylist()
    first, last = unpacked(at)
    counts = (last - first + 1).astype(np.int64)
    lengths = np.array([len(x) for x in texts], np.int64)
    bases = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    context = np.repeat(np.arange(len(texts)), counts)
    step = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[bases[context] + step]
    start = first[context] + step
    # Strings of one gram can only agree where the gram lies at the same place in them.
    before = ((at >> 8) & 255)[context] - step
    _, number = np.unique(gram, return_inverse=True)
    classes = equal_classes(windows, number[context] * 512 + before + 256)
    again = later(classes, doc[context], own[context], start)
    return as_runs(own[context][again], start[again])


def as_runs(row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Single starts to (row, at) runs of at most 256 starts."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))) if len(row) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    nth = np.arange(len(row)) - heads[np.cumsum(new) - 1]
    heads = np.flatnonzero(new | (nth % 256 == 0))
    sizes = np.diff(np.append(heads, len(row)))
    return pa.RecordBatch.from_arrays([pa.array(row[heads]), pa.array((start[heads] << 16) | (sizes - 1))], names=["row", "at"])


def settle_contested(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram; sorts the strings of some hundred contexts at a time, whole grams together."""
    held, size = [], 0
    for group in runs(batches, 1):
        if held and size + group.num_rows > 2_000:
            yield sorted_windows(held, length)
            held, size = [], 0
        held.append(group)
        size += group.num_rows
    if held:
        yield sorted_windows(held, length)


#: Kinds of fetched rows: a context, one string of a hot gram, a string that repeats an earlier one of its batch.
PLAIN, STRING, SETTLED = 0, 1, 2


def fetched_contexts(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Rows (doc, row, packed text, wanted) to contexts, or for hot grams to strings, of equal ones the first only and marks."""
    rows: list[list] = [[], [], [], [], [], []]
    strings: dict[bytes, list[tuple[int, int, int]]] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for doc, row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(unpack, batch.column(2).to_pylist()), batch.column(3).to_pylist(), strict=True):
        for x in wanted:
            at = x["at"]
            first = (at >> 16) - ((at >> 8) & 255)
            if x["hot"]:
                for start in range(first, first + (at & 255) + 1):
                    strings.setdefault(text[start : start + length], []).append((doc, row, start))
            else:
                for k, v in enumerate((x["gram"], doc, row, at, text[first : first + (at & 255) + length], PLAIN)):
                    rows[k].append(v)
    for piece, places in strings.items():
        digest = xxhash.xxh3_64_intdigest(piece)
        for nth, (doc, row, start) in enumerate(sorted(places)):
            for k, v in enumerate((digest - (1 << 64) if digest >> 63 else digest, doc, row, start << 16, None if nth else piece, SETTLED if nth else STRING)):
                rows[k].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int8())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names=["gram", *PLACES, "bytes", "kind"])


def settle_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (hash, doc, row, at, bytes) sorted by hash to those that repeat; a hash has a row from each batch at most."""
    held: list[pa.Table] = []
    size = 0

    def sort(tables: list[pa.Table]) -> pa.RecordBatch:
        whole = pa.concat_tables(tables)
        windows = np.frombuffer(b"".join(whole["bytes"].to_pylist()), np.uint8).reshape(whole.num_rows, -1)
        doc, row, at = (whole[k].to_numpy() for k in PLACES)
        again = later(equal_classes(windows, whole["hash"].to_numpy()), doc, row, at)
        return as_runs(row[again], at[again] >> 16)

    for group in runs(batches, 1):
        if held and size + group.num_rows > 50_000:
            yield sort(held)
            held, size = [], 0
        held.append(group)
        size += group.num_rows
    if held:
        yield sort(held)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, row, packed): the texts compressed, each row with a number of its own; written once, so numbers stay."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.monotonically_increasing_id().alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(x) for x in binary(batch.column(3))], pa.binary())], names=["doc_id", "doc", "row", "packed"])

    return cut(rows.mapInArrow(each, f"doc_id {kind}, doc long, row long, packed binary"))


def spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT, most: int = CHUNK) -> DataFrame:
    """(row, starts): what repeats in each of the numbered rows, as packed runs of string starts."""
    found = keyed.select("doc", "row", "packed").mapInArrow(lambda batches: scan(batches, length, most), "gram long, context long, doc long, row long, at long, kind byte")
    # Repeats that were settled on the way need no place of their own in the shuffle: they spread by row.
    dealt = found.repartition(F.when(F.col("kind") == REPEAT, F.col("row")).otherwise(F.col("gram"))).sortWithinPartitions("gram", "context", *PLACES)
    settled = cut(dealt.mapInArrow(settle, "gram long, doc long, row long, at long, kind byte"))

    contested = settled.filter(F.col("kind") == ANCHOR).select("gram", "row", "at")
    busy = contested.groupBy("gram").count().filter(F.col("count") > hot).select("gram", F.lit(True).alias("hot"))
    marked = contested.join(busy, "gram", "left").select("gram", "row", "at", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = marked.groupBy("row").agg(F.collect_list(F.struct("gram", "at", "hot")).alias("wanted"))
    texts = keyed.select("doc", "row", "packed").join(wanted.hint("shuffle_hash"), "row").select("doc", "row", "packed", "wanted")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            yield fetched_contexts(part, length)

    fetched = texts.mapInArrow(contexts, "gram long, doc long, row long, at long, bytes binary, kind byte")
    if busy.isEmpty():
        plain = fetched
    else:
        fetched = cut(fetched)
        plain = fetched.filter(F.col("kind") == PLAIN)
    plain = plain.drop("kind").repartition("gram").sortWithinPartitions("gram")
    parts = plain.mapInArrow(lambda batches: settle_contested(batches, length), "row long, at long")
    if not busy.isEmpty():
        many = fetched.filter(F.col("kind") == STRING).select(F.col("gram").alias("hash"), *PLACES, "bytes").repartition("hash").sortWithinPartitions("hash", *PLACES)
        parts = parts.union(many.mapInArrow(settle_hot, "row long, at long")).union(fetched.filter(F.col("kind") == SETTLED).select("row", "at"))
    again = settled.filter(F.col("kind") == REPEAT).select("row", "at").union(parts)
    return cut(again.groupBy("row").agg(F.collect_list("at").alias("starts")))


def merged(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the maximal covered runs."""
    first, last = unpacked(np.sort(starts))
    order = np.argsort(first, kind="stable")
    low, high = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate(([True], low[1:] > high[:-1]))
    return low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


def removed(docs: DataFrame, length: int = LENGTH, hot: int = HOT, most: int = CHUNK) -> DataFrame:
    """doc_id, section, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row."""
    keyed = numbered(docs.select("doc_id", "text"))
    starts = spans(keyed, length, hot, most)
    rows = keyed.join(starts.hint("shuffle_hash"), "row", "left").select("doc_id", F.col("row").alias("section"), "packed", "starts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text, packed_starts in zip(map(unpack, batch.column(2).to_pylist()), batch.column(3), strict=True):
                kept, gone, n = text, 0, 0
                if packed_starts.is_valid:
                    low, high = merged(packed_starts.values.to_numpy(), length)
                    n, gone = len(low), int((high - low).sum())
                    edges = [0, *np.column_stack([low, high]).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for k, v in enumerate((len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], names=["doc_id", "section", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {key}, section long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame, **options) -> DataFrame:
    return removed(docs, **options).drop("section", "kept")
