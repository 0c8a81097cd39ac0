"""Embedding near-dedup by NN-descent.

Equal vectors are one class, represented by the smallest id. Each class starts with its K best neighbours among those
that share a bucket of random hyperplanes (a few tables; large buckets are dealt into chunks). NN-descent then refines
the lists: every class is a centre that introduces its neighbours, forward and reverse, to each other; each keeps the K
best it has met. A centre with a long reverse list is dealt into chunks, so hubs neither gather in a task nor lose
members. Rounds go on until one brings no new link (similarity at the threshold or above).

Saturated lists, whose neighbours are all links, are enlarged: to the sizes of ENLARGED in turn, each with the buckets
looked through once more for the saturated classes and rounds of its own around them. Lists beyond the last size would grow with the square of a group, so from there on
links make connected parts, and inside each part all pairs are compared in double precision, in blocks whose pairs are
tasks of their own. A link between two parts can be in neither list only if both its ends are still saturated: the
saturated classes of each part lie in balls, and balls of two parts that are near enough for a link are compared, all
pairs again, and the parts joined.

There are so many tables that a pair at the threshold shares a bucket with probability RECALL, TABLES at least. An audit
compares random classes with all others, until LINKED of them have links or all classes are audited, AUDIT at least;
links that the lists missed are added. Recall is the mean over audited classes with links, so one large group does not
outweigh the others; while it is under RECALL, more tables and rounds follow, and after TRIES of them an error.

Vectors of every length go through the same jobs: the length is a part of the keys of buckets and of tiles, and the
audit keeps its account by length. The driver holds a number for each distinct length.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors
link only with vectors of their own length; a null vec_id links with nothing and is kept; rows that share a vec_id
share a component.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import cut, runs
from isochron.llm.components import components
from isochron.llm.jaccard import roots

LOG = logging.getLogger(__name__)
THRESHOLD, K, TABLES, ROUNDS, RECALL = 0.9, 10, 8, 6, 0.999
#: Sizes to which saturated lists are enlarged, in this order.
ENLARGED = (40,)
#: Members of a bucket or of a centre's chunk, classes of a block, classes that the audit compares with all.
CHUNK, BLOCK_ROWS, AUDIT = 128, 512, 256
#: Balls of a tile; tiles meet in pairs.
TILE = 1_024
#: Classes that one pass of the audit compares with all, classes with links that it asks for, and audits before the error.
PIECE, LINKED, TRIES = 2_048, 1_000, 8
#: Single precision may put a link this far below the threshold; such pairs are decided in double precision.
SLACK = 1e-5
#: A similarity that none exceeds: a list with this floor takes nothing more.
NEVER = 2.0


def clean(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, h1, h2, dim, unit): hash of the vector and its unit vector's bytes, null where it links with nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, value in zip(batch.column(0), batch.column(1), strict=True):
                h1 = h2 = dim = unit = None
                if value.is_valid and i.is_valid and len(value.values) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    largest = np.abs(x).max()
                    if np.isfinite(largest) and largest > 0:
                        scaled = x / largest
                        unit = (scaled / np.sqrt((scaled * scaled).sum())).tobytes()
                        digest = xxhash.xxh3_128_intdigest((x + 0.0).tobytes())
                        h1, h2 = np.array([digest & (1 << 64) - 1, digest >> 64], np.uint64).view(np.int64).tolist()
                        dim = len(x)
                for k, v in enumerate((h1, h2, dim, unit)):
                    out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], names=["id", "h1", "h2", "dim", "unit"])

    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding)).mapInArrow(each, "id long, h1 long, h2 long, dim int, unit binary")


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the unit vectors of each length in a batch."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield int(size) // 8, places, _matrix(column.take(pa.array(places)), np.float64)


def _best(batches: Iterator[pa.RecordBatch], keys: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys..., id, worst, vector) sorted by the keys: for each member its k best others of the group above worst."""
    held: list[list[np.ndarray]] = [[], [], []]
    for group in runs(batches, keys):
        if group.num_rows < 2:
            continue
        ids, worst = group["id"].to_numpy(), group["worst"].to_numpy()
        if worst.min() >= NEVER:
            continue
        x = _matrix(group["vector"], np.float32)
        similar = x @ x.T
        similar[ids[:, None] == ids[None, :]] = -2
        n = min(k, len(ids) - 1)
        near = np.argpartition(-similar, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(similar, near, 1)
        row, column = np.nonzero(value > np.maximum(worst, np.float32(-1.5))[:, None])
        for kept, new in zip(held, (ids[row], ids[near[row, column]], value[row, column]), strict=True):
            kept.append(new)
        if len(held[0]) > 500:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=["id", "other", "similar"])
            held = [[], [], []]
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=["id", "other", "similar"])


FOUND = "id long, other long, similar float"


def _bits(count: int) -> int:
    return max(0, int(np.log2(max(1, count / CHUNK))))


def tables_for(bits: int, threshold: float, recall: float, least: int) -> int:
    """Tables in which a pair at the threshold shares one bucket of so many hyperplanes or more with probability recall."""
    shared = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    if shared >= 1 or recall <= 0:
        return least
    if shared <= 0 or recall >= 1:
        raise ValueError("no number of tables gives this recall")
    return max(least, int(np.ceil(np.log(1 - recall) / np.log1p(-shared))))


def start(classes: DataFrame, counts: Mapping[int, int], k: int, tables: Mapping[int, range], first: int, last: int, growing: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """First lists: the k best of each bucket chunk of random hyperplanes, in tables first to last - 1.

    Given growing lists' classes, only they get lists, of links alone.
    counts and tables: classes and tables of each length; a length takes no part in tables that are not its own.
    """

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, places, x in _by_length(batch.column(1)):
                bits, ids, floor = _bits(counts[dim]), *(batch.column(k).take(pa.array(places)) for k in (0, 2))
                x = x.astype(np.float32)
                narrow = pa.array([v.tobytes() for v in x], pa.binary())
                for t in range(max(first, tables[dim].start), min(last, tables[dim].stop)):
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng((17, dim, t)).standard_normal((max(bits, 1), dim)).astype(np.float32)
                    sign = ((x @ planes[dim, t].T > 0).astype(np.int64) << np.arange(max(bits, 1))).sum(1) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(sign * last + t), ids, floor, narrow], names=["dim", "bucket", "id", "worst", "vector"])

    if growing is None:
        rows = classes.select("id", "unit", F.lit(-2.0).cast("float").alias("worst"))
    else:
        rows = classes.select("id", "unit").join(growing.withColumn("open", F.lit(True)), "id", "left")
        rows = cut(rows.select("id", "unit", F.when(F.col("open"), threshold - SLACK).otherwise(NEVER).cast("float").alias("worst")))
    dealt = rows.mapInArrow(buckets, "dim int, bucket long, id long, worst float, vector binary")
    sizes = dealt.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = dealt.join(sizes, ["dim", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("id", "bucket"), "chunks").cast("int"))
    dealt = dealt.select("dim", "bucket", "chunk", "id", "worst", "vector")
    dealt = dealt.repartition("dim", "bucket", "chunk").sortWithinPartitions("dim", "bucket", "chunk")
    return _lists(dealt.mapInArrow(lambda batches: _best(batches, 3, k), FOUND), k)


def _lists(found: DataFrame, k: int) -> DataFrame:
    """The k most similar of each id: (id, list of (similar, other))."""
    pairs = found.groupBy("id", "other").agg(F.max("similar").alias("similar"))
    # Each task keeps k of an id before they are shuffled by id, so a hub's candidates are never gathered.
    best = pairs.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similar"), F.desc("other")))).filter(F.col("rank") <= k)
    return cut(best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("similar", "other")), False).alias("near")))


def _known(graph: DataFrame) -> DataFrame:
    return graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.similar").alias("similar"))


def widen(graph: DataFrame | None, classes: DataFrame, counts: Mapping[int, int], k: int, held: int, step: int, tables: Mapping[int, range], growing: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The lists, of at most `held`, with the best of each length's tables, a few tables at a time."""
    step, last = max(1, step), max(own.stop for own in tables.values())
    for low in range(min(own.start for own in tables.values()), last, step):
        more = start(classes, counts, k, tables, low, min(low + step, last), growing, threshold)
        graph = more if graph is None else _lists(_known(graph).union(_known(more)), held)
    return graph


def descend(graph: DataFrame, classes: DataFrame, k: int, held: int, growing: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One round: each class introduces its neighbours to each other; lists keep at most `held`.

    Given growing lists' classes, only they and their neighbours introduce, and the growing ones keep all links up to `held`
    where the others keep what is better than their k-th.
    """
    edges = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"))
    both = edges.union(edges.select("other", "id")).distinct()
    worst = F.when(F.size("near") >= k, F.element_at("near", k)["similar"]).otherwise(F.lit(-2.0))
    floors = graph.select("id", "near")
    if growing is not None:
        around = both.join(growing, "id").select(F.col("other").alias("id")).union(growing).distinct()
        both = both.join(around, "id", "left_semi")
        floors = floors.join(growing.withColumn("open", F.lit(True)), "id", "left")
        full = F.when(F.size("near") >= held, F.element_at("near", held)["similar"]).otherwise(F.lit(threshold - SLACK))
        worst = F.when(F.col("open"), full).otherwise(worst)
    centres = both.select("id").distinct()
    members = both.select(F.col("id").alias("centre"), F.col("other").alias("id")).union(centres.select(F.col("id").alias("centre"), "id"))
    chunks = both.groupBy(F.col("id").alias("centre")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = members.join(chunks, "centre").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    narrow = classes.select("id", "vector").join(floors.select("id", worst.cast("float").alias("worst")), "id")
    dealt = members.join(narrow, "id").select("centre", "chunk", "id", "worst", "vector").repartition("centre", "chunk").sortWithinPartitions("centre", "chunk")
    most = k if growing is None else held
    met = dealt.mapInArrow(lambda batches: _best(batches, 2, most), FOUND)
    return _lists(_known(graph).union(met), held)


def saturated(graph: DataFrame, threshold: float, size: int) -> DataFrame:
    """Ids whose lists hold so many links."""
    return graph.filter(F.size("near") >= size).filter(F.element_at("near", size)["similar"] >= threshold - SLACK).select("id")


def linked(graph: DataFrame, threshold: float) -> DataFrame:
    pairs = graph.select("id", F.explode("near").alias("e")).filter(F.col("e.similar") >= threshold - SLACK)
    return pairs.select(F.col("id").alias("a"), F.col("e.other").alias("b"))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, block, unit), sorted by the first two: mean and radius of each block."""
    for group in runs(batches, 2):
        x = _matrix(group["unit"], np.float64)
        centre = x.mean(0)
        radius = np.sqrt(((x - centre) ** 2).sum(1).max())
        yield pa.RecordBatch.from_arrays([group["component"][:1].combine_chunks(), group["block"][:1].combine_chunks(), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], names=["component", "block", "centre", "radius"])


def _reaching(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Rows (dim, i, j, tile, component, block, centre, radius), sorted by the first three: balls of two parts within reach."""
    for group in runs(batches, 3):
        tile, component, block, radius = (group[name].to_numpy() for name in ("tile", "component", "block", "radius"))
        x = _matrix(group["centre"], np.float64)
        square = (x * x).sum(1)
        near = square[:, None] + square[None, :] - 2 * (x @ x.T) <= (radius[:, None] + radius[None, :] + reach) ** 2
        near &= component[:, None] < component[None, :]
        if group["i"][0] != group["j"][0]:
            near &= tile[:, None] != tile[None, :]
        a, b = np.nonzero(near)
        for low in range(0, len(a), 100_000):
            u, v = a[low : low + 100_000], b[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in (component[u], block[u], component[v], block[v])], names=["ca", "ba", "cb", "bb"])


def _bridge(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (ca, ba, cb, bb, side, unit), sorted by the first four: the two parts, where a link joins their balls."""
    for group in runs(batches, 4):
        side, x = group["side"].to_numpy(), _matrix(group["unit"], np.float64)
        if (x[side == 0] @ x[side == 1].T >= threshold).any():
            yield pa.RecordBatch.from_arrays([group["ca"][:1].combine_chunks(), group["cb"][:1].combine_chunks()], names=["a", "b"])


def bridged(graph: DataFrame, classes: DataFrame, parts: DataFrame, threshold: float, k: int) -> DataFrame:
    """The parts with those in one that are linked by classes whose lists are saturated."""
    held = cut(saturated(graph, threshold, k).join(parts, "id"))
    blocks = held.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    if blocks.limit(2).count() < 2:
        return parts
    held = held.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).join(classes.select("id", "unit"), "id")
    held = cut(held.select("component", "block", "unit"))
    balls = held.repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(_balls, "component long, block int, centre binary, radius double")
    balls = cut(balls)
    balls = balls.withColumn("dim", (F.octet_length("centre") / 8).cast("int"))
    tiles = balls.groupBy("dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = balls.join(tiles, "dim").withColumn("tile", F.pmod(F.xxhash64("component", "block"), "tiles").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "component", "block", "centre", "radius")
    # Unit vectors with a cosine of at least the threshold are at most so far apart.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    pairs = cut(dealt.repartition("dim", "i", "j").sortWithinPartitions("dim", "i", "j").mapInArrow(lambda batches: _reaching(batches, reach), "ca long, ba int, cb long, bb int"))
    sides = F.array(*(F.struct(F.col(f"c{x}").alias("component"), F.col(f"b{x}").alias("block"), F.lit(n).alias("side")) for n, x in enumerate("ab")))
    met = pairs.withColumn("x", F.explode(sides)).select("ca", "ba", "cb", "bb", "x.*").join(held, ["component", "block"])
    met = met.select("ca", "ba", "cb", "bb", "side", "unit").repartition("ca", "ba", "cb", "bb").sortWithinPartitions("ca", "ba", "cb", "bb")
    joined = cut(met.mapInArrow(lambda batches: _bridge(batches, threshold - 1e-9), "a long, b long"))
    if joined.isEmpty():
        return parts
    whole = components(joined).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    return cut(parts.join(whole, "component", "left").select("id", F.coalesce("whole", "component").alias("component")))


def _passes(counts: Mapping[int, int], done: Mapping[int, int], at: int) -> list[tuple[int, int]]:
    """The next (length, piece) pairs that one pass audits: PIECE classes of lengths that are not done, or one piece more."""
    chosen, rows = [], 0
    for dim, count in counts.items():
        pieces = max(1, count // PIECE)
        for piece in range(done[dim], pieces):
            chosen.append((dim, piece))
            rows += -(-count // pieces)
            if rows >= at:
                return chosen
    return chosen


def missed(classes: DataFrame, parts: DataFrame, threshold: float, audit: int, counts: Mapping[int, int]) -> tuple[float, DataFrame]:
    """(least recall, over the lengths, of the links of audited classes; those of them that lie in no one part)."""
    none = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if not audit:
        return 1.0, none
    # A class without another of its length has no links to audit.
    counts = {dim: count for dim, count in counts.items() if count > 1}
    parted = classes.select("id", "unit", "dim").join(parts, "id", "left").select("id", "unit", "dim", F.coalesce("component", "id").alias("part"))
    sizes = classes.groupBy("dim").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count("*") / PIECE)).alias("pieces"))
    parted = cut(parted.join(F.broadcast(sizes), "dim").select("id", "unit", "part", "dim", F.pmod(F.xxhash64(F.lit(3), "id"), "pieces").alias("piece")))
    done, gone = dict.fromkeys(counts, 0), []
    sums: dict[int, list[float]] = {dim: [0, 0, 0.0] for dim in counts}
    while True:
        short = {dim: count for dim, count in counts.items() if not (sums[dim][1] >= LINKED and sums[dim][0] >= audit)}
        units = _passes(short, done, PIECE)
        if not units:
            break
        for dim, _ in units:
            done[dim] += 1
        pieces = [f"{dim}:{piece}" for dim, piece in units]
        chosen = parted.filter(F.concat_ws(":", "dim", "piece").isin(pieces)).select("id", "unit", "part").toArrow()
        if not chosen.num_rows:
            continue
        ids, part = chosen["id"].to_numpy(), chosen["part"].to_numpy()
        audited = {dim: (ids[places], part[places], x) for dim, places, x in _by_length(chosen["unit"].combine_chunks())}
        shared = classes.sparkSession.sparkContext.broadcast(audited)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 1_000):
                    some = batch.slice(low, 1_000)
                    for dim, places, y in _by_length(some.column(1)):
                        if dim in shared.value:
                            yield _links(some.column(0).to_numpy()[places], some.column(2).to_numpy()[places], y, *shared.value[dim], dim, threshold)

        rows = cut(parted.select("id", "unit", "part").mapInArrow(each, "a long, b long, n long, lost long, dim int"))
        linked = rows.groupBy("dim", "b").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
        for got in linked.groupBy("dim").agg(F.count("*").alias("linked"), F.sum(1 - F.col("lost") / F.col("n")).alias("found")).collect():
            sums[got["dim"]][1] += got["linked"]
            sums[got["dim"]][2] += got["found"]
        for dim, (own, _, _) in audited.items():
            sums[dim][0] += len(own)
        shared.unpersist()
        lost = rows.filter("a is not null").select("a", "b")
        if not lost.isEmpty():
            gone.append(lost)
    recalls = [1.0 if seen >= counts[dim] else found / linked for dim, (seen, linked, found) in sums.items()]
    return min(recalls, default=1.0), reduce(DataFrame.union, gone) if gone else none


def _links(own: np.ndarray, home: np.ndarray, y: np.ndarray, ids: np.ndarray, part: np.ndarray, x: np.ndarray, dim: int, threshold: float) -> pa.RecordBatch:
    """Links of audited classes (ids, part, x) with some classes (own, home, y): those outside their part, and counts."""
    links = (y @ x.T >= threshold) & (own[:, None] != ids[None, :])
    row, column = np.nonzero(links & (home[:, None] != part[None, :]))
    n, lost = links.sum(0), np.bincount(column, minlength=len(ids))
    any_ = n > 0
    zero = np.zeros(len(row), np.int64)
    a = pa.concat_arrays([pa.array(own[row]), pa.nulls(int(any_.sum()), pa.int64())])
    columns = [a, *(pa.array(np.concatenate(v).astype(np.int64)) for v in ((ids[column], ids[any_]), (zero, n[any_]), (zero, lost[any_])))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(a), dim, np.int32))], names=["a", "b", "n", "lost", "dim"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, i, j, block, id, copies, unit), sorted by the first three: links in and between blocks."""
    for group in runs(batches, 3):
        ids, copies, block = (group[name].to_numpy() for name in ("id", "copies", "block"))
        x = _matrix(group["unit"], np.float64)
        links = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
        if group["i"][0] != group["j"][0]:
            links &= block[:, None] != block[None, :]
        count = (links @ copies).astype(np.int64)
        some = count > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(roots(links[np.ix_(some, some)], ids[some])), pa.array(count[some])], names=["id", "root", "links"])


def _found(classes: DataFrame, counts: Mapping[int, int], threshold: float, k: int, tables: int, rounds: int, audit: int, recall: float, enlarged: Sequence[int]) -> DataFrame:
    """(id, links, component) of the linked classes."""

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(v).astype(np.float32).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["id", "vector"])

    narrow = classes.select("id", "unit").mapInArrow(narrowed, "id long, vector binary")
    last = {dim: tables_for(_bits(count), threshold, recall, tables) for dim, count in counts.items()}
    held = max([k, *enlarged])
    graph = widen(None, classes, counts, k, k, tables, {dim: range(n) for dim, n in last.items()})
    extra: list[DataFrame] = []
    for _ in range(TRIES):
        links, size = linked(graph, threshold).count(), k
        for wider in [k, *(x for x in enlarged if x > k)]:
            full = cut(saturated(graph, threshold, size)) if wider > k else None
            if full is not None and full.isEmpty():
                break
            if full is not None:
                graph = widen(graph, classes, counts, wider, held, tables, {dim: range(n) for dim, n in last.items()}, full, threshold)
            for _ in range(rounds):
                # After an audit that failed, lists may be longer already; none is shortened.
                graph = descend(graph, narrow, k, wider if not extra else held, full, threshold)
                now = linked(graph, threshold).count()
                if now == links:
                    break
                links = now
            size = wider
        edges = reduce(DataFrame.union, [linked(graph, threshold), *extra])
        parts = bridged(graph, classes, components(edges), threshold, size)
        reached, gone = missed(classes, parts, threshold, audit, counts)
        if not gone.isEmpty():
            extra.append(gone)
            parts = components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(gone))
        LOG.info("audited recall %.5f with %d tables over %d classes", reached, max(last.values()), sum(counts.values()))
        if reached >= recall:
            break
        graph = widen(graph, classes, counts, k, held, tables, {dim: range(n, n + tables) for dim, n in last.items()})
        last = {dim: n + tables for dim, n in last.items()}
    else:
        raise RuntimeError(f"recall of {reached:.4f} is under {recall} after {TRIES} audits and {max(last.values())} tables")
    sized = parts.join(classes.select("id", "unit", "copies"), "id")
    blocks = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "unit")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    exact = cut(dealt.mapInArrow(lambda batches: _verify(batches, threshold), "id long, root long, links long"))
    groups = components(exact.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return exact.groupBy("id").agg(F.sum("links").alias("links")).join(groups, "id")


def join(rows: DataFrame, threshold: float = THRESHOLD, k: int = K, tables: int = TABLES, rounds: int = ROUNDS, audit: int = AUDIT, recall: float = RECALL, enlarged: Sequence[int] = ENLARGED) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_id of each row."""
    cleaned = cut(clean(rows))
    valid = cleaned.filter("unit is not null")
    heads = valid.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    classes = cut(valid.select("id", "h1", "h2", "dim", "unit").join(heads, ["h1", "h2"]).filter("id = class_id").dropDuplicates(["h1", "h2"]))
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    named = classes.select("h1", "h2", F.col("id").alias("class_id"), "copies")
    if counts:
        found = _found(classes.select("id", "unit", "copies", "dim"), counts, threshold, k, tables, rounds, audit, recall, enlarged)
        named = named.join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    else:
        named = named.withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    full = valid.select("id", "h1", "h2").join(named, ["h1", "h2"])
    full = full.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "class_id").alias("component"), "class_id")
    alone = cleaned.filter("unit is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"), F.col("id").alias("class_id"))
    out = full.union(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"), "class_id")
