"""Depth images fused into hashed blocks of voxels, and the surface of a block's zero crossings.

A voxel holds the mean of the truncated signed distances that depth images give it along their viewing direction. Space is
cut into blocks of BLOCK voxels a side, of which only those near a measured point exist. A task turns an image into sums
for the blocks it sees, adding up those of the images that it reads one after the other (at most HELD blocks at a time), and
the sums of a block are added by its key, ROWS blocks at a time. Sums are whole numbers, so no order of addition shows. For
the surface each block is joined by the first layers of its neighbours, which alone are sent to it, and its cubes are cut into six tetrahedra, in each of which the zero of a
linear function is a triangle or two.

Defined results: depths that are null, zero, negative or no number measure nothing; an image without pixels gives no
blocks; voxels that no image saw have weight 0 and no surface beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.operators import ordering

BLOCK, HELD, UNIT, ROWS = 8, 2_048, 1_000_000, 1_024
_inside = np.stack(np.meshgrid(*[np.arange(BLOCK)] * 3, indexing="ij"), -1).reshape(-1, 3)
#: The corners of a cube's six tetrahedra: the paths along its edges from one end of a diagonal to the other.
TETRAHEDRA = [[0, a, a | b, 7] for a in (1, 2, 4) for b in (1, 2, 4) if a != b]
_corner = np.array([[k & 1, k >> 1 & 1, k >> 2 & 1] for k in range(8)])


def touched(depth: np.ndarray, lens: tuple[float, float, float, float], pose: np.ndarray, voxel: float, reach: float) -> np.ndarray:
    """Numbers (n, 3) of the blocks that hold a point within `reach` of a measured one along its ray."""
    v, u = np.nonzero(depth > 0)
    if not len(u):
        return np.empty((0, 3), np.int64)
    z = depth[v, u]
    fx, fy, cx, cy = lens
    steps = np.arange(-reach, reach + voxel / 2, min(voxel * BLOCK / 2, reach))
    at = (z[:, None] + np.append(steps, reach)[None, :]).ravel()
    x, y = np.repeat((u - cx) / fx, len(steps) + 1) * at, np.repeat((v - cy) / fy, len(steps) + 1) * at
    points = np.column_stack([x, y, at])[at > 0] @ pose[:3, :3].T + pose[:3, 3]
    blocks = np.floor(points / (voxel * BLOCK)).astype(np.int64)
    low = blocks.min(0)
    size = blocks.max(0) - low + 1
    if size.astype(float).prod() >= 2.0**62:  # too far apart to be numbered in a box
        return np.unique(blocks, axis=0)
    place = np.unique(np.ravel_multi_index((blocks - low).T, size))
    return np.column_stack(np.unravel_index(place, size)) + low


def distances(blocks: np.ndarray, depth: np.ndarray, lens: tuple[float, float, float, float], pose: np.ndarray, voxel: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(sums, weights), (n, BLOCK**3) whole numbers, of one image for these blocks."""
    centres = ((blocks[:, None, :] * BLOCK + _inside[None, :, :]) + 0.5) * voxel
    seen = (centres - pose[:3, 3]) @ pose[:3, :3]
    fx, fy, cx, cy = lens
    ahead = seen[..., 2] > 1e-9
    z = np.where(ahead, seen[..., 2], 1.0)
    u, v = np.rint(fx * seen[..., 0] / z + cx).astype(np.int64), np.rint(fy * seen[..., 1] / z + cy).astype(np.int64)
    tall, wide = depth.shape
    inside = ahead & (u >= 0) & (v >= 0) & (u < wide) & (v < tall)
    measured = np.where(inside, depth[np.where(inside, v, 0), np.where(inside, u, 0)], 0.0)
    far = measured - z
    known = inside & (measured > 0) & (far >= -reach)
    return np.where(known, np.rint(np.clip(far / reach, -1, 1) * UNIT), 0).astype(np.int64), known.astype(np.int64)


def fused(images: DataFrame, voxel: float, reach: float | None = None, key: str = "take") -> DataFrame:
    """(key, bx, by, bz, distance array<double> in voxels' lengths, weight array<long>) of the blocks that images see.

    images: key, width, height, depth (binary, 32-bit floats in metres, row by row), lens (fx, fy, cx, cy), pose (4x4, the
    camera's frame in the world's). Truncation at `reach`, four voxels unless given.
    """
    reach = 4 * voxel if reach is None else reach
    kind = images.schema[key].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        type_of = None

        def flushed() -> pa.RecordBatch:
            keys = list(held)
            packed = [pa.array([v[k].tobytes() for v in held.values()], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], type_of), *(pa.array([k[i] for k in keys], pa.int64()) for i in (1, 2, 3)), *packed], names=[key, "bx", "by", "bz", "d", "w"])

        for batch in batches:
            type_of = batch.schema.field(key).type
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["depth"] is None or not row["width"] or not row["height"]:
                    continue
                depth = np.nan_to_num(np.frombuffer(row["depth"], "<f4").reshape(row["height"], row["width"]).astype(float), posinf=0.0)
                lens, pose = tuple(row["lens"]), np.array(row["pose"], float)
                blocks = touched(depth, lens, pose, voxel, reach)
                for low in range(0, len(blocks), 256):
                    some = blocks[low : low + 256]
                    for at, d, w in zip(some.tolist(), *distances(some, depth, lens, pose, voxel, reach), strict=True):
                        if w.any():
                            own = held.setdefault((row[key], *at), [np.zeros(BLOCK**3, np.int64), np.zeros(BLOCK**3, np.int64)])
                            own[0] += d
                            own[1] += w
                    if len(held) >= HELD:
                        yield flushed()
                        held.clear()
        if held:
            yield flushed()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "bx", "by", "bz"]
        for whole in _runs(batches, names):
            first = _firsts(whole, names)
            d, w = (np.add.reduceat(_matrix(whole.column(c), np.int64), first) for c in ("d", "w"))
            mean = np.where(w > 0, d / np.maximum(w, 1) / UNIT * (reach / voxel), 0.0)
            kept = whole.select(names).take(pa.array(first))
            at = pa.array(np.arange(len(first) + 1, dtype=np.int32) * BLOCK**3)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (mean, w))], names=[*names, "distance", "weight"])

    # Images are dealt anew, those of a place together, so that a small file of many images keeps many tasks busy.
    dealt = ordering.dealt(images.select(key, "width", "height", "depth", "lens", "pose"), key, "pose")
    made = dealt.mapInArrow(sums, f"{key} {kind}, bx long, by long, bz long, d binary, w binary")
    return _together(made, [key, "bx", "by", "bz"]).mapInArrow(added, f"{key} {kind}, bx long, by long, bz long, distance array<double>, weight array<long>")


def _together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key in one task, one after the other."""
    return ordering.dealt(rows, *keys).sortWithinPartitions(*keys)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches of at most about ROWS that end where a key does, so a key's rows stand in one batch."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            batch = whole.slice(low, ROWS)
            ends = _firsts(batch, names)
            # The batch's last key may go on; what comes before it is whole, as what is held is if its key ends here.
            last = int(ends[-1])
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names):
                yield _joined(held)
                held = []
            if last:
                yield _joined([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _firsts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Places of the rows whose key is not that of the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def crossings(distance: np.ndarray, weight: np.ndarray, least: int = 1) -> np.ndarray:
    """Triangles (n, 3, 3) of the zero surface in a grid of values at whole places, on cubes whose corners are all known."""
    return _crossed(distance[None], weight[None] >= least)[1]


def _crossed(distance: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grid, triangle) numbers (n,) and (n, 3, 3) of several grids at once, (g, x, y, z) values and whether they are known."""
    n = np.array(distance.shape[1:]) - 1
    if (n < 1).any() or not len(distance):
        return np.empty(0, np.int64), np.empty((0, 3, 3))
    part = lambda x, k: x[:, k & 1 : n[0] + (k & 1), k >> 1 & 1 : n[1] + (k >> 1 & 1), k >> 2 : n[2] + (k >> 2)]
    below, above, use = np.zeros((len(distance), *n), bool), np.zeros((len(distance), *n), bool), np.ones((len(distance), *n), bool)
    negative, positive = distance < 0, distance >= 0
    for k in range(8):
        below |= part(negative, k)
        above |= part(positive, k)
        use &= part(known, k)
    grid, *base = np.nonzero(use & below & above)
    at = np.stack(base, -1)[:, None, :] + _corner[None, :, :]
    values = distance[grid[:, None], at[..., 0], at[..., 1], at[..., 2]]
    at = at.astype(float)
    own = []
    found = []
    for corners in TETRAHEDRA:
        p, v = at[:, corners], values[:, corners]
        order = np.argsort(v, 1, kind="stable")
        p, v = np.take_along_axis(p, order[..., None], 1), np.take_along_axis(v, order, 1)
        below = (v < 0).sum(1)
        cut = lambda some, i, j: p[some, i] + (p[some, j] - p[some, i]) * (v[some, i] / (v[some, i] - v[some, j]))[:, None]  # noqa: B023, E731
        one, two, three = (np.flatnonzero(below == k) for k in (1, 2, 3))
        found.append(np.stack([cut(one, 0, k) for k in (1, 2, 3)], 1))
        found.append(np.stack([cut(three, k, 3) for k in (0, 1, 2)], 1))
        own += [grid[one], grid[three], grid[two], grid[two]]
        a, b, c, d = cut(two, 0, 2), cut(two, 0, 3), cut(two, 1, 2), cut(two, 1, 3)
        found += [np.stack([a, b, c], 1), np.stack([b, c, d], 1)]
    return np.concatenate(own), np.concatenate(found)


def surface(blocks: DataFrame, voxel: float, least: int = 1, key: str = "take") -> DataFrame:
    """(key, bx, by, bz, x0, y0, z0, .. z2) of the zero surface's triangles, in metres; at least `least` views a voxel."""
    field = blocks.schema[key].dataType.simpleString()
    names = [key, "bx", "by", "bz"]

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block is the neighbour, by (ox, oy, oz), of the block that many numbers before it, which needs its first layers.
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                distance, weight = (batch.column(c).flatten().to_numpy().reshape(-1, BLOCK, BLOCK, BLOCK) for c in ("distance", "weight"))
                for o, (ox, oy, oz) in enumerate(_corner.tolist()):
                    of = (slice(None), *(slice(0, 1) if k else slice(None) for k in (ox, oy, oz)))
                    known = weight[of].reshape(len(weight), -1) >= least
                    # What is not known counts as nothing, so it need not travel.
                    at = np.flatnonzero(known.any(1))
                    values = np.ascontiguousarray(distance[of]).reshape(len(weight), -1)
                    kept = batch.select(names).take(pa.array(at))
                    moved = [pa.array(kept.column(f"b{a}").to_numpy() - k) for a, k in zip("xyz", (ox, oy, oz), strict=True)]
                    packed = [pa.array([x.tobytes() for x in some[at]], pa.binary()) for some in (values, known)]
                    yield pa.RecordBatch.from_arrays([kept.column(0), *moved, pa.array(np.full(len(at), o, np.int32)), *packed], names=[*names, "o", "distance", "known"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _runs(batches, names):
            first = _firsts(whole, names)
            block = np.repeat(np.arange(len(first)), np.diff(np.append(first, whole.num_rows)))
            grid, known = np.zeros((len(first), *[BLOCK + 1] * 3)), np.zeros((len(first), *[BLOCK + 1] * 3), bool)
            which = whole.column("o").to_numpy()
            for o, corner in enumerate(_corner.tolist()):
                at = np.flatnonzero(which == o)
                if len(at):
                    to = (block[at], *(slice(BLOCK, BLOCK + 1) if k else slice(0, BLOCK) for k in corner))
                    shape = (len(at), *(1 if k else BLOCK for k in corner))
                    some = whole.select(["distance", "known"]).take(pa.array(at))
                    grid[to], known[to] = _matrix(some.column(0), np.float64).reshape(shape), _matrix(some.column(1), np.bool_).reshape(shape)
            # A block that is not there itself has no known voxels and so no cubes.
            own, found = _crossed(grid, known)
            head = whole.select(names).take(pa.array(first[own]))
            start = np.column_stack([head.column(f"b{a}").to_numpy() for a in "xyz"])[:, None, :] * BLOCK
            placed = (found + start + 0.5) * voxel
            yield pa.RecordBatch.from_arrays([*head.columns, *(pa.array(np.ascontiguousarray(placed[:, n, i])) for n in range(3) for i in range(3))], names=[*names, *(f"{a}{n}" for n in range(3) for a in "xyz")])

    points = ", ".join(f"{a}{n} double" for n in range(3) for a in "xyz")
    spread = blocks.select(*names, "distance", "weight").mapInArrow(lent, f"{key} {field}, bx long, by long, bz long, o int, distance binary, known binary")
    return _together(spread, names).mapInArrow(each, f"{key} {field}, bx long, by long, bz long, {points}")


def ply_pieces(triangles: DataFrame, key: str = "take") -> DataFrame:
    """Triangles as pieces of PLY files, one for each key, for formats.save: a header, vertices and faces in binary.

    Each triangle has its own three vertices. Its number, which its face names, is its place among the key's triangles.
    """
    names = [f"{a}{n}" for n in range(3) for a in "xyz"]
    placed = ordering.ranked(triangles.select(key, *names), [key], names)
    sizes = placed.groupBy(key).agg(F.count("*").alias("n"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.column_stack([batch.column(c).to_numpy() for c in names]).astype("<f4")
            faces = np.zeros(batch.num_rows, np.dtype([("n", "u1"), ("at", "<i4", (3,))]))
            faces["n"], faces["at"] = 3, batch.column("rank").to_numpy()[:, None] * 3 + np.arange(3)
            rank = batch.column("rank").to_numpy()
            for stage, contents in ((1, [p.tobytes() for p in points]), (2, [f.tobytes() for f in faces])):
                yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.string()), pa.array(np.zeros(len(rank), np.int32)), pa.array(rank + stage * (1 << 48)), pa.array(contents, pa.binary())], names=["recording_id", "part", "seq", "content"])

    head = F.format_string("ply\nformat binary_little_endian 1.0\nelement vertex %d\nproperty float x\nproperty float y\nproperty float z\nelement face %d\nproperty list uchar int vertex_indices\nend_header\n", 3 * F.col("n"), F.col("n"))
    front = sizes.select(F.col(key).cast("string").alias("recording_id"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), head.cast("binary").alias("content"))
    return front.unionByName(placed.mapInArrow(each, "recording_id string, part int, seq long, content binary"))
