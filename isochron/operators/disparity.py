"""Disparities of rectified grey image pairs: census costs and semi-global aggregation along four directions.

A pixel's census is one bit for each neighbour of a 7 x 7 window: is it darker. The cost of a disparity is the number of
different bits of the left pixel and the right one so far to its left. Costs are added up along rows and columns in both
directions, with a small penalty for a step of one and a large one for more, and the least sum wins; its place between whole
disparities is that of a parabola through its neighbours. Images are cut into strips of rows, each with a margin of rows
above and below that takes part in the sums, so a task holds a strip, or several small ones of one size. A disparity is kept only where the right image's own
best one agrees; elsewhere it is null, as it is where the window or the search leaves the picture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.operators import ordering

RADIUS, STRIP, MARGIN, PIXELS = 3, 96, 24, 1 << 15
SMALL, LARGE = 6, 32


def census(image: np.ndarray) -> np.ndarray:
    """Bits of each pixel's window; beyond the picture its edge goes on. So in all functions here: one picture, or several at once."""
    wide = np.pad(image, [(0, 0)] * (image.ndim - 2) + [(RADIUS, RADIUS)] * 2, mode="edge")
    out = np.zeros(image.shape, np.uint64)
    tall, across = image.shape[-2:]
    for dy in range(2 * RADIUS + 1):
        for dx in range(2 * RADIUS + 1):
            if (dy, dx) != (RADIUS, RADIUS):
                out = (out << np.uint64(1)) | (wide[..., dy : dy + tall, dx : dx + across] < image).astype(np.uint64)
    return out


def costs(left: np.ndarray, right: np.ndarray, search: int) -> np.ndarray:
    """(rows, columns, search) different bits; the largest cost where the right picture has no such pixel."""
    a, b = census(left), census(right)
    out = np.full((*left.shape, search), (2 * RADIUS + 1) ** 2, np.int32)
    for d in range(min(search, left.shape[-1])):
        out[..., d:, d] = np.bitwise_count(a[..., d:] ^ b[..., : b.shape[-1] - d])
    return out


def _along(cost: np.ndarray) -> np.ndarray:
    """Sums of the cheapest paths that come along the first axis to each place."""
    out = np.empty_like(cost)
    out[0] = cost[0]
    for k in range(1, len(cost)):
        before = out[k - 1]
        least = before.min(-1, keepdims=True)
        best = np.minimum(before, least + LARGE)
        best[..., 1:] = np.minimum(best[..., 1:], before[..., :-1] + SMALL)
        best[..., :-1] = np.minimum(best[..., :-1], before[..., 1:] + SMALL)
        out[k] = cost[k] + best - least
    return out


def aggregated(cost: np.ndarray) -> np.ndarray:
    down, across = (np.moveaxis(cost, axis, 0) for axis in (-3, -2))
    both = lambda c, axis: np.moveaxis(_along(c) + _along(c[::-1])[::-1], 0, axis)
    return both(down, -3) + both(across, -2)


def matched(left: np.ndarray, right: np.ndarray, search: int) -> np.ndarray:
    """Disparities of the left picture's pixels; no number where the two sides disagree by more than one."""
    total = aggregated(costs(left, right, search))
    best = total.argmin(-1)
    columns = np.broadcast_to(np.arange(left.shape[-1]), best.shape)
    of = lambda values, at: np.take_along_axis(values, at[..., None], -1)[..., 0]
    # The right picture's best: of its pixel, the sums of the left pixels that look at it.
    theirs = np.full(total.shape, np.iinfo(np.int32).max, np.int32)
    for d in range(min(search, left.shape[-1])):
        theirs[..., : left.shape[-1] - d, d] = total[..., d:, d]
    back = theirs.argmin(-1)
    at = columns - best
    agrees = (at >= 0) & (np.abs(np.take_along_axis(back, np.maximum(at, 0), -1) - best) <= 1)
    low, mid, high = (of(total, np.clip(best + k, 0, search - 1)).astype(float) for k in (-1, 0, 1))
    bend = low - 2 * mid + high
    shift = np.where((best > 0) & (best < search - 1) & (bend > 0), (low - high) / np.where(bend > 0, 2 * bend, 1), 0.0)
    return np.where(agrees & (columns >= RADIUS) & (columns < left.shape[-1] - RADIUS), best + shift, np.nan)


def disparities(pairs: DataFrame, search: int = 64) -> DataFrame:
    """The pairs without their pictures, a row for each strip: row (its first), rows, disparity (binary 32-bit floats).

    pairs: any columns, and width, height, left_pixels and right_pixels (bytes row by row). No number means no disparity.
    """
    if search < 2:
        raise ValueError("a search of at least two disparities")
    keys = [c for c in pairs.columns if c not in ("left_pixels", "right_pixels")]
    strips = F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)), F.lit(STRIP))
    low = F.greatest(F.col("row") - MARGIN, F.lit(0))
    high = F.least(F.col("row") + STRIP + MARGIN, F.col("height"))
    cut = lambda c: F.substring(c, low * F.col("width") + 1, (high - low) * F.col("width")).alias(c)
    # Pictures that are null are left out by the tasks: a filter would draw each picture once more, where they are computed.
    dealt = pairs.filter("width > 0 and height > 0").withColumn("row", F.explode(strips))
    # Strips are dealt anew, so that a few large pictures, or a small file of many, keep many tasks busy.
    dealt = ordering.dealt(dealt.select(*keys, "row", low.alias("low"), cut("left_pixels"), cut("right_pixels")), *keys[:1], "row")
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys), "row int, rows int, disparity binary"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_pylist() for c in ("width", "height", "row", "low")]
            pictures = batch.column("left_pixels").to_pylist(), batch.column("right_pixels").to_pylist()
            alike: dict[tuple, list[int]] = {}
            for k, size in enumerate(zip(*sizes, strict=True)):
                if pictures[0][k] is not None and pictures[1][k] is not None:
                    alike.setdefault(size, []).append(k)
            for (width, height, first, low), places in alike.items():
                n, tall = min(STRIP, height - first), len(pictures[0][places[0]]) // width
                # Strips of one size together, as many as hold about PIXELS.
                most = max(PIXELS // (width * tall), 1)
                for at in (places[k : k + most] for k in range(0, len(places), most)):
                    left, right = (np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), tall, width) for side in pictures)
                    found = matched(left, right, search)[:, first - low :][:, :n].astype("<f4")
                    some = batch.select(keys).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([first] * len(at), pa.int32()), pa.array([n] * len(at), pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], names=[*keys, "row", "rows", "disparity"])

    return dealt.mapInArrow(each, schema)
