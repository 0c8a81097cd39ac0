"""Orientation fusion: turn rates alone as a scan that is parallel over time, filters sequential per recording in sorted Arrow
batches with a carried state."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geometry

#: Steps of time outside (0, MAX_STEP] hold the state; the filter's gain.
MAX_STEP, GAIN = 0.5, 0.08


def _half(along: float, across: float) -> tuple[float, float]:
    """Cosine and sine of half the angle from the first axis to (along, across), by the half-angle identities."""
    length = math.hypot(along, across)
    if not length:
        return 1.0, 0.0
    larger = math.sqrt((1 + abs(along) / length) / 2)
    smaller = abs(across) / (2 * length * larger)
    c, s = (larger, smaller) if along >= 0 else (smaller, larger)
    return c, math.copysign(s, across)


def seeded(accel: np.ndarray) -> tuple[float, float, float, float]:
    """Level attitude (w, x, y, z) of a resting accelerometer; identity where it reads nothing.

    Two turns level it: one about x takes the reading into the plane of x and z, one about y takes it up. None is about z.
    """
    right, forward, up = (float(a) for a in accel)
    if math.sqrt(right * right + forward * forward + up * up) <= 1e-6:
        return 1.0, 0.0, 0.0, 0.0
    about_x, about_y = _half(up, forward), _half(math.hypot(forward, up), -right)
    return tuple(_times(np.array([about_y[0], 0.0, about_y[1], 0.0]), np.array([about_x[0], about_x[1], 0.0, 0.0])).tolist())


def _gravity_pull(q: Sequence[float], up: Sequence[float]) -> list[float]:
    """Gradient by q of half the squared error of the predicted upward direction: its Jacobian, transposed, times the error."""
    w, x, y, z = q
    predicted = (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))
    jacobian = ((-2 * y, 2 * z, -2 * w, 2 * x), (2 * x, 2 * w, 2 * z, 2 * y), (0.0, -4 * x, -4 * y, 0.0))
    error = [p - m for p, m in zip(predicted, up, strict=True)]
    return [sum(e * row[k] for e, row in zip(error, jacobian, strict=True)) for k in range(4)]


def _unit(v: Sequence[float], least: float = 0.0) -> list[float] | None:
    """The vector at length one; None where it is not longer than `least`."""
    length = math.sqrt(math.fsum(x * x for x in v))
    return [x / length for x in v] if length > least else None


def _advanced(q: Sequence[float], dt: float, accel: Sequence[float], gyro: Sequence[float], gain: float) -> list[float]:
    """One step on (w, x, y, z): half the product of q and the turn rate, less the gain along the pull of gravity."""
    w, (x, y, z), (p, r, s) = q[0], q[1:], gyro
    speed = [-(x * p + y * r + z * s) / 2, (w * p + y * s - z * r) / 2, (w * r + z * p - x * s) / 2, (w * s + x * r - y * p) / 2]
    up = _unit(accel, 1e-9)
    pull = _unit(_gravity_pull(q, up), 1e-9) if up else None
    moved = [a + dt * (v - gain * g) for a, v, g in zip(q, speed, pull or (0.0,) * 4, strict=True)]
    return _unit(moved)


def gradient_filter(t_ns: np.ndarray, accel: np.ndarray, gyro: np.ndarray, gain: float = GAIN, before: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Attitudes (x, y, z, w) by gyro integration with a gradient step towards gravity; `before`: time and attitude to go on from."""
    out = np.empty((len(t_ns), 4))
    if not len(t_ns):
        return out
    q = seeded(accel[0]) if before is None else (before[1][3], *before[1][:3])
    steps = np.diff(t_ns, prepend=t_ns[:1] if before is None else before[0]) / 1e9
    for k, (dt, a, g) in enumerate(zip(steps.tolist(), accel.tolist(), gyro.tolist(), strict=True)):
        if 0 < dt <= MAX_STEP:
            q = _advanced(q, dt, a, g, gain)
        out[k] = (q[1], q[2], q[3], q[0])
    return out


def gyro_only(t_ns: np.ndarray, gyro: np.ndarray, before: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Attitudes (x, y, z, w) from identity by turning by rate times step; turns below 1e-10 hold."""
    q = np.array([1.0, 0.0, 0.0, 0.0]) if before is None else np.asarray(before[1])[[3, 0, 1, 2]]
    out = np.empty((len(t_ns), 4))
    steps = np.diff(t_ns, prepend=t_ns[:1] if before is None else before[0]) / 1e9
    for k in range(len(t_ns)):
        turn = gyro[k] * steps[k]
        angle = float(np.sqrt(turn @ turn))
        if 0 < steps[k] <= MAX_STEP and np.isfinite(angle) and angle >= 1e-10:
            c, (x, y, z) = math.cos(angle / 2), turn * (math.sin(angle / 2) / angle)
            w0, x0, y0, z0 = q
            q = np.array([w0 * c - x0 * x - y0 * y - z0 * z, w0 * x + x0 * c + y0 * z - z0 * y, w0 * y - x0 * z + y0 * c + z0 * x, w0 * z + x0 * y - y0 * x + z0 * c])
            q /= np.sqrt(q @ q)
        out[k] = (q[1], q[2], q[3], q[0])
    return out


def products(turns: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Running products of quaternions (w, x, y, z), each segment from its row of place 0 on, by doubling: log n passes."""
    out, reach = turns.copy(), 1
    while reach <= places.max(initial=0):
        at = np.flatnonzero(places >= reach)
        out[at] = _hamilton(out[at - reach], out[at])
        reach *= 2
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _hamilton(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of quaternions (w, x, y, z)."""
    w, v, u, r = a[:, :1], a[:, 1:], b[:, :1], b[:, 1:]
    return np.hstack([w * u - (v * r).sum(1, keepdims=True), w * r + u * v + np.cross(v, r)])


def turned(dt: np.ndarray, gyro: np.ndarray) -> np.ndarray:
    """The turn (w, x, y, z) of each step; steps outside (0, MAX_STEP] and turns below 1e-10 are none."""
    turn = gyro * dt[:, None]
    angle = np.sqrt((turn * turn).sum(1))
    go = (dt > 0) & (dt <= MAX_STEP) & np.isfinite(angle) & (angle >= 1e-10)
    safe = np.where(go, angle, 1.0)
    out = np.hstack([np.cos(safe / 2)[:, None], turn * (np.sin(safe / 2) / safe)[:, None]])
    out[~go] = (1.0, 0.0, 0.0, 0.0)
    return out


def gyro_scan(samples: DataFrame, keys: Sequence[str] = ("recording_id",), block_ns: int = 10_000_000_000) -> DataFrame:
    """The attitudes of `gyro_only` for all samples, as an associative scan: a recording's blocks of time are independent.

    Each block multiplies its own turns up from identity, knowing the last time before it; the blocks' products, one row
    for each, are multiplied up along each recording; each sample's attitude is its block's start times its own. Two
    shuffles by (recording, block) and none of a recording as a whole.
    """
    rows = samples.select(*keys, "ts_ns", *(F.col(f"gyro.{a}").cast("double").alias(f"g{a}") for a in "xyz"))
    rows = rows.withColumn("block", F.expr(f"(ts_ns - pmod(ts_ns, {block_ns}L)) div {block_ns}L"))
    edges = rows.groupBy(*keys, "block").agg(F.max("ts_ns").alias("last")).select(*(F.col(k).alias(f"edge_{k}") for k in keys), F.col("block").alias("edge_block"), F.lag("last").over(W.partitionBy(*keys).orderBy("block")).alias("before_ns"))
    same = F.col("block") == F.col("edge_block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"edge_{k}"))
    known = rows.join(edges, same).select(*rows.columns, "before_ns")
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "block", "ts_ns", *TURN]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, state = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "block")), strict=True))
            first = np.array([own[0] != held, *(a != b for a, b in itertools.pairwise(own))])
            t = batch.column("ts_ns").to_numpy()
            known = np.array([b is not None for b in batch.column("before_ns").to_pylist()])
            earlier = np.concatenate([[last], t[:-1]])
            prior = batch.column("before_ns").fill_null(0).to_numpy()
            earlier = np.where(first, np.where(known, prior, t), earlier)
            gyro = np.nan_to_num(np.column_stack([batch.column(f"g{a}").to_pandas().to_numpy(float, na_value=np.nan) for a in "xyz"]))
            turns = turned((t - earlier) / 1e9, gyro)
            if not first[0]:
                turns[0] = _hamilton(state[None], turns[:1])[0]
            at = np.arange(n)
            places = at - np.maximum.accumulate(np.where(first | (at == 0), at, 0))
            q = products(turns, places)
            held, last, state = own[-1], int(t[-1]), q[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "block", "ts_ns")), *(pa.array(q[:, k]) for k in (1, 2, 3, 0))], names=names)

    dealt = known.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "ts_ns", "gx", "gy", "gz")
    inside = dealt.mapInArrow(local, f"{kinds}, block long, ts_ns long, qx double, qy double, qz double, qw double")
    # The rows of a block's last time: its last row's product holds all of its turns, as rows of one time turn nothing more.
    ends = inside.groupBy(*keys, "block").agg(F.max_by(F.struct(*TURN), F.struct("ts_ns")).alias("q"))

    def along(table: pa.Table) -> pa.Table:
        group = table.sort_by("block")
        flat = group["q"].combine_chunks()
        own = np.column_stack([flat.field(c).to_numpy() for c in ("qw", "qx", "qy", "qz")])
        up = products(own, np.arange(len(own)))
        start = np.vstack([[1.0, 0.0, 0.0, 0.0], up[:-1]])
        return pa.table({**{f"start_{k}": group[k] for k in keys}, "start_block": group["block"], **{f"start_{c}": start[:, k] for c, k in (("qx", 1), ("qy", 2), ("qz", 3), ("qw", 0))}})

    starts = ends.groupBy(*keys).applyInArrow(along, ", ".join([*(f"start_{k} {samples.schema[k].dataType.simpleString()}" for k in keys), "start_block long", *(f"start_{c} double" for c in TURN)]))
    same = F.col("block") == F.col("start_block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"start_{k}"))
    q = geometry.unit(geometry.multiply(geometry.quat(*(F.col(f"start_{c}") for c in TURN)), geometry.quat(*(F.col(c) for c in TURN))))
    out = inside.join(starts, same).select(*keys, "ts_ns", q.alias("q"))
    return out.select(*keys, "ts_ns", *(F.col(f"q.{c[1]}").alias(c) for c in TURN))


def slerped(t: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Attitudes at times, on the shorter arc between the ones around them, clamped at both ends."""
    at = np.clip(at, t[0], t[-1])
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, max(len(t) - 2, 0))
    if len(t) == 1:
        return np.repeat(q, len(at), 0)
    share = ((at - t[k]) / np.maximum(t[k + 1] - t[k], 1))[:, None]
    a, b = q[k], q[k + 1]
    dot = (a * b).sum(1, keepdims=True)
    b, dot = np.where(dot < 0, -b, b), np.minimum(np.abs(dot), 1.0)
    angle = np.arccos(dot)
    near = np.sin(angle) < 1e-6
    safe = np.where(near, 1.0, np.sin(angle))
    out = np.where(near, (1 - share) * a + share * b, (np.sin((1 - share) * angle) * a + np.sin(share * angle) * b) / safe)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def marg_filter(t_ns: np.ndarray, accel: np.ndarray, gyro: np.ndarray, mag: np.ndarray | None, gain: float = 0.041, max_samples: int | None = None) -> np.ndarray:
    """Nine-axis attitudes where a magnetometer reads, else six-axis ones.

    The gradient adds, to gravity's, the direction of the horizontal field. With max_samples, long inputs are strided
    (the last row is kept) and the attitudes between are interpolated: that loses detail and is never done unasked.
    """
    n = len(t_ns)
    if not n:
        return np.empty((0, 4))
    if max_samples and n > max_samples:
        kept = np.unique(np.append(np.arange(0, n, n // max_samples), n - 1))
        part = marg_filter(t_ns[kept], accel[kept], gyro[kept], None if mag is None else mag[kept], gain)
        return slerped(t_ns[kept].astype(float), part, t_ns.astype(float))
    if mag is None or not np.any(mag):
        return gradient_filter(t_ns, accel, gyro, gain)
    w, x, y, z = seeded(accel[0])
    east = _heading(np.array([w, x, y, z]), mag[0])
    half = -east / 2
    q = _times(np.array([math.cos(half), 0.0, 0.0, math.sin(half)]), np.array([w, x, y, z]))
    out = np.empty((n, 4))
    steps = np.diff(t_ns, prepend=t_ns[:1]) / 1e9
    for k in range(n):
        dt = steps[k]
        if 0 < dt <= MAX_STEP and np.isfinite(gyro[k]).all():
            rate = 0.5 * _times(q, np.array([0.0, *gyro[k]]))
            a, m = accel[k], mag[k]
            la, lm = np.sqrt(a @ a), np.sqrt(m @ m)
            if la > 1e-9 and lm > 1e-9:
                s = _field_gradient(q, a / la, m / lm)
                ls = np.sqrt(s @ s)
                if ls > 1e-9:
                    rate = rate - gain * s / ls
            q = q + rate * dt
            q = q / np.sqrt(q @ q)
        out[k] = (q[1], q[2], q[3], q[0])
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([a[0] * b[0] - a[1:] @ b[1:], *(a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:]))])


def _turn(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def _heading(q: np.ndarray, m: np.ndarray) -> float:
    level = _turn(q) @ m
    return math.atan2(level[1], level[0])


def _field_gradient(q: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Gradient by q of half the squared errors of predicted gravity (up) and field (its own dip, no east part)."""
    h = _turn(q) @ m
    field = np.array([math.hypot(h[0], h[1]), 0.0, h[2]])
    w, x, y, z = q
    # Derivatives of the rotation matrix by w, x, y, z.
    parts = np.array([
        [[0, -2 * z, 2 * y], [2 * z, 0, -2 * x], [-2 * y, 2 * x, 0]],
        [[0, 2 * y, 2 * z], [2 * y, -4 * x, -2 * w], [2 * z, 2 * w, -4 * x]],
        [[-4 * y, 2 * x, 2 * w], [2 * x, 0, 2 * z], [-2 * w, 2 * z, -4 * y]],
        [[-4 * z, -2 * w, 2 * x], [2 * w, -4 * z, 2 * y], [2 * x, 2 * y, 0]],
    ])
    r = _turn(q)
    out = np.zeros(4)
    for reference, measured in ((np.array([0.0, 0.0, 1.0]), a), (field, m)):
        error = r.T @ reference - measured
        out += np.array([(p.T @ reference) @ error for p in parts])
    return out


def _per_recording(samples: DataFrame, keys: Sequence[str], fuse: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """One attitude for each sample, from a recording's whole table."""
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)

    def each(table: pa.Table) -> pa.Table:
        group = table.sort_by("ts_ns")
        q = fuse(group)
        return pa.table({**{k: group[k] for k in keys}, "ts_ns": group["ts_ns"], **{n: pa.array(q[:, i]) for i, n in enumerate(TURN)}})

    return samples.groupBy(*keys).applyInArrow(each, f"{kinds}, ts_ns long, qx double, qy double, qz double, qw double")


TURN = ("qx", "qy", "qz", "qw")


def _in_order(samples: DataFrame, keys: Sequence[str], order: Sequence[str], fuse: Callable[[pa.RecordBatch, tuple | None], np.ndarray]) -> DataFrame:
    """One attitude for each sample; rows come sorted, a batch at a time, and the last time and attitude are carried on.

    The state is sequential, so a recording stays in one task, but no more of it than a batch is in memory.
    """
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "ts_ns", *TURN]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, before = None, None
        for batch in batches:
            held = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            edges = [0, *(k for k in range(1, len(held)) if held[k] != held[k - 1]), len(held)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                q = fuse(part, before if held[low] == last_key else None)
                last_key, before = held[low], (part.column("ts_ns")[-1].as_py(), q[-1])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keys))), part.column("ts_ns"), *(pa.array(q[:, i]) for i in range(4))], names=names)

    dealt = samples.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(each, f"{kinds}, ts_ns long, qx double, qy double, qz double, qw double")


def _axes(group: pa.Table, name: str) -> np.ndarray:
    flat = group.column(name)
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    flat = flat.flatten()
    return np.nan_to_num(np.column_stack([flat[k].to_numpy(zero_copy_only=False).astype(float) for k in range(3)]))


def attitudes(samples: DataFrame, keys: Sequence[str] = ("recording_id",), mode: str = "gravity", gain: float | None = None, max_samples: int | None = None) -> DataFrame:
    """Attitudes of accel, gyro (and mag) samples: mode gravity, gyro or field."""
    if mode == "gyro":
        return gyro_scan(samples, keys)
    columns = ["ts_ns", "gyro", "accel", *(["mag"] if mode == "field" else [])]
    samples = samples.select(*keys, *columns)
    if mode == "field":  # whether a magnetometer reads, and the stride, depend on the whole recording
        return _per_recording(samples, keys, lambda group: marg_filter(group["ts_ns"].to_numpy(), _axes(group, "accel"), _axes(group, "gyro"), _axes(group, "mag"), gain or 0.041, max_samples))

    def fuse(part: pa.RecordBatch, before: tuple | None) -> np.ndarray:
        t = part.column("ts_ns").to_numpy()
        return gradient_filter(t, _axes(part, "accel"), _axes(part, "gyro"), gain or GAIN, before)

    # Rows of one time differ in no way that the state depends on but their values, which settle their order.
    return _in_order(samples, keys, ["ts_ns", *columns[1:]], fuse)


def camera_attitudes(samples: DataFrame, rate_hz: float, r_cam_imu: tuple[float, float, float, float], gyro_bias: Sequence[float], accel_bias: Sequence[float], keys: Sequence[str] = ("recording_id",), target_hz: float = 120.0) -> DataFrame:
    """Camera attitudes: biases taken off, about target_hz of the samples fused, turned into the camera's frame."""
    from isochron.operators import signal

    free = lambda name, bias: F.struct(*((F.col(f"{name}.{a}").cast("double") - b).alias(a) for a, b in zip("xyz", bias, strict=True))).alias(name)
    thinned = signal.every_nth(samples, keys, ["ts_ns"], max(1, round(rate_hz / target_hz)))
    fused = attitudes(thinned.select(*keys, "ts_ns", free("accel", accel_bias), free("gyro", gyro_bias)), keys)
    turned = geometry.multiply(geometry.quat(*(F.col(c) for c in ("qx", "qy", "qz", "qw"))), geometry.conjugate(geometry.quat(*r_cam_imu)))
    return fused.select(*keys, "ts_ns", turned.alias("q"))
