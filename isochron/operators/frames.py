"""Frames and samples: pulse matching, channels at frame times, stereo pairs, motion gates, poses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geometry, scalar
from isochron.operators import asof, clock, signal

CHANNELS = ("accel", "gyro", "mag", "lin_accel", "quat")


def match_pulses(ts: np.ndarray, delay_us: np.ndarray, frame_ns: np.ndarray, fps: float) -> np.ndarray | None:
    """Frame times by the frame-sync pulses, or None where a frame has no pulse near it.

    Samples with a positive delay are pulses, at their time less the delay. A frame looks at pulses from four samples
    before its place to max(8, twice the samples of a frame) after it, by the measured rate, and takes the nearest, the
    first of equals. No frame looks, or has its place, before the pulse that the last frame took, the first frame before
    the first pulse. Any frame without a pulse leaves the whole recording without.
    """
    pulses = np.flatnonzero(delay_us > 0)
    if not len(frame_ns) or len(pulses) < 2 or ts[-1] <= ts[0]:
        return None
    rate = (len(ts) - 1) / ((ts[-1] - ts[0]) / 1e9)
    reach = max(8, 2 * int(np.rint(rate / max(fps, 1.0))))
    times = ts[pulses] - delay_us[pulses].astype(np.float64) * 1000
    out = np.empty(len(frame_ns), np.int64)
    taken = 0  # number of the pulse that the last frame took
    for k, place in enumerate(np.searchsorted(ts, frame_ns, "left").tolist()):
        place = max(place, int(pulses[taken]))
        low, high = np.searchsorted(pulses, (place - 4, min(len(ts), place + reach)))
        low = max(int(low), taken)
        if low >= high:
            return None
        taken = low + int(np.argmin(np.abs(times[low:high] - frame_ns[k])))
        out[k] = int(times[taken])
    return out


def pulse_times(samples: DataFrame, frames: DataFrame, headers: DataFrame, rates: DataFrame, keys: Sequence[str] = ("recording_id", "part")) -> DataFrame:
    """(keys, frame_idx, pulse_ns) of the recordings whose every frame has a pulse; frames need best_ns.

    rates: keys and fps, the frame rate in the frame-timing file's own header; a recording without one has no match. The
    match is monotone over a recording's frames, so a recording is one group.
    """
    enabled = headers.filter(F.col("flags").bitwiseAND(F.lit(1)) != 0).select(*keys)
    left = samples.filter("fsync_delay_us is not null").join(enabled, list(keys)).select(*keys, "ts_ns", "fsync_delay_us")
    known = rates.select(*(F.col(k).alias(f"rate_{k}") for k in keys), F.col("fps").alias("pulse_fps")).filter("pulse_fps is not null")
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"rate_{k}") for k in keys))
    # Names anew, so that both sides may come from one table.
    right = frames.join(known, same).select(*keys, "frame_idx", "best_ns", "pulse_fps").toDF(*keys, "frame_idx", "best_ns", "pulse_fps")
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)

    def each(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [*keys, "frame_idx", "pulse_ns"]
        empty = pa.table({**{k: b[k].slice(0, 0) for k in keys}, "frame_idx": pa.array([], pa.int64()), "pulse_ns": pa.array([], pa.int64())})
        if not a.num_rows or not b.num_rows:
            return empty if b.num_rows else pa.table({**{k: a[k].slice(0, 0) for k in keys}, "frame_idx": pa.array([], pa.int64()), "pulse_ns": pa.array([], pa.int64())})
        a, b = a.sort_by("ts_ns"), b.sort_by("frame_idx")
        found = match_pulses(a["ts_ns"].to_numpy(), a["fsync_delay_us"].to_numpy(), b["best_ns"].to_numpy(), b["pulse_fps"][0].as_py())
        return empty if found is None else pa.table([*(b[k] for k in keys), b["frame_idx"], pa.array(found)], names=names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(each, f"{kinds}, frame_idx long, pulse_ns long")


def imu_at_frames(samples: DataFrame, frames: DataFrame, keys: Sequence[str] = ("recording_id", "part"), bucket: int | None = None, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Every channel, interpolated at each frame's time_ns; zeros for recordings of fewer than two samples.

    Components are interpolated one by one, quaternions too and without renormalising; `slerp_at` does better.
    """
    flat = {f"{c}_{a}": F.col(f"{c}.{a}") for c in channels for a in ("xyzw" if c == "quat" else "xyz")}
    usable = samples.withColumn("n_samples", F.count("*").over(W.partitionBy(*keys))).filter("n_samples >= 2")
    right = usable.select(*keys, F.col("ts_ns").alias("time_ns"), *(v.alias(k) for k, v in flat.items()))
    out = asof.interpolate(frames, right, keys, "time_ns", list(flat), bucket)
    axes = lambda c: "xyzw" if c == "quat" else "xyz"
    known = samples.groupBy(*keys).agg(*(F.count(c).alias(f"{c}_known") for c in channels))
    out = out.join(known, list(keys), "left")
    value = lambda c, a: F.when(F.col(f"{c}_known") > 0, F.coalesce(F.col(f"{c}_{a}_at"), F.lit(0.0))).cast("float")
    return out.select(*frames.columns, *(F.struct(*(value(c, a).alias(a) for a in axes(c))).alias(c) for c in channels))


def slerp_at(frames: DataFrame, attitudes: DataFrame, keys: Sequence[str], on: str, bucket: int | None = None) -> DataFrame:
    """Each frame with q, the attitude on the shorter arc between the ones around it, clamped at both ends."""
    both = asof.bracket(frames, attitudes, keys, on, ["qx", "qy", "qz", "qw"], bucket)
    q = lambda s: geometry.quat(*(F.col(f"{s}.{c}") for c in ("qx", "qy", "qz", "qw")))
    share = (F.col(on) - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    whole = F.when(F.col("lo").isNull(), q("hi")).when(F.col("hi").isNull() | (F.col("lo.t") == F.col(on)), q("lo")).otherwise(geometry.slerp(q("lo"), q("hi"), share))
    return both.withColumn("q", whole).drop("lo", "hi")


def stereo_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Left frames with their nearest right frame, not farther than half the left's median step."""
    steps = left.withColumn("step", signal.step(on, keys, [on])).groupBy(*keys).agg(F.floor(0.5 * F.median("step")).cast("long").alias("gate"))
    gated = left.join(steps, list(keys))
    return asof.nearest(gated, right, keys, on, values, gate=F.col("gate"), bucket=bucket).filter("match is not null").drop("gate")


def calm(frames: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, length_ns: int = 33_000_000, max_rad_s: float | None = None) -> DataFrame:
    """Frames in whose next length_ns the mean turn rate stays within the limit; none measured, none kept; no limit, all."""
    if max_rad_s is None or max_rad_s <= 0:
        return frames
    rates = samples.withColumn("turn", F.sqrt(F.col("gyro.x") ** 2 + F.col("gyro.y") ** 2 + F.col("gyro.z") ** 2))
    met = asof.between(frames.select(*keys, on).distinct(), rates, keys, on, length_ns, ["turn"])
    kept = met.groupBy(*keys, on).agg(F.avg("sample_turn").alias("turn")).filter(F.col("turn") <= max_rad_s)
    return frames.join(kept, [*keys, on], "left_semi")


def readout_motion(frames: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, readout_ns: int) -> DataFrame:
    """Mean magnitude of each turn rate during a frame's readout; 0 where no sample falls in it."""
    rates = samples.select(*keys, on, *(F.abs(F.col(f"gyro.{a}")).alias(f"g{a}") for a in "xyz"))
    met = asof.between(frames.select(*keys, on).distinct(), rates, keys, on, readout_ns, ["gx", "gy", "gz"])
    means = met.groupBy(*keys, on).agg(*(F.avg(f"sample_g{a}").alias(f"mean_{a}") for a in "xyz"))
    return frames.join(means, [*keys, on], "left").select(*frames.columns, *(F.coalesce(f"mean_{a}", F.lit(0.0)).alias(f"mean_{a}") for a in "xyz"))


def poses_at(frames: DataFrame, poses: DataFrame, keys: Sequence[str], on: str, max_gap: int, margin: int, bucket: int | None = None) -> DataFrame:
    """Frames between two poses at most max_gap apart: position interpolated, attitude of the nearer pose."""
    axes, turn = ("x", "y", "z"), ("qx", "qy", "qz", "qw")
    both = asof.bracket(frames, poses, keys, on, [*axes, *turn], bucket)
    inside = both.filter((F.col("hi.t") - F.col("lo.t") <= max_gap) & (F.col(on) >= F.col("lo.t") - margin) & (F.col(on) <= F.col("hi.t") + margin))
    share = (F.col(on) - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    near = lambda c: F.when(share > 0.5, F.col(f"hi.{c}")).otherwise(F.col(f"lo.{c}"))
    return inside.select(*frames.columns, *((F.col(f"lo.{a}") + share * (F.col(f"hi.{a}") - F.col(f"lo.{a}"))).alias(a) for a in axes), *(near(c).alias(c) for c in turn))


def camera_grid(frames: DataFrame, fps: float, bucket: int | None = None) -> DataFrame:
    """(t, n_cameras, spread_ns): the grid all cameras share, and how far their nearest frames lie apart."""
    rows = asof.grid(frames, "recording_id", "global_ns", int(1e9 / fps), ["frame_idx"], bucket)
    return rows.groupBy("global_ns").agg(F.count("match").alias("n_cameras"), (F.max("match.t") - F.min("match.t")).alias("spread_ns"))


def camera_offsets(frames: DataFrame, fps: float, master: str, bucket: int | None = None) -> DataFrame:
    """(global_ns, recording_id, frame_idx, offset_ns): each camera's nearest frame on the shared grid, and how much later
    than the master's it is; null offsets without a frame of the master."""
    rows = asof.grid(frames, "recording_id", "global_ns", int(1e9 / fps), ["frame_idx"], bucket)
    led = rows.filter(F.col("recording_id") == master).select(F.col("global_ns").alias("led_ns"), F.col("match.t").alias("master_ns"))
    joined = rows.join(led, F.col("global_ns") == F.col("led_ns"), "left")
    return joined.select("global_ns", "recording_id", F.col("match.frame_idx").alias("frame_idx"), (F.col("match.t") - F.col("master_ns")).alias("offset_ns"))


def take_of_sidecars(samples: DataFrame, frames: DataFrame, vts_headers: DataFrame, imu_headers: DataFrame, timeshift_s: float = 0.0, bucket: int | None = None) -> DataFrame:
    """Sidecars to per-frame channels: frame time by pulses at each file's own rate, else best time plus the time shift;
    then interpolation."""
    keys = ["recording_id", "part"]
    timed = clock.best_time(frames, keys)
    pulses = pulse_times(samples, timed, imu_headers, vts_headers.select(*keys, scalar.frame_rate(F.col("frame_rate_milli")).alias("fps")), keys)
    joined = timed.join(pulses, [*keys, "frame_idx"], "left")
    time = F.coalesce("pulse_ns", clock.imu_time(F.col("best_ns"), F.lit(timeshift_s)))
    return imu_at_frames(samples, joined.select(*keys, "frame_idx", "best_ns", time.alias("time_ns")), keys, bucket)
