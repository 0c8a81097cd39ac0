"""Clocks: one monotonic nanosecond time line for frames and samples of many recorders.

Times are longs since power-up. Arithmetic is exact long arithmetic: divisions floor, overflow raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.operators.asof import floor_div

BILLION = 1_000_000_000
#: Bits of the sync flags and of the frame timing flags.
SYNCED, MASTER, MID_EXPOSURE, EXPOSURE_VALID, READOUT_VALID, FRAME_CENTERED = 1, 2, 1, 2, 4, 8


def _file(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys)


def _first(column: Column, keys: Sequence[str], order: str) -> Column:
    return F.first(column).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def best_time(frames: DataFrame, keys: Sequence[str] = ("recording_id", "part")) -> DataFrame:
    """best_ns: the start of frame, or where no frame of the file has one, the presentation time."""
    any_sof = F.max(F.coalesce(F.col("sof_ns"), F.lit(0)) != 0).over(_file(keys))
    return frames.withColumn("best_ns", F.when(any_sof, F.col("sof_ns")).otherwise(F.coalesce(F.col("venc_pts_us") * 1000, F.col("ts_ns"))))


def skewed(t: Column, first: Column, offset_ns: Column, skew_ppb: Column) -> Column:
    """t + offset + floor(skew * (t - first) / 1e9)."""
    return t + offset_ns + floor_div(skew_ppb.cast("long") * (t - first), BILLION)


def global_time(frames: DataFrame, headers: DataFrame, keys: Sequence[str] = ("recording_id", "part"), order: str = "frame_idx") -> DataFrame:
    """global_ns: each frame's best time on the take's clock; null where the file is not synced.

    The header table has a row for each file and joins by its keys.
    """
    timed = best_time(frames, keys).join(headers.select(*keys, "offset_ns", "skew_ppb", "sync_flags"), list(keys), "left")
    first = _first(F.col("best_ns"), keys, order)
    synced = F.col("sync_flags").bitwiseAND(F.lit(SYNCED)) != 0
    moved = skewed(F.col("best_ns"), first, F.col("offset_ns"), F.col("skew_ppb"))
    return timed.withColumn("global_ns", F.when(synced, moved)).drop("offset_ns", "skew_ppb", "sync_flags")


def imu_time(frame_ns: Column, timeshift_s: Column) -> Column:
    """A camera time on the sample clock, rounded half to even."""
    return frame_ns + F.bround(timeshift_s * BILLION).cast("long")


def imu_global(samples: DataFrame, headers: DataFrame, timeshift_s: float, first_ns: Column, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """global_ns of samples, by their time less the time shift; null where the file is not synced."""
    shift = int(round(timeshift_s * BILLION))
    joined = samples.join(headers.select(*keys, "offset_ns", "skew_ppb", "sync_flags"), list(keys), "left")
    t = F.col("ts_ns") - shift
    synced = F.col("sync_flags").bitwiseAND(F.lit(SYNCED)) != 0
    return joined.withColumn("global_ns", F.when(synced, skewed(t, first_ns, F.col("offset_ns"), F.col("skew_ppb")))).drop("offset_ns", "skew_ppb", "sync_flags")


def row_times(frames: DataFrame, height: int, row: Column, keys: Sequence[str] = ("recording_id", "part"), order: str = "frame_idx") -> DataFrame:
    """line_delay_s, row_offset_s and row_ns of a sensor row, by the file's first known readout and its first frame's mode."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    readout = F.first(F.when(F.col("readout_us") > 0, F.col("readout_us")), ignorenulls=True).over(w)
    centered = F.first(F.coalesce(F.col("timing_flags"), F.lit(0)).bitwiseAND(F.lit(FRAME_CENTERED)) != 0).over(w)
    delay = F.coalesce(readout / F.lit(1e6 * height), F.lit(0.0))
    offset = (row - F.when(centered, F.lit(height / 2)).otherwise(F.lit(0.0))) * delay
    out = frames.withColumn("line_delay_s", delay).withColumn("row_offset_s", offset)
    return out.withColumn("row_ns", F.col("sof_ns") + F.bround(F.col("row_offset_s") * BILLION).cast("long"))


def relative_s(on: str, keys: Sequence[str]) -> Column:
    """Seconds since the key's first time."""
    return (F.col(on) - F.min(on).over(_file(keys))) / F.lit(1e9)


def mag_time(ts_ns: Column, age_us: Column) -> Column:
    """When a magnetometer value was measured."""
    return ts_ns - F.bround(age_us.cast("double") * 1000).cast("long")
