"""Whole questions over a folder of recordings, put together from sources and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions import scalar
from isochron.operators import clock, frames, fusion, session, signal
from isochron.sources import formats, readers

KEYS = ["recording_id", "part"]


def _samples(spark: SparkSession, path: str) -> DataFrame:
    return formats.open_records(spark, path, "imu")


def _frames(spark: SparkSession, path: str) -> DataFrame:
    return formats.open_records(spark, path, "vts")


def _imu_headers(spark: SparkSession, path: str) -> DataFrame:
    return formats.headers(spark, path, "imu")


def _vts_headers(spark: SparkSession, path: str) -> DataFrame:
    return formats.headers(spark, path, "vts").withColumn("fps", scalar.frame_rate(F.col("frame_rate_milli")))


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """One row for each inertial file: header, names of its ranges, samples, span, rate, mean field and gravity."""
    samples = _samples(spark, path)
    stats = samples.groupBy(*KEYS).agg(
        F.count("*").alias("samples"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1e9).alias("duration_s"),
        F.avg(scalar.norm(F.col("accel"))).alias("mean_accel"),
        F.avg(scalar.norm(F.col("mag"))).alias("mean_mag"),
        F.median("mag_age_us").alias("median_mag_age_us"),
        F.count(F.when(F.col("fsync_delay_us") > 0, 1)).alias("pulses"),
    )
    named = _imu_headers(spark, path).withColumns({"accel_range": scalar.code_name(F.col("accel_fs"), scalar.ACCEL_RANGES), "gyro_range": scalar.code_name(F.col("gyro_fs"), scalar.GYRO_RANGES), "generation": scalar.generation(F.col("version"))})
    out = named.join(stats, KEYS, "left")
    return out.withColumn("actual_rate_hz", F.try_divide(F.col("samples") - 1, F.col("duration_s")))


def recording(spark: SparkSession, member: str) -> DataFrame:
    """One row for the recording that a file belongs to, whichever of its members the path names, or its base name.

    What `inspected` says of its inertial file, its frame-timing file's version, rate, frames and reference of times, and
    whether there is a video; null for members that are missing.
    """
    folder, _, name = member.rpartition("/")
    chunk = formats.PART.match(name)
    base, part = (folder.rpartition("/")[2], int(chunk[1])) if chunk else (name.rsplit(".", 1)[0] if name.rsplit(".", 1)[-1] in ("imu", "vts", "mp4", "tel", "json") else name, 0)
    root = folder or "."
    own = (F.col("recording_id") == base) & (F.col("part") == part)
    imu = inspected(spark, root).filter(own)
    centred = F.first("timing_flags").bitwiseAND(F.lit(8)) != 0
    timed = _frames(spark, root).filter(own).groupBy(*KEYS).agg(F.count("*").alias("frames"), F.max(F.when(F.col("readout_us") > 0, F.col("readout_us"))).alias("readout_us"), centred.alias("centred"))
    vts = _vts_headers(spark, root).filter(own).select(*KEYS, F.col("version").alias("vts_version"), "fps").join(timed, KEYS, "left")
    video = spark.createDataFrame([(base, part, size) for path, size in formats.listed({"path": root}, "mp4") if formats.named(path) == (base, part)], "recording_id string, part int, mp4_bytes long")
    return imu.join(vts, KEYS, "full").join(video, KEYS, "full")


def channels_per_frame(spark: SparkSession, path: str, timeshift_s: float = 0.0, bucket: int | None = None) -> DataFrame:
    """Sidecar files to every channel at every frame."""
    return frames.take_of_sidecars(_samples(spark, path), _frames(spark, path), _vts_headers(spark, path), _imu_headers(spark, path), timeshift_s, bucket)


def attitudes_per_frame(spark: SparkSession, path: str, timeshift_s: float = 0.0, mode: str = "gravity") -> DataFrame:
    """Fused attitude at every frame's time on the sample clock."""
    fused = fusion.attitudes(_samples(spark, path), KEYS, mode).withColumnRenamed("ts_ns", "time_ns")
    timed = clock.best_time(_frames(spark, path), KEYS)
    timed = timed.select(*KEYS, "frame_idx", clock.imu_time(F.col("best_ns"), F.lit(timeshift_s)).alias("time_ns"))
    return frames.slerp_at(timed, fused, KEYS, "time_ns")


def multi_camera(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """The grid that all synced cameras of the largest session share, with the spread of their frames."""
    members = session.largest(readers.recording_meta(spark, path)).select(F.explode("members").alias("recording_id"))
    timed = clock.global_time(_frames(spark, path).join(members, "recording_id", "left_semi"), _vts_headers(spark, path), KEYS)
    return frames.camera_grid(timed.filter("global_ns is not null"), fps)


def camera_offsets(spark: SparkSession, path: str, fps: float, master: str) -> DataFrame:
    """Each synced camera's nearest frame on that grid, and how much later than the master's it is."""
    members = session.largest(readers.recording_meta(spark, path)).select(F.explode("members").alias("recording_id"))
    timed = clock.global_time(_frames(spark, path).join(members, "recording_id", "left_semi"), _vts_headers(spark, path), KEYS)
    return frames.camera_offsets(timed.filter("global_ns is not null"), fps, master)


def dropped_frames(spark: SparkSession, path: str) -> DataFrame:
    """Gaps of each recording's frames against the nominal step of its header."""
    timed = clock.best_time(_frames(spark, path), KEYS).join(_vts_headers(spark, path).select(*KEYS, "frame_rate_milli"), KEYS)
    return signal.gaps(timed, KEYS, "best_ns", nominal=F.lit(1e12) / F.col("frame_rate_milli"))


def cadence_report(spark: SparkSession, path: str) -> DataFrame:
    """Frame cadence in milliseconds and distance of frames to their nearest sample in microseconds."""
    timed = clock.best_time(_frames(spark, path), KEYS).select(*KEYS, "frame_idx", F.col("best_ns").alias("t"))
    steps = timed.withColumn("step_ms", signal.step("t", KEYS, ["t"]) / 1e6)
    near = frames.asof.nearest(timed, _samples(spark, path).select(*KEYS, F.col("ts_ns").alias("t"), "sample_idx"), KEYS, "t", ["sample_idx"])
    far = near.withColumn("far_us", F.abs(F.col("match.t") - F.col("t")) / 1e3).groupBy(*KEYS).agg(F.median("far_us").alias("median_us"), F.percentile("far_us", F.lit(0.95)).alias("p95_us"))
    return steps.groupBy(*KEYS).agg(F.avg("step_ms").alias("mean_ms"), F.stddev_pop("step_ms").alias("std_ms")).join(far, KEYS, "left")
