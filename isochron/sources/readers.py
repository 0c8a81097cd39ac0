"""Recordings as DataFrames: files are listed and read by Spark (binaryFile) and decoded in Arrow batches.

The recording, part and kind of a file come from its path: `<recording>/part003.imu`, or `<recording>.imu` for part 0.
One file is one row of the listing, so that readers scale with the number of files; headers and records are separate
relations over the same listing, and a query that needs only headers never builds the records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.codecs import boxes, calibration, records, sei

#: Rows of small files that are put together to one batch, at least.
ROWS = 4_096
_xyz = "struct<x:float,y:float,z:float>"
HEADER = "recording_id string, part int, device_id string, version int, rate_hz long, accel_fs int, gyro_fs int, flags long, start_ns long, video_start_ns long, host_offset_ns long"
SAMPLES = f"recording_id string, part int, sample_idx long, ts_ns long, accel {_xyz}, gyro {_xyz}, mag {_xyz}, lin_accel {_xyz}, quat struct<x:float,y:float,z:float,w:float>, temp_c float, fsync_delay_us float, mag_age_us float"
FRAMES = "recording_id string, part int, frame_idx long, frame_number long, ts_ns long, sof_ns long, venc_seq long, venc_pts_us long, exposure_us long, timing_flags long, readout_us long"
VTS_HEADERS = "recording_id string, part int, version int, frame_rate_milli long, offset_ns long, skew_ppb int, quality_us int, sync_flags int"
TELEMETRY = "recording_id string, part int, ts_ns long, temp_milli_c int, cpu_khz long, bitrate_kbps long, fps int, thermal_state int, led_state int"


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(recording_id, part, content) of the files under a path whose names match the glob."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    part = F.regexp_extract("path", r"/part(\d+)\.[^/]+$", 1)
    chunked = F.regexp_extract("path", r"([^/]+)/part\d+\.[^/]+$", 1)
    return listed.select(F.when(part != "", chunked).otherwise(F.regexp_extract("path", r"([^/]+)\.[^/.]+$", 1)).alias("recording_id"), F.when(part != "", part.try_cast("int")).otherwise(F.lit(0)).alias("part"), "content")


def _column(name: str, field: T.StructField, values: np.ndarray | None, n: int) -> pa.Array:
    kind = pa.int64() if isinstance(field.dataType, T.LongType) else pa.int32() if isinstance(field.dataType, T.IntegerType) else pa.float32()
    if isinstance(field.dataType, T.StructType):
        names = field.dataType.names
        if values is None:
            return pa.nulls(n, pa.struct([(k, pa.float32()) for k in names]))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k]), pa.float32()) for k in range(len(names))], names=names)
    return pa.nulls(n, kind) if values is None else pa.array(np.ascontiguousarray(values), kind)


def _decoded(listed: DataFrame, ddl: str, decode: Callable[[bytes], dict[str, np.ndarray] | None], index: str | None = None) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Files whose columns are the same ones are put together, so that small files are not a batch each.
            held: dict[tuple, list[tuple[int, int, dict[str, np.ndarray]]]] = {}
            rows = 0
            for k, content in enumerate(batch.column(2)):
                columns = decode(content.as_py())
                n = len(next(iter(columns.values())))
                held.setdefault(tuple(columns), []).append((k, n, columns))
                rows += n
                if rows >= ROWS:
                    yield from made(batch, held)
                    held, rows = {}, 0
            yield from made(batch, held)

    def made(batch: pa.RecordBatch, held: dict) -> Iterator[pa.RecordBatch]:
        for names, found in held.items():
            sizes = np.array([n for _, n, _ in found])
            whole = {name: np.concatenate([columns[name] for _, _, columns in found]) for name in names}
            if index:
                whole[index] = np.concatenate([np.arange(n) for n in sizes])
            at = pa.array(np.repeat(np.array([k for k, _, _ in found]), sizes))
            arrays = [batch.column(0).take(at), batch.column(1).take(at)]
            arrays += [_column(field.name, field, whole.get(field.name), len(at)) for field in schema.fields[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return listed.mapInArrow(each, schema)


def _headers(listed: DataFrame, ddl: str, decode: Callable[[bytes], dict]) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"recording_id": r, "part": p} | decode(c) for r, p, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name) for row in rows], kinds[f.dataType.simpleString()]) for f in schema.fields], names=schema.names)

    return listed.mapInArrow(each, schema)


def imu_headers_of(listed: DataFrame) -> DataFrame:
    """Headers of (recording_id, part, content) rows; so for the other functions that end in `_of`."""
    return _headers(listed, HEADER, lambda data: records.decode_imu(data)[0])


def imu_headers(spark: SparkSession, path: str) -> DataFrame:
    return imu_headers_of(files(spark, path, "*.imu"))


def imu_samples_of(listed: DataFrame) -> DataFrame:
    return _decoded(listed, SAMPLES, lambda data: records.decode_imu(data)[1], "sample_idx")


def imu_samples(spark: SparkSession, path: str) -> DataFrame:
    return imu_samples_of(files(spark, path, "*.imu"))


def vts_headers_of(listed: DataFrame) -> DataFrame:
    """Headers with fps, the frame rate in frames a second."""
    return _headers(listed, VTS_HEADERS, lambda data: records.decode_vts(data)[0]).withColumn("fps", F.col("frame_rate_milli") / F.lit(1000.0))


def vts_headers(spark: SparkSession, path: str) -> DataFrame:
    return vts_headers_of(files(spark, path, "*.vts"))


def frames_of(listed: DataFrame) -> DataFrame:
    return _decoded(listed, FRAMES, lambda data: records.decode_vts(data)[1], "frame_idx")


def frames(spark: SparkSession, path: str) -> DataFrame:
    return frames_of(files(spark, path, "*.vts"))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    def decode(data: bytes) -> dict[str, np.ndarray]:
        rows = records.decode_tel(data)[1]
        return {name: rows[name].astype(np.int64) for name in rows.dtype.names}

    return _decoded(files(spark, path, "*.tel"), TELEMETRY, decode)


def little_endian(content: Column, start: Column) -> Column:
    """The 32-bit number at a byte (from 1); by hexadecimal, as reversing bytes that are no text would damage them."""
    h = F.hex(F.substring(content, start, F.lit(4)))
    return F.conv(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def versions_of(listed: DataFrame) -> DataFrame:
    """(recording_id, part, magic, version) by the first bytes only, in SQL: the version is the number at byte 8."""
    version = little_endian(F.col("content"), F.lit(9)).cast("int")
    return listed.select("recording_id", "part", F.expr("decode(substring(content, 1, 7), 'US-ASCII')").alias("magic"), version.alias("version"))


def file_versions(spark: SparkSession, path: str) -> DataFrame:
    return versions_of(files(spark, path, "*.{imu,vts,tel}"))


def embedded(spark: SparkSession, path: str) -> DataFrame:
    """Metadata tracks of MP4 files: counts, metadata JSON, calibration, and the sidecar files rebuilt byte for byte."""
    ddl = "recording_id string, part int, chunks long, samples long, frames long, telemetry long, meta string, calibration binary, imu binary, vts binary, tel binary"
    names = T.StructType.fromDDL(ddl).names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            rows = []
            for recording, part, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                t = boxes.read_track(content)
                rows.append((recording, part, *t.counts().values(), json.dumps(t.meta) if t.meta is not None else None, t.calibration, t.imu_bytes(), t.vts_bytes(), t.tel_bytes()))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.nulls(0, k) for k in kinds], names=names)

    return files(spark, path, "*.mp4").mapInArrow(each, ddl)


def prefer_sidecar(sidecar: DataFrame, rebuilt: DataFrame, column: str) -> DataFrame:
    """(recording_id, part, content): the sidecar where there is one, else what the video embeds."""
    keys = ["recording_id", "part"]
    both = sidecar.select(*keys, F.col("content").alias("own")).join(rebuilt.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("inside")), keys, "full")
    return both.select(*keys, F.coalesce("own", "inside").alias("content"))


def side_channel(streams: DataFrame) -> DataFrame:
    """(recording_id, part, content, pts_us, fps) of elementary streams to the .imu and .vts files they carry."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for recording, part, content, pts, fps in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                imu, vts = sei.sidecars(content, pts or [], fps)
                for k, v in enumerate((recording, part, records.encode_imu(*imu), records.encode_vts(*vts))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["recording_id", "part", "imu", "vts"])

    return streams.select("recording_id", "part", "content", "pts_us", "fps").mapInArrow(each, "recording_id string, part int, imu binary, vts binary")


LENS = "struct<image_size:array<int>,model:string,fx:double,fy:double,cx:double,cy:double,distortion:array<double>>"
CALIBRATION = f"struct<version:int,flags:int,chip_id:string,num_cams:int,intrinsics:{LENS},cameras:array<struct<intrinsics:{LENS},timeshift_cam_imu_s:double,reprojection_rms_px:double>>,T_cam_imu:array<array<double>>,T_cam0_imu:array<array<double>>,T_cam1_cam0:array<array<double>>,timeshift_cam_imu_s:double,imu:struct<accel_bias_m_s2:array<double>,gyro_bias_rad_s:array<double>,bias_valid:boolean,sample_rate_hz:double,noise_model:struct<accel_noise_density:double,gyro_noise_density:double,accel_random_walk:double,gyro_random_walk:double>>,quality:struct<kalibr_gyro_error_mean:double,kalibr_accel_error_mean:double,reprojection_rms_px:double>>"


def calibrations(listed: DataFrame) -> DataFrame:
    """(recording_id, part, content) of calibration files, JSON or blob, with `calibration` as one nested type."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            texts = [json.dumps(calibration.load(c)) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["recording_id", "part", "json"])

    texts = listed.select("recording_id", "part", "content").mapInArrow(each, "recording_id string, part int, json string")
    return texts.select("recording_id", "part", F.from_json("json", CALIBRATION).alias("calibration"), "json")


def blob_valid(content: Column) -> Column:
    """Whether a blob's checksum holds, in SQL."""
    body = F.substring(content, F.lit(1), F.length(content) - 4)
    return F.crc32(body) == little_endian(content, F.length(content) - 3)


META = "format string, session long, `group` long, role string, device_id string, device_tag string, segment int, synced boolean, master_clock_offset_ns long, clock_skew_ppb int, sync_quality_us int, sync_flags int, mode string, basename string, created_unix long"


def recording_meta(spark: SparkSession, path: str) -> DataFrame:
    """Recording metadata; a file that is no JSON gives nulls."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
    return meta_of(raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("recording_id"), "value"))


def meta_of(texts: DataFrame) -> DataFrame:
    """(recording_id, value) JSON texts as columns."""
    parsed = F.from_json("value", META, {"mode": "PERMISSIVE"})
    return texts.select("recording_id", parsed.alias("m")).select("recording_id", "m.*")


#: A trajectory has at least so many poses.
LEAST_POSES = 10


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Poses of text files, see `poses_of`."""
    raw = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^/.]+$", 1).alias("recording_id"), "value")
    return poses_of(raw)


def poses_of(lines: DataFrame) -> DataFrame:
    """(recording_id, value) lines to poses `t x y z qx qy qz qw`: comments and short lines are left out, commas are spaces."""
    raw = lines.select("recording_id", F.trim(F.translate("value", ",\t", "  ")).alias("line"))
    fields = F.split("line", " +")
    kept = raw.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("f", fields).filter(F.size("f") >= 8)
    return kept.select("recording_id", *(F.get("f", F.lit(k)).cast("double").alias(n) for k, n in enumerate(("t_s", "x", "y", "z", "qx", "qy", "qz", "qw"))))


def long_enough(poses: DataFrame, least: int = LEAST_POSES) -> DataFrame:
    """The poses; a recording with fewer than `least` ends the query with an error."""
    n = F.count("*").over(W.partitionBy("recording_id"))
    short = F.raise_error(F.concat(F.lit("too few poses in "), F.coalesce("recording_id", F.lit("?")))).cast("boolean")
    return poses.withColumn("n_poses", n).filter(F.when(F.col("n_poses") < least, short).otherwise(F.lit(True))).drop("n_poses")
