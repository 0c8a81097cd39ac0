"""Sinks: record files, calibration blobs, configuration text and landmark tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.codecs import calibration, records
from isochron.functions import geometry
from isochron.operators import ordering

#: Rows of files that are given to a task on average, at most; some hundreds of bytes each while they are sorted.
ROWS = 100_000
VECTORS = ("accel", "gyro", "mag", "lin_accel", "quat")


def _files(rows: DataFrame, keys: Sequence[str], order: str, headers: DataFrame, encode) -> DataFrame:
    """(keys..., content): one encoded file for each group; a file's rows meet in one task, as a file does on disk.

    Files are dealt to more tasks the more rows there are: rows are wide, and Spark would go by their compressed bytes.
    """
    columns = [c for c in rows.columns if c not in keys]
    head = headers.select(*keys, F.lit(0).alias("side"), F.struct(*[c for c in headers.columns if c not in keys]).alias("header"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns))
    own = rows.select(*keys, F.lit(1).alias("side"), F.lit(None).cast(head.schema["header"].dataType).alias("header"), *columns)
    known = head.unionByName(own).dropna(subset=list(keys))
    whole = ordering.spread(known, rows.count(), *keys, most=ROWS).sortWithinPartitions(*keys, "side")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last file, which may go on
        for batch in batches:
            new = np.zeros(batch.num_rows, bool)
            for k in range(len(keys)):
                values = pa.concat_arrays([*(b.column(k).slice(b.num_rows - 1) for b in held[-1:]), batch.column(k)])
                code = values.dictionary_encode().indices.to_numpy()
                new[len(new) - len(code) + 1 :] |= code[1:] != code[:-1]
            files, low = [], 0
            for at in np.flatnonzero(new).tolist():
                files += encoded([*held, batch.slice(low, at - low)])
                held, low = [], at
            if low < batch.num_rows:
                held.append(batch.slice(low))
            if files:
                yield made(files)
        if held and (files := encoded(held)):
            yield made(files)

    def encoded(pieces: list[pa.RecordBatch]) -> list[tuple[list[pa.Array], bytes]]:
        """The file of a group that has both a header and rows."""
        table = pa.Table.from_batches(pieces)
        heads = np.count_nonzero(table["side"].to_numpy() == 0)
        named = [table[k].chunk(0).slice(0, 1) for k in keys]
        if heads > 1:
            raise ValueError(f"two headers of file {[k[0].as_py() for k in named]}")
        if not heads or len(table) == 1:
            return []
        header = {k: v for k, v in table["header"][0].as_py().items() if v is not None}
        return [(named, encode(header, table.slice(1).select(columns).sort_by(order)))]

    def made(files: list[tuple[list[pa.Array], bytes]]) -> pa.RecordBatch:
        named = [pa.concat_arrays(values) for values in zip(*(n for n, _ in files), strict=True)]
        return pa.RecordBatch.from_arrays([*named, pa.array([content for _, content in files], pa.binary())], names=[*keys, "content"])

    return whole.mapInArrow(each, f"{kinds}, content binary")


def _numpy(column: pa.ChunkedArray) -> np.ndarray | None:
    if column.null_count == len(column):
        return None
    if pa.types.is_struct(column.type):
        flat = column.combine_chunks()
        return np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(column.type.num_fields)])
    return column.to_numpy()


def imu_files(samples: DataFrame, headers: DataFrame) -> DataFrame:
    """The .imu file of each recording part."""
    return _files(samples, ["recording_id", "part"], "sample_idx", headers, lambda header, group: records.encode_imu(header, {c: _numpy(group[c]) for c in group.column_names if c != "sample_idx"}))


def vts_files(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """The .vts file of each recording part."""
    return _files(frames, ["recording_id", "part"], "frame_idx", headers, lambda header, group: records.encode_vts(header, {c: _numpy(group[c]) for c in group.column_names if c != "frame_idx"}))


def drop_leading(frames: DataFrame, decoded: Column, keys: Sequence[str] = ("recording_id", "part")) -> DataFrame:
    """Frames without the first ones that a decoder dropped, numbered anew; `decoded` counts those that are left."""
    from pyspark.sql import Window as W

    n = F.count("*").over(W.partitionBy(*keys))
    kept = frames.withColumn("drop", F.greatest(n - decoded, F.lit(0))).filter(F.col("frame_idx") >= F.col("drop"))
    return kept.withColumn("frame_idx", F.col("frame_idx") - F.col("drop")).withColumn("frame_number", F.col("frame_idx")).drop("drop")


def calibration_blobs(rows: DataFrame) -> DataFrame:
    """(recording_id, json) to (recording_id, content): the binary blob of each calibration."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            blobs = [calibration.pack(json.loads(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["recording_id", "content"])

    return rows.select("recording_id", "json").mapInArrow(each, "recording_id string, content binary")


def landmarks_csv(rows: DataFrame, path: str) -> None:
    """topic, t to three and x, y, z to four decimals."""
    rows.select("topic", F.format_string("%.3f", "t").alias("t"), *(F.format_string("%.4f", c).alias(c) for c in "xyz")).write.option("header", "true").csv(path)


#: Noise where a calibration has none, before inflation.
NOISE = {"accel_noise_density": 2.3e-3, "accel_random_walk": 5.0e-5, "gyro_noise_density": 2.6e-4, "gyro_random_walk": 2.0e-5}


def _yaml(value, indent: int = 0) -> str:
    pad = " " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:\n{_yaml(v, indent + 2)}" if isinstance(v, dict) or (isinstance(v, list) and v and isinstance(v[0], list)) else f"{pad}{k}: {_yaml(v)}\n" for k, v in value.items())
    if isinstance(value, list) and value and isinstance(value[0], list):
        return "".join(f"{pad}- [{', '.join(f'{x:.9g}' for x in row)}]\n" for row in value)
    if isinstance(value, list):
        return "[" + ", ".join(_yaml(x) for x in value) + "]"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def vio_config(stereo: dict, inflation: float = 5.0, rate_hz: float | None = None) -> dict[str, str]:
    """Texts of the three configuration files of a visual-inertial estimator, from a stereo calibration."""
    imu, noise = stereo["imu"], stereo["imu"].get("noise_model", {})
    inflated = {k: float(noise.get(k) or default) * inflation for k, default in NOISE.items()}
    first = np.asarray(stereo["T_cam0_imu"], float)
    chain = [first, np.asarray(stereo["T_cam1_cam0"], float) @ first]
    cameras = {}
    for k, (camera, placed) in enumerate(zip(stereo["cameras"], chain, strict=False)):
        lens = camera["intrinsics"]
        cameras[f"cam{k}"] = {
            "T_imu_cam": geometry.rigid_inverse(placed).tolist(), "camera_model": "pinhole", "distortion_model": lens["model"],
            "distortion_coeffs": [float(x) for x in (lens["distortion"] + [0.0] * 4)[:4]], "intrinsics": [float(lens[c]) for c in ("fx", "fy", "cx", "cy")],
            "resolution": lens["image_size"], "timeshift_cam_imu": float(camera.get("timeshift_cam_imu_s", 0.0)),
        }
    rate = float(imu.get("rate_hz") or imu.get("sample_rate_hz") or rate_hz or 400.0)
    sensor = {"imu0": {"T_i_b": np.eye(4).tolist(), "accelerometer_noise_density": inflated["accel_noise_density"], "accelerometer_random_walk": inflated["accel_random_walk"], "gyroscope_noise_density": inflated["gyro_noise_density"], "gyroscope_random_walk": inflated["gyro_random_walk"], "update_rate": rate}}
    general = {"use_stereo": str(len(cameras) > 1).lower(), "max_cameras": len(cameras), "relative_config_imu": "imu.yaml", "relative_config_imucam": "cameras.yaml"}
    return {"estimator.yaml": _yaml(general), "imu.yaml": _yaml(sensor), "cameras.yaml": _yaml(cameras)}
