"""Files to DataFrames and back, per-frame channels of a recording, and the streams against the batch results."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isochron.codecs import calibration, records
from isochron.operators import frames as frame_ops
from isochron.sources import readers, writers
from tests.test_core import MONO, STEREO, imu_columns, sei_stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("takes")
    columns = imu_columns(200) | {"mag_age_us": np.ones(200, np.float32)}
    (root / "left.imu").write_bytes(records.encode_imu({"version": 6, "rate_hz": 400, "device_id": "ab" * 16}, columns))
    vts = {"frame_number": np.arange(10), "sof_ns": np.arange(10) * 33_000_000 + 1_000_000, "venc_seq": np.arange(10), "venc_pts_us": np.arange(10) * 33_000}
    (root / "left.vts").write_bytes(records.encode_vts({"version": 4, "frame_rate_milli": 30000, "sync_flags": 3}, vts))
    (root / "right").mkdir()
    (root / "right" / "part002.vts").write_bytes(records.encode_vts({"version": 1, "frame_rate_milli": 30000}, {"frame_number": np.arange(3), "ts_ns": np.arange(3)}))
    tel = np.zeros(3, records.TEL_RECORD)
    tel["temp_milli_c"] = -1500
    (root / "left.tel").write_bytes(records.encode_tel({"version": 1}, tel))
    (root / "left.json").write_text(json.dumps({"session": 7, "role": "master", "synced": True}))
    (root / "bad.json").write_text("{no json")
    (root / "path.txt").write_text("# t x y z q\n0 1 2 3 0 0 0 1\n\n1, 1, 2, 3, 0, 0, 0, 1\n2 3\n")
    return root


def test_readers_and_writers(spark, folder):
    path = str(folder)
    samples, header = readers.imu_samples(spark, path), readers.imu_headers(spark, path)
    assert samples.count() == 200 and header.first()["device_id"] == "ab" * 16 and samples.filter("fsync_delay_us is not null").count() == 0
    assert writers.imu_files(samples, header).first()["content"] == (folder / "left.imu").read_bytes()
    frames, vts = readers.frames(spark, path), readers.vts_headers(spark, path)
    files = {(r["recording_id"], r["part"]): bytes(r["content"]) for r in writers.vts_files(frames, vts).collect()}
    assert files == {("left", 0): (folder / "left.vts").read_bytes(), ("right", 2): (folder / "right" / "part002.vts").read_bytes()}
    assert {(r["recording_id"], r["magic"], r["version"]) for r in readers.file_versions(spark, path).collect()} == {("left", "TRIMU00", 6), ("left", "TRIVTS0", 4), ("right", "TRIVTS0", 1), ("left", "TRTEL01", 1)}
    assert readers.telemetry(spark, path).agg(F.min("temp_milli_c")).first()[0] == -1500
    meta = {r["recording_id"]: r["session"] for r in readers.recording_meta(spark, path).collect()}
    assert meta == {"left": 7, "bad": None}
    assert readers.trajectories(spark, str(folder / "path.txt")).count() == 2
    assert [r["frame_idx"] for r in writers.drop_leading(frames.filter("recording_id = 'left'"), F.lit(8)).orderBy("sof_ns").collect()] == list(range(8))


def test_calibration_table(spark):
    blob = calibration.pack(STEREO)
    rows = spark.createDataFrame([("a", 0, bytearray(blob)), ("b", 0, bytearray(json.dumps(MONO).encode()))], "recording_id string, part int, content binary")
    got = {r["recording_id"]: r["calibration"] for r in readers.calibrations(rows).collect()}
    assert got["a"]["num_cams"] == 2 and got["b"]["intrinsics"]["fx"] == 700.0
    assert rows.filter("recording_id = 'a'").select(readers.blob_valid(F.col("content")).alias("ok")).first()["ok"]
    texts = writers.vio_config(calibration.unpack(blob))
    assert "update_rate: 400" in texts["imu.yaml"] and texts["cameras.yaml"].count("T_imu_cam") == 2


def test_side_channel_files(spark):
    rows = spark.createDataFrame([("u", 0, bytearray(sei_stream(6)), [0], 30.0)], "recording_id string, part int, content binary, pts_us array<long>, fps double")
    out = readers.side_channel(rows).first()
    assert len(records.decode_imu(bytes(out["imu"]))[1]["ts_ns"]) == 33 and len(records.decode_vts(bytes(out["vts"]))[1]["sof_ns"]) == 6


def test_channels_at_frames(spark, folder):
    path = str(folder)
    samples = readers.imu_samples(spark, path)
    got = frame_ops.take_of_sidecars(samples, readers.frames(spark, path).filter("recording_id = 'left'"), readers.vts_headers(spark, path), readers.imu_headers(spark, path)).orderBy("frame_idx").collect()
    columns = imu_columns(200)
    times = np.arange(10) * 33_000_000 + 1_000_000
    want = np.interp(times, columns["ts_ns"], columns["accel"][:, 1].astype(float)).astype(np.float32)
    assert [r["accel"]["y"] for r in got] == pytest.approx(want.tolist(), abs=1e-6)


def test_plans(spark, folder):
    from isochron.plans import takes

    path = str(folder)
    row = takes.inspected(spark, path).first()
    assert row["samples"] == 200 and row["accel_range"] == "±2 g" and row["actual_rate_hz"] == pytest.approx(400)
    assert takes.channels_per_frame(spark, path).filter("recording_id = 'left'").count() == 10
    assert takes.attitudes_per_frame(spark, path).filter("recording_id = 'left' and abs(q.x*q.x + q.y*q.y + q.z*q.z + q.w*q.w - 1) < 1e-9").count() == 10
    report = {r["recording_id"]: r for r in takes.cadence_report(spark, path).collect()}
    assert report["left"]["mean_ms"] == pytest.approx(33.0) and report["left"]["std_ms"] == pytest.approx(0, abs=1e-9)
    assert takes.dropped_frames(spark, path).count() == 0
    assert takes.multi_camera(spark, path, 30.0).filter("n_cameras = 1 and spread_ns = 0").count() == 9


def test_command_line(tmp_path, capsys):
    from isochron import cli

    (tmp_path / "c.json").write_text(json.dumps(MONO))
    assert cli.main(["pack", str(tmp_path / "c.json"), "--out", str(tmp_path / "c.bin")]) == 0
    assert cli.main(["unpack", str(tmp_path / "c.bin")]) == 0 and '"version": 1' in capsys.readouterr().out
    (tmp_path / "s.h264").write_bytes(sei_stream(6))
    assert cli.main(["stream", str(tmp_path / "s.h264"), "--out", str(tmp_path / "o")]) == 0 and (tmp_path / "o" / "s.imu").exists()
    assert cli.main(["unpack", str(tmp_path / "missing")]) == 2
    (tmp_path / "stereo.json").write_text(json.dumps(STEREO))
    assert cli.main(["config", str(tmp_path / "stereo.json"), "--out", str(tmp_path / "v")]) == 0 and "cam1" in (tmp_path / "v" / "cameras.yaml").read_text()
    (tmp_path / "poses.txt").write_text("# t x y z q\n" + "".join(f"{k} {k}, 0 0 0 0 0 1\n" for k in range(10)))
    assert cli.main(["trajectory", str(tmp_path / "poses.txt")]) == 0 and '"path_length":9.0' in capsys.readouterr().out


def test_resolved_folders(spark, tmp_path):
    from isochron.sources import resolve

    for name in ("a/part000.mp4", "a/part000.vts", "a/part001.mp4", "a/meta.json", "b.mp4", "b.vts", "b.json", "t_L.mp4", "t_R.mp4", "t_L.vts", "t.imu", "u_L.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = resolve.members(resolve.listing(spark, str(tmp_path)))
    parts = {(r["recording_id"], r["part"]): r for r in resolve.parts(found).collect()}
    assert {k for k, r in parts.items() if r["placeable"]} == {("a", 0), ("b", 0), ("t_L", 0)}
    assert parts["a", 1]["meta"].endswith("/a/meta.json") and parts["b", 0]["meta"].endswith("/b.json") and parts["t_L", 0]["meta"] is None
    takes = {r["take"]: r for r in resolve.stereo_takes(found).collect()}
    assert set(takes) == {"t", "u"} and takes["t"]["complete"] and not takes["u"]["complete"]
    assert (takes["t"]["vts_l_from"], takes["t"]["vts_r_from"], takes["t"]["imu_from"], takes["u"]["imu_from"]) == ("sidecar", "embedded", "sidecar", "embedded")


def test_panels_of_odd_values(spark):
    from isochron.operators import charts

    rows = spark.createDataFrame([("one", 1.0, 2.0), ("none", 1.0, None), ("none", 2.0, float("nan")), ("flat", 1.0, 5.0), ("flat", 2.0, float("inf")), ("flat", 3.0, 5.0), ("flat", 99.0, 8.0)], "k string, t double, v double")
    out = charts.panel(rows, ["k"], "t", "v", 2.0, 4.0, 100).orderBy("t").collect()
    assert [(r["k"], r["t"], r["segment"], r["across"]) for r in out] == [("flat", 1.0, 0, 1 / 6), ("flat", 3.0, 1, 0.5)] and all(r["up"] == 0.5 for r in out)
    assert charts.panel(rows.limit(0), ["k"], "t", "v", 2.0, 4.0, 100).count() == 0


def test_a_recording_by_any_member(spark, folder):
    from isochron.plans import takes

    (folder / "left.mp4").write_bytes(b"\0" * 11)
    for member in ("left.imu", "left.vts", "left.mp4", "left.json", "left"):
        row = takes.recording(spark, f"{folder}/{member}").collect()
        assert len(row) == 1 and (row[0]["samples"], row[0]["frames"], row[0]["mp4_bytes"], row[0]["fps"]) == (200, 10, 11, 30.0)
    chunk = takes.recording(spark, f"{folder}/right/part002.vts").first()
    assert (chunk["samples"], chunk["frames"], chunk["vts_version"]) == (None, 3, 1)
    assert takes.recording(spark, f"{folder}/nobody.imu").collect() == []


def test_small_files_share_batches(spark):
    """Files of two versions, some empty, decoded together: each keeps its own rows and numbers."""
    files = []
    for k in range(60):
        columns = imu_columns(k % 4)
        files.append((f"r{k}", k, bytearray(records.encode_imu({"version": 3 + k % 2 * 3, "rate_hz": 400}, columns))))
    rows = spark.createDataFrame(files, "recording_id string, part int, content binary").coalesce(1)
    found = readers.imu_samples_of(rows)
    assert sorted((r["recording_id"], r["part"], r["sample_idx"]) for r in found.collect()) == sorted((f"r{k}", k, i) for k in range(60) for i in range(k % 4))
    batches = []
    frames = found.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long")
    batches = [r["n"] for r in frames.collect()]
    assert sum(batches) == 90 and len(batches) <= 4


def test_files_are_dealt_by_their_rows(spark, monkeypatch):
    """More rows, more tasks; files that run over several batches, and rows and headers that have no partner."""
    r = np.random.default_rng(9)
    sizes = {(f"r{k % 30:02}", k // 30): int(r.integers(1, 40)) for k in range(60)}
    times = {key: np.cumsum(r.integers(1, 1000, n)) for key, n in sizes.items()}
    rows = [(*key, k, k, int(t)) for key, ts in times.items() for k, t in enumerate(ts)] + [("no header", 0, 0, 0, 1), (None, 0, 0, 0, 1)]
    frames = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "recording_id string, part int, frame_idx long, frame_number long, sof_ns long")
    heads = [(*key, 4, 30_000 + k) for k, key in enumerate(sizes)]
    headers = spark.createDataFrame([*heads, ("no rows", 0, 4, 1), (None, 0, 4, 1)], "recording_id string, part int, version int, frame_rate_milli long")
    monkeypatch.setattr(writers, "ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = writers.vts_files(frames, headers)
        found = {(x["recording_id"], x["part"]): bytes(x["content"]) for x in made.collect()}
        with pytest.raises(Exception, match="two headers of file"):
            writers.vts_files(frames, headers.unionByName(headers.limit(1))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {key: records.encode_vts({"version": 4, "frame_rate_milli": rate}, {"frame_number": np.arange(sizes[key]), "sof_ns": times[key]}) for *key, _, rate in heads for key in [tuple(key)]}
    assert made.rdd.getNumPartitions() >= len(rows) // 50
