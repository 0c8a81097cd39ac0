"""Core operators against independent statements of their rules; codecs by round trips."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isochron.codecs import boxes, calibration, records, sei
from isochron.functions import geometry
from isochron.operators import asof, clock, frames, fusion, signal

pytestmark = pytest.mark.filterwarnings("ignore")


def imu_columns(n, seed=0):
    r = np.random.default_rng(seed)
    f = lambda k: r.standard_normal((n, k)).astype(np.float32)
    return {"ts_ns": np.arange(n) * 2_500_000 + 10, "accel": f(3), "gyro": f(3), "mag": f(3), "lin_accel": f(3), "quat": f(4), "temp_c": f(1)[:, 0]}


@pytest.mark.parametrize("version", range(1, 7))
@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_imu_round_trip(version, n):
    columns = imu_columns(n) | {"fsync_delay_us": np.ones(n, np.float32), "mag_age_us": np.ones(n, np.float32)}
    header = {"version": version, "rate_hz": 400, "accel_fs": 2, "gyro_fs": 3, "start_ns": 5, "video_start_ns": 6, "flags": 3, "device_id": "ab" * 16, "host_offset_ns": -7}
    data = records.encode_imu(header, columns)
    back, got = records.decode_imu(data + b"\1" * 11)  # a part of a record at the end
    assert len(data) == 64 + n * (44 if version == 1 else 76 if version == 2 else 80)
    assert (got["ts_ns"] == columns["ts_ns"]).all() and (got["gyro"] == columns["gyro"]).all()
    assert ("fsync_delay_us" in got, "mag_age_us" in got) == (3 <= version < 5, version >= 5)
    assert back["device_id"] == ("ab" * 16 if version >= 3 else "") and back["host_offset_ns"] == (-7 if version >= 4 else None)
    assert records.encode_imu(back, got) == data


@pytest.mark.parametrize("version", range(1, 5))
def test_vts_round_trip(version):
    columns = {"frame_number": np.arange(4), "ts_ns": np.arange(4) * 33, "sof_ns": np.arange(4) * 7, "venc_seq": np.arange(4), "venc_pts_us": np.arange(4) * 33333, "exposure_us": np.full(4, 9), "timing_flags": np.full(4, 8), "readout_us": np.full(4, 26470)}
    header = {"version": version, "frame_rate_milli": 30000, "offset_ns": -5, "skew_ppb": -28617, "quality_us": 610, "sync_flags": 3}
    data = records.encode_vts(header, columns)
    back, got = records.decode_vts(data)
    assert records.encode_vts(back, got) == data
    assert back["skew_ppb"] == (-28617 if version >= 3 else 0) and ("sof_ns" in got) == (version > 1)


def test_bad_records():
    with pytest.raises(ValueError):
        records.decode_imu(b"TRIMU001")
    with pytest.raises(ValueError):
        records.decode_vts(b"x" * 40)
    late = records.encode_imu({"version": 3}, {"ts_ns": np.array([1 << 63], np.uint64)})
    with pytest.raises(ValueError):
        records.decode_imu(late)


def test_realigned_and_padded():
    kept = records.realigned({"frame_number": np.arange(5), "sof_ns": np.arange(5) * 10}, 3)
    assert kept["frame_number"].tolist() == [0, 1, 2] and kept["sof_ns"].tolist() == [20, 30, 40]
    assert records.padded_pts([0, 33333], 4, 30.0) == [0, 33333, 66666, 99999]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_emulation_prevention(data):
    coded = sei.escaped(data)
    assert not any(coded[k : k + 3] in (b"\0\0\0", b"\0\0\1", b"\0\0\2") for k in range(len(coded)))


def sei_stream(version, timing=True):
    def samples(start, n):
        out = np.zeros(n, records.imu_record(3))
        out["ts_ns"] = start + np.arange(n) * 2_500_000
        out["tail"] = 50.0
        return out

    units, start = [], 1_000_000_000
    for k in range(6):
        block = {"sof_ns": start + 3, "exposure_us": 8, "timing_flags": 8, "readout_us": 26470} if timing else None
        units.append(sei.encode_packet(sei.Packet(version, 1, 2, samples(start, 5), block)))
        if k == 2:  # two packets before one frame
            units.append(sei.encode_packet(sei.Packet(version, 1, 2, samples(start + 12_500_000, 3), block)))
        units.append(bytes([0x41, 7, 7]))
        start += 33_000_000
    units.insert(3, bytes([6, 5, 3]) + b"abc" + b"\x80")  # another message
    return b"".join((b"\0\0\0\1" if k % 2 else b"\0\0\1") + u for k, u in enumerate(units))


@pytest.mark.parametrize("version", [1, 3, 5, 6])
def test_side_channel(version):
    (imu, columns), (vts, rows) = sei.sidecars(sei_stream(version), [0, 33000], 30.0)
    assert len(columns["ts_ns"]) == 33 and len(rows["frame_number"]) == 6 and imu["rate_hz"] == 400
    assert rows["venc_pts_us"].tolist() == [0, 33000, 66333, 99666, 132999, 166332]
    first = {6: 1_000_000_003, 5: 0}.get(version, 1_000_000_000 - 50_000)
    assert rows["sof_ns"][0] == first and vts["version"] == (4 if version >= 6 else 2)


def klv(key, kind, size, payload):
    repeat = len(payload) // (size if kind else 4)
    return key + bytes([kind, size]) + repeat.to_bytes(2, "little") + payload + b"\0" * (-len(payload) % 4)


def box(kind, body, wide=False):
    size = len(body) + (16 if wide else 8)
    return (1).to_bytes(4, "big") + kind + size.to_bytes(8, "big") + body if wide else size.to_bytes(4, "big") + kind + body


def movie(chunks, wide=False, fixed=False, meta=b'{"codec": "h264"}', track=True):
    media = box(b"mdat", b"".join(chunks), wide)
    at, places = 16 if wide else 8, []
    for c in chunks:
        places.append(at)
        at += len(c)
    n = len(chunks).to_bytes(4, "big")
    sizes = box(b"stsz", bytes(4) + (len(chunks[0]).to_bytes(4, "big") + n if fixed else bytes(4) + n + b"".join(len(c).to_bytes(4, "big") for c in chunks)))
    offsets = box(b"co64" if wide else b"stco", bytes(4) + n + b"".join(p.to_bytes(8 if wide else 4, "big") for p in places))
    table = box(b"stbl", box(b"stsd", bytes(8) + b"tmfd") + sizes + offsets)
    trak = box(b"trak", box(b"mdia", box(b"minf", table))) if track else b""
    return media + box(b"moov", box(b"udta", box(b"tmfm", b"old"))) + box(b"moov", trak + box(b"udta", box(b"tmfm", meta) + box(b"tmfc", b"blob")))


@pytest.mark.parametrize("wide,fixed", [(False, False), (True, True)])
def test_embedded_track(wide, fixed):
    columns = imu_columns(6) | {"mag_age_us": np.arange(6, dtype=np.float32)}
    imu = records.encode_imu({"version": 6, "rate_hz": 400, "device_id": "0" * 31 + "1"}, columns)
    rows = np.frombuffer(imu, records.imu_record(6), 6, 64)
    tel = records.encode_tel({"version": 1}, np.zeros(2, records.TEL_RECORD))
    stale = tel[:16] + (9).to_bytes(4, "little") + tel[20:32]

    def chunk(k):
        part = rows[3 * k : 3 * k + 3]
        data = [klv(key, ord("f") if name != "ts_ns" else ord("Q"), rows.dtype[name].itemsize, part[name].tobytes()) for key, name in boxes.COLUMNS.items() if key not in (b"FSYN", b"QUAT")]
        heads = klv(b"IHDR", ord("B"), 64, imu[:64]) + klv(b"THDR", ord("B"), 32, stale)
        inner = heads + klv(b"STRM", 0, 4, b"".join(data)) + klv(b"STRM", 0, 4, klv(b"TSOC", ord("B"), 24, tel[32 + 24 * k : 56 + 24 * k]))
        return klv(b"DEVC", 0, 4, inner)

    t = boxes.read_track(movie([chunk(0), chunk(1)], wide, fixed))
    assert t.counts() == {"chunks": 2, "samples": 6, "frames": 0, "telemetry": 2} and t.meta == {"codec": "h264"} and t.calibration == b"blob"
    want = rows.copy()
    want["quat"] = 0
    assert t.imu_bytes() == imu[:64] + want.tobytes() and t.tel_bytes() == tel and t.vts_bytes() is None


def test_movies_without():
    assert boxes.read_track(movie([b"x"], meta=b"{bad", track=False)).meta is None
    with pytest.raises(ValueError):
        boxes.read_track(box(b"mdat", b"abc"))


MONO = {"intrinsics": {"fx": 700.0, "fy": 701.0, "cx": 960.0, "cy": 540.0, "model": "equidistant", "distortion": [0.1, 0.2, 0.3, 0.4], "image_size": [1920, 1080]}, "extrinsics": {"T_cam_imu": [[1, 0, 0, 0.1], [0, 1, 0, 0.2], [0, 0, 1, 0.3], [0, 0, 0, 1]], "timeshift_cam_imu_sec": 0.0}, "imu": {"noise_model": {"accelerometer_noise_density": 0.002}, "accel_bias": [1, 2, 3], "rate_hz": 400}}
FLAT = {"camera": {"intrinsics": {"fx": 1.0, "fy": 2.0, "cx": 3.0, "cy": 4.0}, "distortion": {"model": "radtan", "coeffs": [0.5]}, "resolution": [640, 480]}, "T_cam_imu": MONO["extrinsics"]["T_cam_imu"]}
STEREO = {"cameras": [{"intrinsics": MONO["intrinsics"], "timeshift_cam_imu_s": 0.0}, {"intrinsics": MONO["intrinsics"], "reprojection_rms_px": 0.25}], "T_cam0_imu": MONO["extrinsics"]["T_cam_imu"], "T_cam1_cam0": MONO["extrinsics"]["T_cam_imu"], "imu": MONO["imu"]}


def test_calibration_blobs():
    mono, flat, stereo = (calibration.pack(x, chip_id=b"\1") for x in (MONO, FLAT, STEREO))
    assert (len(mono), len(flat), len(stereo)) == (200, 200, 300)
    got = calibration.unpack(mono)
    assert got["flags"] == calibration.CHIP | calibration.EXTRINSICS | calibration.TIMESHIFT | calibration.BIAS
    assert got["intrinsics"]["model"] == "equidistant" and got["intrinsics"]["distortion"] == pytest.approx([0.1, 0.2, 0.3, 0.4]) and got["imu"]["noise_model"]["accel_noise_density"] == pytest.approx(0.002)
    assert calibration.unpack(flat)["intrinsics"] == {"fx": 1.0, "fy": 2.0, "cx": 3.0, "cy": 4.0, "image_size": [640, 480], "model": "radtan", "distortion": [0.5]}
    assert calibration.unpack(stereo)["flags"] & calibration.QUALITY and calibration.unpack(stereo)["flags"] & calibration.TIMESHIFT and calibration.unpack(stereo)["num_cams"] == 2
    for bad in (mono[:-1], mono[:-1] + b"\0\0", b"x" * 200):
        with pytest.raises(ValueError):
            calibration.unpack(bad)
    assert calibration.load(json.dumps(MONO).encode()) == MONO and calibration.load(mono)["version"] == 1


def _series(spark, seed=3):
    r = np.random.default_rng(seed)
    samples = [(int(k), int(t), float(v)) for k in (1, 2) for t, v in zip(r.choice(2000, 60, replace=False) - 700, r.standard_normal(60), strict=True)]
    queries = [(int(k), int(t)) for k in (1, 2, 3) for t in r.integers(-900, 1500, 80)] + [(1, samples[0][1])]
    return spark.createDataFrame(queries, "k long, t long"), spark.createDataFrame(samples, "k long, t long, v double"), queries, samples


@pytest.mark.parametrize("bucket", [None, 100])
def test_point_joins(spark, bucket):
    left, right, queries, samples = _series(spark)
    left = left.distinct()
    by = {k: sorted((t, v) for kk, t, v in samples if kk == k) for k in (1, 2, 3)}
    got = {(r["k"], r["t"]): r for r in asof.nearest(left, right, ["k"], "t", ["v"], bucket=bucket).collect()}
    inter = {(r["k"], r["t"]): r["v_at"] for r in asof.interpolate(left, right, ["k"], "t", ["v"], bucket).collect()}
    back = {(r["k"], r["t"]): r["match"] for r in asof.backward(left, right, ["k"], "t", ["v"], bucket).collect()}
    ahead = {(r["k"], r["t"]): r["match"] for r in asof.forward(left, right, ["k"], "t", ["v"], bucket, clamp=True).collect()}
    assert set(got) == set(queries)
    for k, t in queries:
        if not by[k]:
            assert got[k, t]["match"] is None and inter[k, t] is None
            continue
        times = np.array([x[0] for x in by[k]])
        best = min(by[k], key=lambda x: (abs(x[0] - t), x[0]))
        assert got[k, t]["match"]["t"] == best[0]
        assert inter[k, t] == pytest.approx(np.interp(t, times, [x[1] for x in by[k]]), abs=1e-12)
        assert (back[k, t] and back[k, t]["t"]) == max((x for x in times.tolist() if x <= t), default=None)
        assert ahead[k, t]["t"] == min((x for x in times.tolist() if x >= t), default=times[-1])


def test_between_and_grid(spark):
    left, right, queries, samples = _series(spark)
    met = asof.between(left.distinct(), right, ["k"], "t", 50, ["v"]).filter("sample_t is not null")
    want = sorted((k, t, s) for k, t in set(queries) for kk, s, _ in samples if kk == k and t <= s <= t + 50)
    assert sorted((r["k"], r["t"], r["sample_t"]) for r in met.collect()) == want
    rows = asof.grid(right, "k", "t", 100, ["v"], bucket=200).collect()
    lows, highs = zip(*((min(s[1] for s in samples if s[0] == k), max(s[1] for s in samples if s[0] == k)) for k in (1, 2)), strict=True)
    assert sorted({r["t"] for r in rows}) == list(range(max(lows), min(highs) + 1, 100)) and len(rows) == 2 * len({r["t"] for r in rows})


def test_floor_division(spark):
    got = spark.createDataFrame([(x,) for x in (-7, -1, 0, 7, -(10**17) - 1)], "x long").select(asof.floor_div("x", 2).alias("y")).collect()
    assert [r["y"] for r in got] == [-4, -1, 0, 3, (-(10**17) - 1) // 2]


def test_clock(spark):
    rows = [("a", 0, k, 0 if k == 0 else 1000 + k * 10, k * 5, 8 if k else 8, 0 if k < 2 else 26470) for k in range(4)] + [("b", 0, k, 0, k * 5, 0, 0) for k in range(3)]
    table = spark.createDataFrame(rows, "recording_id string, part int, frame_idx long, sof_ns long, venc_pts_us long, timing_flags long, readout_us long").selectExpr("*", "venc_pts_us * 1000 as ts_ns")
    headers = spark.createDataFrame([("a", 0, 7, -28617, 1), ("b", 0, 7, 0, 0)], "recording_id string, part int, offset_ns long, skew_ppb int, sync_flags int")
    out = {(r["recording_id"], r["frame_idx"]): r for r in clock.global_time(table, headers).collect()}
    assert [out["a", k]["best_ns"] for k in range(4)] == [0, 1010, 1020, 1030] and [out["b", k]["best_ns"] for k in range(3)] == [0, 5000, 10000]
    assert out["a", 2]["global_ns"] == 1020 + 7 + (-28617 * 1020) // 10**9 and out["b", 1]["global_ns"] is None
    offs = {(r["recording_id"], r["frame_idx"]): r for r in clock.row_times(table, 1080, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0)).collect()}
    assert offs["a", 0]["line_delay_s"] == pytest.approx(26470 / 1e6 / 1080) and offs["a", 0]["row_offset_s"] == pytest.approx(-0.013235) and offs["b", 0]["row_offset_s"] == 0


def test_pulses():
    ts = np.arange(0, 400) * 2_500_000
    delay = np.zeros(400, np.float32)
    at = np.arange(10, 390, 13)
    delay[at] = 100.0
    pulses = ts[at] - 100_000
    found = frames.match_pulses(ts, delay, pulses + 50_000, 30)
    assert (found == pulses).all()
    assert frames.match_pulses(ts, delay, np.array([0, 2 * 10**9]), 30) is None
    assert frames.match_pulses(ts, np.zeros(400, np.float32), pulses, 30) is None


def plain_pulses(ts, delay, frames_ns, fps):
    """The rule of SURVEY J3, sample by sample."""
    found = [j for j in range(len(ts)) if delay[j] > 0]
    if len(found) < 2 or len(ts) < 2 or not len(frames_ns):
        return None
    rate = (len(ts) - 1) / (float(ts[-1] - ts[0]) / 1e9)
    start, reach, out = found[0], max(8, round(rate / max(fps, 1.0)) * 2), []
    for t in frames_ns:
        place = max(sum(int(x) < t for x in ts), start)
        near = [(abs(ts[j] - float(delay[j]) * 1000 - t), j) for j in range(max(start, place - 4), min(len(ts), place + reach)) if delay[j] > 0]
        if not near:
            return None
        start = min(near)[1]
        out.append(int(ts[start] - float(delay[start]) * 1000))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_pulses_by_the_rule(seed):
    r = np.random.default_rng(seed)
    ts = np.cumsum(r.integers(1_500_000, 3_500_000, 300))
    delay = np.where(r.random(300) < (0.3, 0.08, 0.02)[seed % 3], r.integers(1, 2000, 300), 0).astype(np.float32)
    delay[: r.integers(0, 60)] = 0
    frame_ns = ts[0] + np.arange(int(r.integers(1, 12))) * 33_000_000 + r.integers(0, 2_000_000)
    got = frames.match_pulses(ts, delay, frame_ns, 30.0)
    assert (None if got is None else got.tolist()) == plain_pulses(ts, delay, frame_ns, 30.0)


def test_pulses_that_begin_late():
    ts, delay = np.arange(200) * 2_500_000, np.zeros(200, np.float32)
    delay[36::13] = 50.0
    assert frames.match_pulses(ts, delay, np.array([0, 33_000_000]), 30).tolist() == [36 * 2_500_000 - 50_000] * 2


def test_interval_joins_keep_rows(spark):
    left = spark.createDataFrame([("a", 0, None), ("a", 0, None), ("a", 0, 5), ("b", 0, 1), (None, 0, 1), ("a", None, 1)], "k string, t long, exposure int")
    right = spark.createDataFrame([("a", 3, 2.0), ("a", 10, 4.0), ("a", 11, 8.0), (None, 1, 1.0)], "k string, t long, v double")
    rows = sorted((str(r["k"]), str(r["t"]), str(r["exposure"]), r["sample_v"] or 0) for r in asof.between(left, right, ["k"], "t", 10, ["v"]).collect())
    assert rows == [("None", "0", "1", 0), ("a", "0", "5", 2.0), ("a", "0", "5", 4.0), *[("a", "0", "None", v) for v in (2.0, 2.0, 4.0, 4.0)], ("a", "None", "1", 0), ("b", "0", "1", 0)]
    gyro = right.selectExpr("k", "t", "struct(v as x, -v as y, 0D as z) as gyro")
    turned = sorted((str(r["k"]), str(r["exposure"]), r["mean_x"], r["mean_y"]) for r in frames.readout_motion(left.filter("t = 0"), gyro, ["k"], "t", 10).collect())
    assert turned == [("None", "1", 0.0, 0.0), ("a", "5", 3.0, 3.0), ("a", "None", 3.0, 3.0), ("a", "None", 3.0, 3.0), ("b", "1", 0.0, 0.0)]


def test_point_joins_of_nulls_and_repeats(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", None, 2), (None, 5, 3)], "k string, t long, n int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 0.5), ("a", 9, None), (None, 5, 7.0), ("a", None, 9.0)], "k string, t long, v double")
    for bucket in (None, 3):
        got = sorted((str(r["k"]), str(r["t"]), r["match"]["v"] if r["match"] else None) for r in asof.nearest(left, right, ["k"], "t", ["v"], bucket=bucket).collect())
        assert got == [("None", "5", None), ("a", "5", 0.5), ("a", "5", 0.5), ("a", "None", None)]


def test_point_join_is_linear(spark):
    import time

    def seconds(n):
        ids = spark.range(n).select((F.col("id") % 2).alias("odd"), F.col("id").alias("t"), F.lit("one").alias("k"))
        began = time.time()
        asof.nearest(ids.filter("odd = 0").select("k", "t"), ids.filter("odd = 1").select("k", "t", F.col("t").alias("v")), ["k"], "t", ["v"]).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(50_000)
    assert seconds(400_000) < 8 * max(0.5, seconds(100_000))


def test_filter_step_by_the_formula():
    """The gradient as SURVEY 2.15 writes it out, term by term."""
    r = np.random.default_rng(4)
    for _ in range(50):
        q, a = r.standard_normal(4), r.standard_normal(3)
        q, a = q / np.linalg.norm(q), a / np.linalg.norm(a)
        q0, q1, q2, q3 = q
        ax, ay, az = a
        s0 = 4 * q0 * q2**2 + 2 * q2 * ax + 4 * q0 * q1**2 - 2 * q1 * ay
        s3 = 4 * q1**2 * q3 - 2 * q1 * ax + 4 * q2**2 * q3 - 2 * q2 * ay
        pull = fusion._gravity_pull(q.tolist(), a.tolist())
        assert (pull[0], pull[3]) == pytest.approx((s0, s3), abs=1e-12)
        numeric = [(err(q + d, a) - err(q - d, a)) / 2e-6 for d in 1e-6 * np.eye(4)]
        assert np.allclose(pull, numeric, atol=1e-6)
        roll, pitch = np.arctan2(ay, az), np.arctan2(-ax, np.hypot(ay, az))
        cr, sr, cp, sp = np.cos(roll / 2), np.sin(roll / 2), np.cos(pitch / 2), np.sin(pitch / 2)
        assert np.allclose(fusion.seeded(a), [cr * cp, sr * cp, cr * sp, -sr * sp], atol=1e-12)
    assert fusion.seeded(np.zeros(3)) == (1.0, 0.0, 0.0, 0.0)


def err(q, a):
    w, x, y, z = q
    up = np.array([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)])
    return 0.5 * ((up - a) ** 2).sum()


def test_fusion_in_batches(spark):
    r = np.random.default_rng(6)
    t = np.cumsum(r.integers(1, 4, 300)) * 2_000_000
    a, g = r.standard_normal((2, 300, 3))
    rows = [(k, int(t[i]), tuple(map(float, a[i])), tuple(map(float, g[i]))) for k in "ab" for i in r.permutation(300)]
    axes = "struct<x:double,y:double,z:double>"
    table = spark.createDataFrame(rows, f"recording_id string, ts_ns long, accel {axes}, gyro {axes}").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for mode, want in (("gravity", fusion.gradient_filter(t, a, g)), ("gyro", fusion.gyro_only(t, g))):
            got = fusion.attitudes(table, mode=mode).orderBy("recording_id", "ts_ns").collect()
            assert np.allclose([[x[c] for c in fusion.TURN] for x in got], np.concatenate([want, want]), atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fusion(spark):
    t = np.arange(400) * 2_500_000
    still = np.tile([0.0, 0.0, 9.81], (400, 1))
    spin = np.tile([0.0, 0.0, np.pi / 2], (400, 1))
    for q in (fusion.gyro_only(t, spin), fusion.gradient_filter(t, still, spin)):
        assert np.allclose(np.linalg.norm(q, axis=1), 1)
        assert 2 * np.arctan2(q[-1, 2], q[-1, 3]) == pytest.approx(np.pi / 2 * t[-1] / 1e9, abs=1e-3)
    tilted = np.tile([0.0, 9.81 * np.sin(0.3), 9.81 * np.cos(0.3)], (400, 1))
    q = fusion.gradient_filter(t, tilted, np.zeros((400, 3)))
    assert 2 * np.arctan2(q[-1, 0], q[-1, 3]) == pytest.approx(0.3, abs=1e-3)
    mag = np.tile([20.0, 0.0, -40.0], (400, 1))
    full = fusion.marg_filter(t, still, np.zeros((400, 3)), mag)
    assert np.allclose(np.abs(full[-1]), [0, 0, 0, 1], atol=1e-2)
    assert np.allclose(fusion.marg_filter(t, still, spin, mag, max_samples=50)[[0, -1]], fusion.marg_filter(t[:: 8], still[::8], spin[::8], mag[::8])[[0, -1]], atol=0.05)


def test_trajectory_and_signal(spark):
    rows = spark.createDataFrame([("a", float(k), float(k % 4 in (1, 2)), float(k % 4 in (2, 3)), 0.0) for k in range(9)], "r string, t double, x double, y double, z double")
    r = signal.trajectory(rows, ["r"], "t").first()
    assert (r["n"], r["path_length"], r["displacement"], r["drift_pct"]) == (9, 8.0, 0.0, 0.0)
    steps = spark.createDataFrame([("a", t) for t in (0, 10, 20, 30, 70, 80)], "k string, t long")
    assert [(r["t"], r["step"]) for r in signal.gaps(steps, ["k"], "t").collect()] == [(70, 40)]
    assert [r["t"] for r in signal.every_nth(steps, ["k"], ["t"], 4, with_last=True).orderBy("t").collect()] == [0, 70, 80]


def test_quaternions(spark):
    r = np.random.default_rng(5)
    q = r.standard_normal((20, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "k int, x double, y double, z double, w double")
    a = geometry.quat(*(F.col(c) for c in "xyzw"))
    out = table.select("k", geometry.multiply(a, geometry.conjugate(a)).alias("one"), geometry.slerp(a, a, F.lit(0.3)).alias("same"), geometry.matmul(geometry.matrix(a), geometry.matrix(geometry.conjugate(a))).alias("m")).orderBy("k").collect()
    for row, v in zip(out, q, strict=True):
        assert tuple(row["one"]) == pytest.approx((0, 0, 0, 1), abs=1e-12) and tuple(row["same"]) == pytest.approx(tuple(v), abs=1e-9)
        assert np.allclose(row["m"], np.eye(3), atol=1e-12)
