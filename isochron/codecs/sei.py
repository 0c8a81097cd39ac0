"""Inertial data in the side channel of an H.264 stream: NAL units, SEI payloads, and their frames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from isochron.codecs.records import FSYNC_FLAG, MAG_FLAG, imu_record

#: Identifier of the payload, NAL and payload types.
PAYLOAD_UUID = bytes.fromhex("5452494e4554494d5553454900010000")
NAL_SEI, SEI_USER_DATA, FRAME_NALS = 6, 5, range(1, 6)
_start = re.compile(b"\x00\x00\x01")
_header = np.dtype([("version", "u1"), ("count", "<u2"), ("accel_fs", "<u2"), ("gyro_fs", "<u2")])
_timing = np.dtype([("sof_ns", "<u8"), ("exposure_us", "<u4"), ("timing_flags", "u1"), ("readout_us", "<u4")])


@dataclass
class Packet:
    version: int
    accel_fs: int
    gyro_fs: int
    samples: np.ndarray
    timing: dict[str, int] | None


def nal_units(stream: bytes) -> Iterator[bytes]:
    """The units between start codes, without the zeros that trail them."""
    starts = [m.end() for m in _start.finditer(stream)]
    if not starts:
        return
    for begin, after in zip(starts, [*(s - 3 for s in starts[1:]), len(stream)], strict=True):
        if unit := stream[begin:after].rstrip(b"\x00"):
            yield unit


def unescaped(unit: bytes) -> bytes:
    """Without emulation prevention: the 3 of each 00 00 03 goes."""
    return unit.replace(b"\x00\x00\x03", b"\x00\x00")


def escaped(payload: bytes) -> bytes:
    """With emulation prevention: no 00 00 followed by 0 to 3 stays."""
    return re.sub(rb"\x00\x00(?=[\x00-\x03])", b"\x00\x00\x03", payload)


def payloads(unit: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, bytes) of a SEI unit's messages; types and sizes go on while a byte is 255."""
    data, at = unescaped(unit), 1
    while at + 2 <= len(data) and data[at:] != b"\x80":
        numbers = []
        for _ in range(2):
            total = 0
            while at < len(data) and data[at] == 255:
                total, at = total + 255, at + 1
            if at >= len(data):
                return
            numbers.append(total + data[at])
            at += 1
        yield numbers[0], data[at : at + numbers[1]]
        at += numbers[1]


def packet(unit: bytes) -> Packet | None:
    """The unit's inertial payload; None for other messages and truncated ones."""
    for kind, body in payloads(unit):
        if kind != SEI_USER_DATA or not body.startswith(PAYLOAD_UUID) or len(body) < 16 + _header.itemsize:
            continue
        head = np.frombuffer(body, _header, 1, 16)[0]
        at, timing = 16 + _header.itemsize, None
        if head["version"] >= 6:
            if len(body) < at + _timing.itemsize:
                return None
            block = np.frombuffer(body, _timing, 1, at)[0]
            timing = {name: int(block[name]) for name in _timing.names}
            at += _timing.itemsize
        record, count = imu_record(3), int(head["count"])
        if len(body) < at + count * record.itemsize:
            return None
        return Packet(int(head["version"]), int(head["accel_fs"]), int(head["gyro_fs"]), np.frombuffer(body, record, count, at), timing)
    return None


def encode_packet(p: Packet) -> bytes:
    """A SEI unit without start code; for tests and fixtures."""
    head = np.array([(p.version, len(p.samples), p.accel_fs, p.gyro_fs)], _header).tobytes()
    timing = np.array([tuple(p.timing[n] for n in _timing.names)], _timing).tobytes() if p.version >= 6 and p.timing else b""
    body = PAYLOAD_UUID + head + timing + p.samples.tobytes()
    size = b"\xff" * (len(body) // 255) + bytes([len(body) % 255])
    return bytes([NAL_SEI]) + escaped(bytes([SEI_USER_DATA]) + size + body) + b"\x80"


def frames(stream: bytes) -> Iterator[tuple[int, list[Packet]]]:
    """(frame number, packets since the frame before) of each coded picture."""
    waiting: list[Packet] = []
    number = 0
    for unit in nal_units(stream):
        kind = unit[0] & 31
        if kind == NAL_SEI:
            if (found := packet(unit)) is not None:
                waiting.append(found)
        elif kind in FRAME_NALS:
            yield number, waiting
            number, waiting = number + 1, []


def sidecars(stream: bytes, pts_us: list[int], fps: float) -> tuple[tuple[dict, dict], tuple[dict, dict]]:
    """((imu header, columns), (vts header, columns)) recovered from an elementary stream.

    The start of a frame is its first packet's own, or for versions with frame sync its first sample's time less the
    delay, else 0; the sample rate is that of the upper median of the positive steps.
    """
    from isochron.codecs.records import padded_pts

    parts, rows, version, scales = [], [], 0, (0, 0)
    for number, found in frames(stream):
        first = found[0] if found else None
        sof, timing = 0, {"exposure_us": 0, "timing_flags": 0, "readout_us": 0}
        if first is not None:
            version, scales = max(version, first.version), (first.accel_fs, first.gyro_fs)
            if first.timing:
                sof, timing = first.timing["sof_ns"], {k: first.timing[k] for k in timing}
            elif first.version < 5 and len(first.samples):
                delay = float(first.samples["tail"][0])
                sof = int(first.samples["ts_ns"][0]) - int(delay * 1000) if delay > 0 else 0
        parts += [p.samples for p in found]
        rows.append((number, sof, *timing.values()))
    samples = np.concatenate(parts) if parts else np.empty(0, imu_record(3))
    times = samples["ts_ns"].astype(np.int64)
    steps = np.sort(np.diff(times)[np.diff(times) > 0])
    rate = round(1e9 / int(steps[len(steps) // 2])) if len(steps) > 10 else 0
    tail = "fsync_delay_us" if version < 5 else "mag_age_us"
    flags = (FSYNC_FLAG if version < 5 and (samples["tail"] > 0).any() else 0) | (MAG_FLAG if version >= 5 else 0)
    first_ns = int(times[0]) if len(times) else 0
    imu_header = {"version": max(version, 3), "rate_hz": rate, "accel_fs": scales[0], "gyro_fs": scales[1], "start_ns": first_ns, "video_start_ns": next((r[1] for r in rows if r[1]), first_ns), "flags": flags}
    columns = {name: samples[name] for name in samples.dtype.names if name != "tail"} | {tail: samples["tail"], "ts_ns": times}
    pts = padded_pts(pts_us, len(rows), fps)
    table = np.array(rows, np.int64).reshape(-1, 5)
    names = ("frame_number", "sof_ns", "exposure_us", "timing_flags", "readout_us")
    vts = dict(zip(names, table.T, strict=True)) | {"venc_seq": np.arange(len(rows)), "venc_pts_us": np.array(pts, np.int64)}
    return (imu_header, columns), ({"version": 4 if version >= 6 else 2, "frame_rate_milli": round(fps * 1000)}, vts)
