"""MP4 boxes and the key-length-value track that embeds sensor records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from isochron.codecs.records import IMU_HEADER, TEL_RECORD, decode_tel, encode_tel, imu_record

CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"dinf"))
#: Keys of the sample columns and their record fields.
COLUMNS = {b"TSNS": "ts_ns", b"ACCL": "accel", b"GYRO": "gyro", b"MAGN": "mag", b"TMPC": "temp_c", b"QUAT": "quat", b"LACC": "lin_accel", b"MAGA": "tail", b"FSYN": "tail"}
HEADERS = {b"IHDR": "imu", b"VHDR": "vts", b"THDR": "tel"}


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in a range; size 1 has 64 bits more, size 0 reaches to the end."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def find(data: bytes, start: int, end: int, wanted: bytes) -> tuple[int, int] | None:
    """Body range of the first box of a type, containers searched in depth."""
    for kind, low, high in boxes(data, start, end):
        if kind == wanted:
            return low, high
        if kind in CONTAINERS and (found := find(data, low, high, wanted)):
            return found
    return None


def items(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key, type, element size, payload) of a level's items; containers have type 0."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        kind, size, repeat = data[at + 4], data[at + 5], int.from_bytes(data[at + 6 : at + 8], "little")
        length = size * repeat if kind else 4 * repeat
        yield data[at : at + 4], kind, size, data[at + 8 : min(at + 8 + length, end)]
        at += 8 + length + -length % 4


def leaves(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    for key, kind, size, payload in items(data):
        if kind == 0:
            yield from leaves(payload)
        else:
            yield key, size, payload


@dataclass
class Track:
    meta: dict | None = None
    calibration: bytes | None = None
    headers: dict[str, bytes] = field(default_factory=dict)
    columns: dict[bytes, bytearray] = field(default_factory=dict)
    entries: bytearray = field(default_factory=bytearray)
    entry_size: int = 0
    telemetry: bytearray = field(default_factory=bytearray)
    chunks: int = 0

    def counts(self) -> dict[str, int]:
        return {"chunks": self.chunks, "samples": len(self.columns.get(b"TSNS", b"")) // 8, "frames": len(self.entries) // self.entry_size if self.entry_size else 0, "telemetry": len(self.telemetry) // TEL_RECORD.itemsize}

    def imu_bytes(self) -> bytes | None:
        """The .imu file, byte for byte: rows put together from the columns, absent ones as zeros, one trailing float."""
        if "imu" not in self.headers or b"TSNS" not in self.columns:
            return None
        version = int(np.frombuffer(self.headers["imu"], IMU_HEADER, 1)[0]["version"])
        if version < 3:
            raise ValueError(f"rows of version {version} have another layout than the columns")
        rows = np.zeros(len(self.columns[b"TSNS"]) // 8, imu_record(version))
        tails = [b"FSYN", b"MAGA"] if version >= 5 else [b"MAGA", b"FSYN"]
        for key in [k for k in COLUMNS if COLUMNS[k] != "tail"] + tails:
            if key in self.columns:
                kind = rows.dtype[COLUMNS[key]]
                rows[COLUMNS[key]] = np.frombuffer(bytes(self.columns[key]), kind.base).reshape(len(rows), *kind.shape)
        return self.headers["imu"] + rows.tobytes()

    def vts_bytes(self) -> bytes | None:
        return self.headers["vts"] + bytes(self.entries) if "vts" in self.headers else None

    def tel_bytes(self) -> bytes | None:
        """The .tel file with its record count refreshed."""
        if "tel" not in self.headers:
            return None
        header, rows = decode_tel(self.headers["tel"] + bytes(self.telemetry))
        return encode_tel(header, rows)


def chunk_ranges(data: bytes, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a track's samples, by its size and offset tables."""
    sizes, wide, narrow = (find(data, low, high, k) for k in (b"stsz", b"co64", b"stco"))
    if sizes is None or (wide or narrow) is None:
        raise ValueError("the track has no sample tables")
    number = lambda at, n=4: int.from_bytes(data[at : at + n], "big")
    fixed, count = number(sizes[0] + 4), number(sizes[0] + 8)
    table, width = (wide, 8) if wide else (narrow, 4)
    for k in range(count):
        at = number(table[0] + 8 + width * k, width)
        yield at, at + (fixed or number(sizes[0] + 12 + 4 * k))


def read_track(data: bytes) -> Track:
    """What the file's last movie box and its metadata track hold; a file without the track has its metadata only."""
    movies = [(low, high) for kind, low, high in boxes(data) if kind == b"moov"]
    if not movies:
        raise ValueError("no moov box")
    low, high = movies[-1]
    out = Track()
    if extra := find(data, low, high, b"udta"):
        for kind, a, b in boxes(data, *extra):
            if kind == b"tmfm":
                try:
                    out.meta = json.loads(data[a:b])
                except ValueError:
                    out.meta = None
            elif kind == b"tmfc":
                out.calibration = data[a:b]
    for kind, a, b in boxes(data, low, high):
        described = find(data, a, b, b"stsd") if kind == b"trak" else None
        if described and b"tmfd" in data[described[0] : described[1]]:
            for start, end in chunk_ranges(data, a, b):
                out.chunks += 1
                for key, size, payload in leaves(data[start:end]):
                    if key in HEADERS:
                        out.headers.setdefault(HEADERS[key], payload)
                    elif key == b"TFRM":
                        out.entry_size = size
                        out.entries += payload
                    elif key == b"TSOC":
                        out.telemetry += payload
                    elif key in COLUMNS:
                        out.columns.setdefault(key, bytearray()).extend(payload)
            break
    return out
