"""Binary structures as table functions for SQL: `SELECT r.id, b.* FROM r, LATERAL mp4_boxes(r.content) b`.

`register(spark)` makes mp4_boxes, klv_items, nal_units, sei_packets and sei_samples known. Null gives no rows, and what is
cut off or damaged gives the rows before the damage.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from isochron.codecs import boxes, sei


@udtf(returnType="depth int, path string, kind string, low long, high long")
class Mp4Boxes:
    """Boxes in the order of their place; containers are followed by what they hold. low and high bound the body."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        def walk(start: int, end: int, depth: int, path: str) -> Iterator[tuple]:
            for kind, low, high in boxes.boxes(content, start, end):
                name = kind.decode("latin-1")
                yield depth, f"{path}/{name}", name, low, high
                if kind in boxes.CONTAINERS:
                    yield from walk(low, high, depth + 1, f"{path}/{name}")

        if content is not None:
            yield from walk(0, len(content), 0, "")


@udtf(returnType="pos int, path string, key string, kind int, size int, payload binary")
class KlvItems:
    """Items of a key-length-value stream that hold values, numbered in order, with the containers above them."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        def walk(data: bytes, path: str) -> Iterator[tuple]:
            for key, kind, size, payload in boxes.items(data):
                name = f"{path}/{key.decode('latin-1')}"
                if kind == 0:
                    yield from walk(payload, name)
                else:
                    yield name, key.decode("latin-1"), kind, size, payload

        if content is not None:
            for pos, row in enumerate(walk(bytes(content), "")):
                yield pos, *row


@udtf(returnType="pos int, kind int, payload binary")
class NalUnits:
    """NAL units between start codes, with emulation prevention taken out behind the header byte."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            for pos, unit in enumerate(sei.nal_units(bytes(content))):
                yield pos, unit[0] & 31, unit[:1] + sei.unescaped(unit[1:])


_TIMING = ("sof_ns", "exposure_us", "timing_flags", "readout_us")


@udtf(returnType="frame long, packet int, version int, accel_fs int, gyro_fs int, n int, sof_ns long, exposure_us long, timing_flags long, readout_us long")
class SeiPackets:
    """Inertial packets of an elementary stream, by the coded picture that they come before."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            for frame, found in sei.frames(bytes(content)):
                for k, p in enumerate(found):
                    yield frame, k, p.version, p.accel_fs, p.gyro_fs, len(p.samples), *((p.timing or {}).get(name) for name in _TIMING)


@udtf(returnType="frame long, packet int, at int, ts_ns long, gyro_x float, accel_z float, temp_c float, tail float")
class SeiSamples:
    """Samples of the packets; the last column is the frame-sync delay up to version 4, the magnetometer's age from 5 on."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            for frame, found in sei.frames(bytes(content)):
                for k, p in enumerate(found):
                    for at, s in enumerate(p.samples):
                        yield frame, k, at, int(s["ts_ns"]), float(s["gyro"][0]), float(s["accel"][2]), float(s["temp_c"]), float(s["tail"])


def register(spark: SparkSession) -> None:
    for name, function in (("mp4_boxes", Mp4Boxes), ("klv_items", KlvItems), ("nal_units", NalUnits), ("sei_packets", SeiPackets), ("sei_samples", SeiSamples)):
        spark.udtf.register(name, function)
