"""Data sources by byte ranges, the sink of whole files, and the table functions."""

import os
import pickle
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isochron.codecs import boxes, records
from isochron.sources import formats, readers, tables, writers
from tests.test_core import imu_columns, sei_stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ranges")
    for version in range(1, 7):
        (root / f"v{version}").mkdir()
        columns = imu_columns(1000 + version) | {"mag_age_us": np.arange(1000 + version, dtype=np.float32), "fsync_delay_us": np.arange(1000 + version, dtype=np.float32)}
        (root / f"v{version}" / "part002.imu").write_bytes(records.encode_imu({"version": version, "rate_hz": 400, "device_id": "ab" * 16}, columns) + b"\x01" * (version - 1))
    for version in range(1, 5):
        n = np.arange(500 + version)
        (root / f"v{version}.vts").write_bytes(records.encode_vts({"version": version, "frame_rate_milli": 30000}, {"frame_number": n, "sof_ns": n * 7, "ts_ns": n * 5, "venc_seq": n, "venc_pts_us": n * 3, "exposure_us": n}))
    tel = np.zeros(300, records.TEL_RECORD)
    tel["ts_ns"], tel["temp_milli_c"] = np.arange(300), -np.arange(300)
    (root / "a.tel").write_bytes(records.encode_tel({"version": 1}, tel))
    return str(root)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_ranges_equal_the_codec(spark, folder):
    """Files cut at every few bytes, all versions, a part of a record at the end: each record once, as from whole files."""
    for extension, whole in (("imu", readers.imu_samples(spark, folder)), ("vts", readers.frames(spark, folder)), ("tel", readers.telemetry(spark, folder))):
        for split in (5_000, 1 << 20):
            found = formats.open_records(spark, folder, extension, split=split)
            assert rows_of(found.select(whole.columns)) == rows_of(whole), (extension, split)
    assert formats.open_records(spark, folder, "imu", split=5_000).rdd.getNumPartitions() > 40
    assert rows_of(formats.headers(spark, folder, "imu")) == rows_of(readers.imu_headers(spark, folder))
    assert rows_of(formats.headers(spark, folder, "vts")) == rows_of(readers.vts_headers(spark, folder).drop("fps"))


def test_chosen_ranges(spark, folder):
    """Options choose files and bytes, and what is left is what Spark's own filter would leave."""
    ddl = "recording_id string, part int, sample_idx long, ts_ns long"
    plain = formats.open_records(spark, folder, "imu", ddl)
    for chosen, test in (({"recordings": ["v3"]}, "recording_id = 'v3'"), ({"recordings": ["v1", "v,6", "v6"], "first": 990}, "recording_id in ('v1', 'v6') and sample_idx >= 990"), ({"first": 11, "last": 14}, "sample_idx between 11 and 14"), ({"last": -1}, "false"), ({"first": 5000}, "false"), ({"recordings": []}, "false")):
        assert rows_of(formats.open_records(spark, folder, "imu", ddl, split=9_000, **chosen)) == rows_of(plain.filter(test)), test


def test_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: its last records by their numbers, and its records counted, by many tasks."""
    path = tmp_path / "long.imu"
    head = records.encode_imu({"version": 5, "rate_hz": 400}, imu_columns(2) | {"mag_age_us": np.ones(2, np.float32)})
    size = records.imu_record(5).itemsize
    n = 3 * 10**9 // size
    with open(path, "wb") as f:
        f.write(head[:64])
        f.truncate(64 + (n - 1) * size)
        f.seek(64 + (n - 1) * size)
        f.write(head[-size:])
    assert os.stat(path).st_size > 2**31
    found = formats.open_records(spark, str(path), "imu", "sample_idx long, ts_ns long")
    last = formats.open_records(spark, str(path), "imu", "sample_idx long, ts_ns long", first=n - 3)
    assert [(r[0] - n, r[1] != 0) for r in last.orderBy("sample_idx").collect()] == [(-3, False), (-2, False), (-1, True)]
    assert found.rdd.getNumPartitions() >= 40
    assert formats.open_records(spark, str(path), "imu", "sample_idx long", first=1_000_000, last=8_999_999).count() == 8_000_000


def test_errors_and_empty(spark, folder, tmp_path):
    (tmp_path / "short.imu").write_bytes(b"TRIMU001")
    with pytest.raises(Exception, match="bytes, the header has"):
        formats.open_records(spark, str(tmp_path), "imu").count()
    (tmp_path / "none").mkdir()
    assert formats.open_records(spark, str(tmp_path / "none"), "vts").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        formats.open_records(spark, str(tmp_path / "nowhere"), "vts").count()


def test_sink_writes_what_the_codec_writes(spark, folder, tmp_path):
    """Blocks of 64 records from several tasks make the same files, byte for byte."""
    for extension, whole, encoded in (("imu", readers.imu_samples(spark, folder), writers.imu_files), ("vts", readers.frames(spark, folder), writers.vts_files)):
        header = formats.headers(spark, folder, extension)
        out = str(tmp_path / extension)
        formats.save(formats.record_pieces(whole, header, extension, 64), out, extension)
        for row in encoded(whole, header).collect():
            with open(f"{out}/{row['recording_id']}/part{row['part']:03d}.{extension}", "rb") as f:
                assert f.read() == bytes(row["content"])
        assert not [x for x in os.listdir(out) if x.startswith("_")]
        assert rows_of(formats.open_records(spark, out, extension, split=900)) == rows_of(whole.select(formats.open_records(spark, out, extension).columns))
        with pytest.raises(Exception, match="part"):
            formats.save(formats.record_pieces(whole, header, extension), out, extension)
        formats.save(formats.record_pieces(whole, header, extension), out, extension, overwrite=True)


def test_failed_write_leaves_nothing(spark, tmp_path):
    """A task that ends half-way: no file, no pending folder, and what was there before stays."""
    pieces = spark.range(2000).selectExpr("concat('r', id % 40) recording_id", "0 part", "id seq", "cast(concat(id, ';') as binary) content")
    out = str(tmp_path / "out")
    formats.save(pieces.filter("recording_id = 'r1'"), out, "bin")
    broken = pieces.filter("recording_id <> 'r1'").withColumn("content", F.when(F.col("seq") == 1999, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        formats.save(broken, out, "bin")
    assert os.listdir(out) == ["r1"]
    with open(f"{out}/r1/part000.bin") as f:
        assert f.read() == "".join(f"{k};" for k in range(1, 2000, 40))
    with pytest.raises(Exception, match="no name for a folder"):
        formats.save(pieces.withColumn("recording_id", F.lit("../x")), out, "bin")


def item(key, payload, kind=b"B", size=1):
    return key + kind + bytes([size]) + struct.pack("<H", len(payload) // size) + payload + b"\x00" * (-len(payload) % 4)


def nest(key, payload):
    return key + b"\x00\x01" + struct.pack("<H", len(payload) // 4) + payload


def box(kind, *bodies):
    body = b"".join(bodies)
    return struct.pack(">I", 8 + len(body)) + kind + body


def movie(chunks, wide=False):
    """An MP4 file, its data box in 64-bit form if wide, with chunks at their places and the tables behind them."""
    ftyp = box(b"ftyp", b"isom")
    data = b"".join(chunks)
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) if wide else struct.pack(">I4s", 8 + len(data), b"mdat")
    at = len(ftyp) + len(head)
    offsets = [at + sum(map(len, chunks[:k])) for k in range(len(chunks))]
    table = box(b"co64", struct.pack(">II", 0, len(chunks)), *(struct.pack(">Q", x) for x in offsets)) if wide else box(b"stco", struct.pack(">II", 0, len(chunks)), *(struct.pack(">I", x) for x in offsets))
    sizes = box(b"stsz", struct.pack(">III", 0, 0, len(chunks)), *(struct.pack(">I", len(c)) for c in chunks))
    track = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", b"\x00" * 8, b"\x00\x00\x00\x10tmfd"), sizes, table))))
    other = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", b"\x00" * 8, b"\x00\x00\x00\x10avc1")))))
    return ftyp + head + data + box(b"moov", other, track, box(b"udta", box(b"tmfm", b'{"session": 7}'), box(b"tmfc", b"CAL")))


def chunked_file(n=30, wide=False):
    imu = records.encode_imu({"version": 5, "rate_hz": 400}, {"ts_ns": np.empty(0, np.int64)})
    vts = records.encode_vts({"version": 4, "frame_rate_milli": 30000}, {"frame_number": np.empty(0, np.int64)})
    tel = records.encode_tel({"version": 1}, np.zeros(0, records.TEL_RECORD))
    chunks = []
    for k in range(n):
        heads = item(b"IHDR", imu) + item(b"VHDR", vts) + item(b"THDR", tel) if not k else b""
        t = np.arange(4 * k, 4 * k + 4, dtype="<u8")
        accel = np.repeat(t[:, None], 3, 1).astype("<f4")
        frame = np.zeros(2, records.vts_record(4))
        frame["frame_number"] = (2 * k, 2 * k + 1)
        row = np.zeros(1, records.TEL_RECORD)
        row["ts_ns"] = k
        chunks.append(nest(b"CHNK", heads + item(b"TSNS", t.tobytes(), b"J", 8) + item(b"ACCL", accel.tobytes(), b"f", 12) + item(b"TFRM", frame.tobytes(), b"?", frame.itemsize) + item(b"TSOC", row.tobytes(), b"?", row.itemsize)))
    return movie(chunks, wide)


@pytest.mark.parametrize("wide", [False, True])
def test_track_by_ranges(spark, tmp_path, wide):
    """Chunks dealt to many tasks make the counts and the sidecar files that the whole file makes in memory."""
    data = chunked_file(wide=wide)
    (tmp_path / "take.mp4").write_bytes(data)
    whole = boxes.read_track(data)
    for split in (500, 1 << 20):
        chunks = formats.track(spark, str(tmp_path), split)
        info = formats.track_info(chunks).first()
        assert {k: info[k] for k in whole.counts()} == whole.counts() == {"chunks": 30, "samples": 120, "frames": 60, "telemetry": 30}
        assert (info["meta"], bytes(info["calibration"])) == ('{"session": 7}', b"CAL")
    for extension, expected in (("imu", whole.imu_bytes()), ("vts", whole.vts_bytes()), ("tel", whole.tel_bytes())):
        formats.save(formats.track_pieces(formats.track(spark, str(tmp_path), 500), extension), str(tmp_path / f"out{wide}"), extension)
        with open(tmp_path / f"out{wide}" / "take" / f"part000.{extension}", "rb") as f:
            assert f.read() == expected


def test_chunks_that_are_alike_make_one_piece(spark, tmp_path):
    """Runs of chunks are rebuilt at once, to the bytes of each chunk alone; a chunk without a column has zeros there."""
    head = records.encode_imu({"version": 5, "rate_hz": 400}, {"ts_ns": np.empty(0, np.int64)})
    chunks, expected = [], b""
    for k in range(40):
        n = 3 if k % 20 == 19 else 2
        t = np.arange(10 * k, 10 * k + n)
        columns = {"ts_ns": t, "accel": np.zeros((n, 3), np.float32)} if k in (7, 8, 30) else {"ts_ns": t, "accel": np.repeat(t[:, None], 3, 1).astype(np.float32)}
        parts = [item(b"TSNS", t.astype("<u8").tobytes(), b"J", 8)] + ([] if k in (7, 8, 30) else [item(b"ACCL", columns["accel"].astype("<f4").tobytes(), b"f", 12)])
        chunks.append(nest(b"CHNK", (item(b"IHDR", head) if not k else b"") + (b"".join(parts) if k != 11 else item(b"NONE", b"1234"))))
        # As each chunk alone is rebuilt.
        expected += records.encode_imu({"version": 5, "rate_hz": 400}, columns)[len(head) :] if k != 11 else b""
    for name in ("a", "b"):
        (tmp_path / f"{name}.mp4").write_bytes(movie(chunks))
    pieces = formats.track_pieces(formats.track(spark, str(tmp_path)), "imu").collect()
    for name in ("a", "b"):
        own = sorted((r["seq"], bytes(r["content"])) for r in pieces if r["recording_id"] == name)
        assert [seq for seq, _ in own] == [-1, 0, 7, 9, 11, 12, 19, 20, 30, 31, 39]
        assert b"".join(content for _, content in own) == head + expected
    broken = [nest(b"CHNK", item(b"IHDR", head) + item(b"TSNS", b"\x00" * 16, b"J", 8) + item(b"ACCL", b"\x00" * (24 + 12 * d), b"f", 12)) for d in (1, -1)]
    (tmp_path / "c.mp4").write_bytes(movie(broken))
    with pytest.raises(Exception, match="reshape"):
        formats.track_pieces(formats.track(spark, str(tmp_path / "c.mp4")), "imu").collect()


def test_table_functions(spark):
    tables.register(spark)
    data = chunked_file(2)
    rows = [(1, bytearray(data), bytearray(nest(b"CHNK", item(b"TSNS", b"12345678", b"J", 8) + item(b"X\xe9yz", b"abc"))), bytearray(sei_stream(6))), (2, None, None, None), (3, bytearray(b"\x00\x00\x00\x05bad"), bytearray(b"CH"), bytearray(b"\x00\x00"))]
    spark.createDataFrame(rows, "id int, mp4 binary, klv binary, nal binary").createOrReplaceTempView("held")
    walked = spark.sql("select b.* from held, lateral mp4_boxes(mp4) b order by low").collect()
    assert [r["kind"] for r in walked] == ["ftyp", "mdat", "moov", "trak", "mdia", "minf", "stbl", "stsd", "trak", "mdia", "minf", "stbl", "stsd", "stsz", "stco", "udta", "tmfm", "tmfc"]
    assert walked[-1]["path"] == "/moov/udta/tmfc" and data[walked[-1]["low"] : walked[-1]["high"]] == b"CAL"
    items = spark.sql("select i.* from held, lateral klv_items(klv) i order by pos").collect()
    assert [(r["path"], r["size"], bytes(r["payload"])) for r in items] == [("/CHNK/TSNS", 8, b"12345678"), ("/CHNK/Xéyz", 1, b"abc")]
    units = spark.sql("select u.* from held, lateral nal_units(nal) u order by pos").collect()
    packets = spark.sql("select p.*, (select count(*) from held h, lateral sei_samples(h.nal)) total from held, lateral sei_packets(nal) p").collect()
    assert {6} < {r["kind"] for r in units} and sum(r["n"] for r in packets) == packets[0]["total"] > 0


def test_many_small_ranges_are_few_tasks_and_batches(spark, tmp_path, monkeypatch):
    """Ranges of a byte are enlarged where they would be thousands of tasks; files' rows are put together to whole batches."""
    columns = {"frame_number": np.arange(5), "ts_ns": np.arange(5)}
    for k in range(40):
        (tmp_path / f"r{k}.vts").write_bytes(records.encode_vts({"version": 1, "frame_rate_milli": 30000}, columns))
    monkeypatch.setattr(formats, "TASKS", 8)
    reader = formats.VtsSource({"path": str(tmp_path), "splitBytes": "1"}).reader(T.StructType.fromDDL("recording_id string, frame_idx long"))
    reader.options = {"path": str(tmp_path), "splitbytes": "1"}
    found = reader.partitions()
    assert len(found) <= 16
    batches = [list(reader.read(p)) for p in found]
    assert all(len(b) <= 1 for b in batches) and sum(x.num_rows for b in batches for x in b) == 200
    assert len({r for b in batches for x in b for r in zip(*(c.to_pylist() for c in x.columns), strict=True)}) == 200


def written(path, names, **more):
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([0] * len(names), pa.int32()), pa.array([n.encode() for n in names], pa.binary())], names=["recording_id", "part", "content"])
    sink = formats.FileSink({"path": str(path), "extension": "bin"} | more, False)
    return sink, sink.write(iter([batch]))


def test_what_a_task_tells_the_driver_does_not_grow_with_its_files(spark, tmp_path):
    """Names stay in the task's folder; the driver's commit and the one by tasks find them there, and the same errors."""
    names = [f"long name of a recording {k}\n" for k in range(3000)]
    sink, told = written(tmp_path, names)
    assert len(pickle.dumps(told)) < 1000
    with pytest.raises(ValueError, match="two tasks"):
        sink.commit([told, told])
    sink.commit([told, None])
    assert sorted(os.listdir(tmp_path)) == sorted(names)
    assert (tmp_path / names[7] / "part000.bin").read_bytes() == names[7].encode()
    sink, told = written(tmp_path, names[:1], job="a")
    assert not sink.commit([told]) and sorted(os.listdir(tmp_path / "_pending-a"))[-1] == "tasks"
    with pytest.raises(FileExistsError, match="part000"):
        formats._place(spark, str(tmp_path), [(told.folder, told.files)], False)
    _, twice = written(tmp_path, names[:1], job="a")
    with pytest.raises(ValueError, match="two tasks"):
        formats._place(spark, str(tmp_path), [(told.folder, 1), (twice.folder, 1)], True)
    formats._place(spark, str(tmp_path), [(told.folder, told.files)], True)
    assert os.listdir(told.folder) == ["names"]


def test_moves_may_be_repeated(tmp_path):
    """A task that runs again finds some of its files moved; one that is nowhere is an error."""
    source, _ = formats.filesystem(str(tmp_path))
    moves = [(str(tmp_path / f"{k}"), f"r{k}/part000.bin") for k in range(3)]
    for old, _ in moves:
        with open(old, "w") as f:
            f.write(old)
    formats.move(source, str(tmp_path), moves[:2])
    formats.move(source, str(tmp_path), moves)
    assert [(tmp_path / name).read_text() for _, name in moves] == [old for old, _ in moves]
    with pytest.raises(FileNotFoundError):
        formats.move(source, str(tmp_path), [(str(tmp_path / "9"), "r9/part000.bin")])


def test_folders_are_listed_and_ranges_dealt_by_tasks(spark, folder, tmp_path):
    """Tasks list what the driver would; hidden files and folders, and those of other kinds, are left out at all levels."""
    for name in ("a/b/c/x.vts", "a/_b/x.vts", "_a/x.vts", ".a.vts", "b.vts/part001.vts", "x.imu", "top.vts", "a/.x.vts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345"[: len(name) % 5])
    for path, extension in ((str(tmp_path), "vts"), (str(tmp_path / "top.vts"), "vts"), (folder, "imu"), (folder, "tel")):
        assert sorted(map(tuple, formats.listing(spark, path, extension).collect())) == formats.listed({"path": path}, extension) != []
    found = formats.open_records(spark, folder, "imu", split=5_000)
    assert "BatchScan" not in found._jdf.queryExecution().toString()
    dealt = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(dealt) < 3 * sum(dealt) / len(dealt)


def test_runs_of_files():
    assert list(formats.runs(pa.array(["a", "a", "a", "b", None]), pa.array([0, 0, 1, 1, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 5)] and not list(formats.runs(pa.array([], pa.string()), pa.array([], pa.int32())))
