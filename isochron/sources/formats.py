"""Recordings as Spark data sources: byte ranges of files in, whole files out.

`open_records`, `headers`, `track` and `save` leave files to tasks: folders are listed, ranges dealt and finished files moved by
Spark jobs, so what the driver holds grows with the tasks, not with the files. `register(spark)` makes known to Spark itself,
whose driver plans their ranges and moves their files and so holds the names of all,

* `imu`, `vts`, `tel`: records of sidecar files. A file is read by as many tasks as it has ranges of `splitBytes`, each by
  seeking to its first whole record, a few megabytes at a time, so no file is ever one value. Only the columns of the
  schema that the caller gives are made; the options `recordings` (names, as JSON), `first` and `last` (the record's number
  in its file) choose files and byte ranges. `rows` = `headers` reads nothing but the headers. Spark's own pushing of
  filters is not used: in Spark 4.1.2 a data frame that is filtered twice keeps the first query's filters in its reader.
* `mp4track`: the metadata track of MP4 files, a row for each chunk. A task walks the boxes by their headers, loads the
  movie box and then the chunks whose offset lies in its range.
  Ranges are enlarged, up to 64 MB, where there would be more than 256 of them.
* `recordfiles`: a sink that puts pieces together to files, `<path>/<recording_id>/part<NNN>.<extension>`. A task writes to
  a folder of its own, with a list of their names; files get them when all tasks have ended, and a failed job leaves none.

Paths are of any file system that pyarrow knows (local or shared folders, HDFS, object stores); readers.files has the
same files, below Spark's bound of a value, from any store that Spark knows. A file shorter than its header, or with another
magic, is an error; a part of a record at the end of a file is left out, as is a chunk that reaches beyond it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from isochron.codecs import boxes, records
from isochron.operators import ordering
from isochron.sources import readers

#: Bytes of a file that one task reads, unless the option splitBytes says otherwise, and those that it holds at a time.
SPLIT, BLOCK = 64 << 20, 4 << 20
#: Tasks that small ranges are dealt to, rows of the batches that small files and chunks are put together to, threads that list and move files.
TASKS, ROWS, THREADS = 256, 4_096, 16
#: Files that a task lists or moves on average, at most; ranges that are still dealt one by one, and so exactly evenly.
FILES, EVEN = 10_000, 100_000
PART = re.compile(r"part(\d+)\.[^/.]+$")
TRACK = "recording_id string, part int, chunk long, items array<struct<key:string,kind:int,size:int,payload:binary>>, meta string, calibration binary"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = f"file://{path[5:]}"
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def named(path: str) -> tuple[str, int]:
    """(recording, part) of a file, by its path."""
    pieces = path.split("/")
    found = PART.match(pieces[-1])
    if found and len(pieces) > 1 and pieces[-2]:
        return pieces[-2], int(found[1])
    return pieces[-1].rsplit(".", 1)[0], 0


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last, first and last record wanted) of pieces of files."""

    pieces: list[tuple[str, int, int, int, int | None]]

    def __post_init__(self) -> None:
        super().__init__(None)


def listed(options: dict, extension: str) -> list[tuple[str, int]]:
    """(path, size) of the files of an extension at or below the option `path`."""
    source, base = filesystem(options["path"])
    info = source.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(options["path"])
    found = [info] if info.type == pafs.FileType.File else source.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(f".{extension}") and not hidden(f.path, base))


def hidden(path: str, base: str) -> bool:
    return any(p.startswith(("_", ".")) for p in path.removeprefix(base).split("/"))


def listing(spark: SparkSession, path: str, extension: str, recordings: list[str] | None = None) -> DataFrame:
    """(path, size) of the files that `listed` has: one task lists the folder itself, many those in it, with all below them."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = filesystem(path)
        for _ in batches:
            info = source.get_file_info(base)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == pafs.FileType.File else source.get_file_info(pafs.FileSelector(base))
            for low in range(0, len(found), ROWS):
                some = [f for f in found[low : low + ROWS] if not hidden(f.path, base)]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in some], pa.string()), pa.array([None if f.type == pafs.FileType.Directory else f.size for f in some], pa.int64())], names=["path", "size"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = filesystem(path)
        only = None if recordings is None else set(recordings)
        inside = lambda folder: [(f.path, f.size) for f in source.get_file_info(pafs.FileSelector(folder, recursive=True)) if f.type == pafs.FileType.File and not hidden(f.path, base)]
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                for found in ([row for row in rows if row[1] is not None], *pool.map(inside, [name for name, size in rows if size is None])):
                    kept = [f for f in found if f[0].endswith(f".{extension}") and (only is None or named(f[0])[0] in only)]
                    if kept:
                        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in kept], pa.string()), pa.array([f[1] for f in kept], pa.int64())], names=["path", "size"])

    kinds = "path string, size long"
    return ordering.dealt(spark.range(0, 1, 1, 1).mapInArrow(top, kinds), "path").mapInArrow(below, kinds)


class RangeReader(DataSourceReader):
    """Deals byte ranges of files to tasks, small files together."""

    extension, number = "", ""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.options = schema, dict(options)
        self.only = set(json.loads(options["recordings"])) if "recordings" in options else None
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[Ranges]:
        split = int(self.options.get("splitbytes", SPLIT))
        files = [(path, total) for path, total in listed(self.options, self.extension) if self.only is None or named(path)[0] in self.only]
        # Ranges grow, up to SPLIT, where they would be more than TASKS: a task costs more than the reading of a few bytes.
        split = max(split, min(sum(total for _, total in files) // TASKS, SPLIT))
        out, held, size = [], [], 0
        for path, total in files:
            for low in range(0, max(total, 1), split):
                piece = (path, low, min(low + split, total), self.first, self.last)
                if held and size + piece[2] - low > split:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(piece)
                size += piece[2] - low
        return [*out, Ranges(held)] if held or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        source, _ = filesystem(self.options["path"])
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for path, low, high, first, last in partition.pieces:
            with source.open_input_file(path) as file:
                for columns, n in self.ranged(file, low, high, first, last):
                    held.append(self.batch(path, columns, n))
                    rows, size = rows + n, size + held[-1].nbytes
                    if rows >= ROWS or size >= BLOCK:
                        yield _whole(held)
                        held, rows, size = [], 0, 0
        if held:
            yield _whole(held)

    def ranged(self, file: pa.NativeFile, low: int, high: int, first: int, last: int | None) -> Iterator[tuple[dict, int]]:
        raise NotImplementedError

    def batch(self, path: str, columns: dict, n: int) -> pa.RecordBatch:
        recording, part = named(path)
        arrays = []
        for field in self.schema.fields:
            if field.name == "recording_id":
                arrays.append(pa.array([recording] * n, pa.string()))
            elif field.name == "part":
                arrays.append(pa.array([part] * n, pa.int32()))
            elif isinstance(columns.get(field.name), list):
                arrays.append(pa.array(columns[field.name], KINDS.get(field.dataType.simpleString()) or TRACK_ITEMS))
            else:
                arrays.append(readers._column(field.name, field, columns.get(field.name), n))
        return pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
#: Keys of the inertial columns as they are named in items.
KEYS = {key.decode("latin-1"): key for key in boxes.COLUMNS}
TRACK_ITEMS = pa.list_(pa.struct([("key", pa.string()), ("kind", pa.int32()), ("size", pa.int32()), ("payload", pa.binary())]))


class RecordReader(RangeReader):
    """Records of fixed length behind a header."""

    head = 0

    def layout(self, header: bytes) -> tuple[int, int]:
        """(start of the records, bytes of one), by the header."""
        raise NotImplementedError

    def columns(self, data: bytes) -> dict[str, np.ndarray]:
        """Columns of a header and the records behind it."""
        raise NotImplementedError

    def ranged(self, file: pa.NativeFile, low: int, high: int, first: int, last: int | None) -> Iterator[tuple[dict, int]]:
        header = file.read_at(min(self.head, file.size()), 0)
        start, size = self.layout(header)
        whole = max(file.size() - start, 0) // size
        begin = max(-(-max(low - start, 0) // size), first)
        end = min(-(-max(high - start, 0) // size), whole, whole if last is None else last + 1)
        step = max(BLOCK // size, 1)
        for at in range(begin, end, step):
            n = min(step, end - at)
            found = self.columns(header + b"\x00" * (start - len(header)) + file.read_at(n * size, start + at * size))
            yield found | {self.number: np.arange(at, at + n)}, n


class ImuReader(RecordReader):
    extension, number, head = "imu", "sample_idx", records.IMU_HEADER_SIZE

    def layout(self, header: bytes) -> tuple[int, int]:
        return self.head, records.imu_record(records.decode_imu(header)[0]["version"]).itemsize

    def columns(self, data: bytes) -> dict[str, np.ndarray]:
        return records.decode_imu(data)[1]


class VtsReader(RecordReader):
    extension, number, head = "vts", "frame_idx", records.VTS_HEADER_SIZE

    def layout(self, header: bytes) -> tuple[int, int]:
        return self.head, records.vts_record(records.decode_vts(header)[0]["version"]).itemsize

    def columns(self, data: bytes) -> dict[str, np.ndarray]:
        return records.decode_vts(data)[1]


class TelReader(RecordReader):
    extension, number, head = "tel", "record_idx", records.TEL_HEADER_SIZE

    def layout(self, header: bytes) -> tuple[int, int]:
        records.decode_tel(header)
        size = int(np.frombuffer(header, records.TEL_HEADER, 1)[0]["header_size"])
        return max(size, self.head), records.TEL_RECORD.itemsize

    def columns(self, data: bytes) -> dict[str, np.ndarray]:
        rows = records.decode_tel(data)[1]
        return {name: rows[name].astype(np.int64) for name in rows.dtype.names}


class HeaderReader(RangeReader):
    """One row a file, by its first bytes."""

    def __init__(self, schema: T.StructType, options: dict, reader: type[RecordReader]) -> None:
        super().__init__(schema, options)
        self.extension, self.head, self.decode = reader.extension, reader.head, {"imu": records.decode_imu, "vts": records.decode_vts, "tel": records.decode_tel}[reader.extension]

    def ranged(self, file: pa.NativeFile, low: int, high: int, first: int, last: int | None) -> Iterator[tuple[dict, int]]:
        if not low:
            header = self.decode(file.read_at(min(self.head, file.size()), 0))[0]
            yield {f.name: [header.get(f.name)] for f in self.schema.fields}, 1


def top_boxes(file: pa.NativeFile) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes of a file's top level, of which only the headers are read."""
    at, end = 0, file.size()
    while at + 8 <= end:
        head = file.read_at(min(16, end - at), at)
        size, body = int.from_bytes(head[:4], "big"), 8
        if size == 1:
            size, body = int.from_bytes(head[8:16], "big"), 16
        size = size or end - at
        if size < body or at + size > end:
            return
        yield head[4:8], at + body, at + size
        at += size


class TrackReader(RangeReader):
    """Chunks of the metadata track; the first row of a file, or its only one, has its metadata and calibration."""

    extension, number = "mp4", "chunk"

    def ranged(self, file: pa.NativeFile, low: int, high: int, first: int, last: int | None) -> Iterator[tuple[dict, int]]:
        movies = [(a, b) for kind, a, b in top_boxes(file) if kind == b"moov"]
        if not movies:
            raise ValueError("no moov box")
        start, end = movies[-1]
        movie = file.read_at(end - start, start)
        meta, calibration = self.described(movie)
        chunks = []
        for kind, a, b in boxes.boxes(movie):
            described = boxes.find(movie, a, b, b"stsd") if kind == b"trak" else None
            if described and b"tmfd" in movie[described[0] : described[1]]:
                chunks = [(k, *span) for k, span in enumerate(boxes.chunk_ranges(movie, a, b)) if span[1] <= file.size()]
                break
        mine = [c for c in chunks if low <= c[1] < high and first <= c[0] and (last is None or c[0] <= last)]
        # The first range tells of the file, whether a chunk lies in it or not.
        if not low and not any(k == 0 for k, _, _ in mine) and not first:
            yield {"chunk": [None], "items": [[]], "meta": [meta], "calibration": [calibration]}, 1
        held: dict[str, list] = {"chunk": [], "items": [], "meta": [], "calibration": []}
        size = 0
        for k, a, b in mine:
            own = (meta, calibration) if not low and not k else (None, None)
            found = [{"key": key.decode("latin-1"), "kind": kind, "size": length, "payload": payload} for key, kind, length, payload in flat(file.read_at(b - a, a))]
            for name, value in zip(held, (k, found, *own), strict=True):
                held[name].append(value)
            size += b - a
            if size >= BLOCK or len(held["chunk"]) >= ROWS:
                yield held, len(held["chunk"])
                held, size = {name: [] for name in held}, 0
        if held["chunk"]:
            yield held, len(held["chunk"])

    @staticmethod
    def described(movie: bytes) -> tuple[str | None, bytes | None]:
        meta = calibration = None
        if extra := boxes.find(movie, 0, len(movie), b"udta"):
            for kind, a, b in boxes.boxes(movie, *extra):
                if kind == b"tmfm":
                    try:
                        meta = json.dumps(json.loads(movie[a:b]))
                    except ValueError:
                        meta = None
                elif kind == b"tmfc":
                    calibration = movie[a:b]
        return meta, calibration


def flat(data: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """The items of all levels that hold values."""
    for key, kind, size, payload in boxes.items(data):
        if kind == 0:
            yield from flat(payload)
        else:
            yield key, kind, size, payload


def runs(recordings: pa.Array, parts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, after the last) row of each run of rows of one recording part."""
    new = np.zeros(len(recordings), bool)
    new[:1] = True
    for column in (recordings, parts):
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new).tolist()
    yield from zip(starts, [*starts[1:], len(recordings)], strict=True) if starts else ()


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, in which the file `names` has the final names of the files 0, 1, .. in it, and how many they are."""

    folder: str
    files: int


def names_in(source: pafs.FileSystem, folder: str) -> list[str]:
    with source.open_input_stream(f"{folder}/names") as file:
        return [json.loads(line) for line in file.read().decode().split("\n") if line]


def there(source: pafs.FileSystem, base: str, names: list[str]) -> list[str]:
    """The names of files that are there already."""
    return [name for name, info in zip(names, source.get_file_info([f"{base}/{name}" for name in names]), strict=True) if info.type != pafs.FileType.NotFound] if names else []


def move(source: pafs.FileSystem, base: str, moves: list[tuple[str, str]]) -> None:
    """Files (where they are, final name) to their places; those that an earlier attempt has moved are left there."""

    def one(pair: tuple[str, str]) -> None:
        old, new = pair[0], f"{base}/{pair[1]}"
        try:
            source.move(old, new)
        except OSError:
            if source.get_file_info(old).type != pafs.FileType.NotFound or source.get_file_info(new).type == pafs.FileType.NotFound:
                raise

    with ThreadPoolExecutor(THREADS) as pool:
        for low in range(0, len(moves), ROWS):
            some = moves[low : low + ROWS]
            list(pool.map(lambda folder: source.create_dir(f"{base}/{folder}"), sorted({name.split("/")[0] for _, name in some})))
            list(pool.map(one, some))


class FileSink(DataSourceArrowWriter):
    """Pieces, sorted by file, to files that appear when the whole job has succeeded.

    With the option `job`, the folders of the tasks that succeeded are listed in the job's own, and `save` moves the files.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.extension, self.overwrite, self.later = options["path"], options["extension"], overwrite, "job" in options
        self.job = options["job"] if self.later else uuid.uuid4().hex

    def _base(self) -> tuple[pafs.FileSystem, str]:
        source, base = filesystem(self.path)
        return source, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        source, base = self._base()
        folder = f"{base}/_pending-{self.job}/{uuid.uuid4().hex}"
        source.create_dir(folder)
        done: dict[str, int] = {}
        name, out = None, None
        try:
            for batch in iterator:
                recordings, parts, contents = (batch.column(c) for c in ("recording_id", "part", "content"))
                for low, high in runs(recordings, parts):
                    recording, part = recordings[low].as_py(), parts[low].as_py()
                    if not recording or "/" in recording or recording in (".", ".."):
                        raise ValueError(f"no name for a folder: {recording!r}")
                    wanted = f"{recording}/part{part or 0:03d}.{self.extension}"
                    if wanted != name:
                        if wanted in done:
                            raise ValueError(f"pieces of {wanted} do not stand together")
                        if out is not None:
                            out.close()
                        name, done[wanted] = wanted, len(done)
                        out = source.open_output_stream(f"{folder}/{done[wanted]}")
                    out.write(b"".join(x for x in contents.slice(low, high - low).to_pylist() if x))
        finally:
            if out is not None:
                out.close()
        with source.open_output_stream(f"{folder}/names") as file:
            file.write("".join(f"{json.dumps(name)}\n" for name in done).encode())
        return Written(folder, len(done))

    def commit(self, messages: list[Written | None]) -> None:
        source, base = self._base()
        folders = [m.folder for m in messages if m is not None]
        source.create_dir(f"{base}/_pending-{self.job}")
        if self.later:
            with source.open_output_stream(f"{base}/_pending-{self.job}/tasks") as file:
                file.write(json.dumps([(m.folder, m.files) for m in messages if m is not None]).encode())
            return
        moves = [(f"{folder}/{k}", name) for folder in folders for k, name in enumerate(names_in(source, folder))]
        finals = [name for _, name in moves]
        if len(set(finals)) < len(finals):
            raise ValueError("pieces of one file came from two tasks")
        if not self.overwrite and (found := there(source, base, finals)):
            raise FileExistsError(f"{base}/{found[0]}")
        move(source, base, moves)
        source.delete_dir(f"{base}/_pending-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        source, base = self._base()
        if source.get_file_info(f"{base}/_pending-{self.job}").type != pafs.FileType.NotFound:
            source.delete_dir(f"{base}/_pending-{self.job}")


class _Records(DataSource):
    reads: type[RecordReader]
    ddl = headers = ""

    @classmethod
    def name(cls) -> str:
        return cls.reads.extension

    def schema(self) -> str:
        return self.headers if self.options.get("rows") == "headers" else self.ddl

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if self.options.get("rows") == "headers":
            return HeaderReader(schema, self.options, self.reads)
        return self.reads(schema, self.options)


class ImuSource(_Records):
    reads, ddl, headers = ImuReader, readers.SAMPLES, readers.HEADER


class VtsSource(_Records):
    reads, ddl, headers = VtsReader, readers.FRAMES, readers.VTS_HEADERS


class TelSource(_Records):
    reads, ddl, headers = TelReader, readers.TELEMETRY + ", record_idx long", "recording_id string, part int, version int, record_count long, device_id string"


SOURCES = {kind.name(): kind for kind in (ImuSource, VtsSource, TelSource)}


class TrackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4track"

    def schema(self) -> str:
        return TRACK

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TrackReader(schema, self.options)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordfiles"

    def schema(self) -> str:
        return "recording_id string, part int, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FileSink(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (*SOURCES.values(), TrackSource, RecordFiles):
        spark.dataSource.register(source)


def save(pieces: DataFrame, path: str, extension: str, overwrite: bool = False) -> None:
    """Write (recording_id, part, seq, content) pieces, in the order of seq, to one file for each recording part.

    Pieces are shuffled by file and streamed, so a file may be of any size. Files that are there are an error, or replaced
    with `overwrite`; others in the folder stay. A null recording has no name, which is an error; a null part is part 0.
    """
    spark, job = pieces.sparkSession, uuid.uuid4().hex
    register(spark)
    source, base = filesystem(path)
    base = base.rstrip("/")
    fresh = source.get_file_info(base).type == pafs.FileType.NotFound
    ordered = pieces.repartition("recording_id", "part").sortWithinPartitions("recording_id", "part", "seq").select("recording_id", "part", "content")
    ordered.write.format("recordfiles").option("path", path).option("extension", extension).option("job", job).mode("overwrite" if overwrite else "append").save()
    try:
        with source.open_input_stream(f"{base}/_pending-{job}/tasks") as file:
            folders = json.loads(file.read())
        _place(spark, path, [(folder, n) for folder, n in folders if n], overwrite or fresh)
    finally:
        source.delete_dir(f"{base}/_pending-{job}")


def _place(spark: SparkSession, path: str, folders: list[tuple[str, int]], overwrite: bool) -> None:
    """Move the files in tasks' folders to their places, by as many tasks as they need, when no two and none that is there have a name in common."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = filesystem(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names = names_in(source, folder)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{k}" for k in range(len(names))], pa.string()), pa.array(names, pa.string())], names=["old", "name"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = filesystem(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(there(source, base.rstrip("/"), batch.column("name").to_pylist()), pa.string())], names=["name"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = filesystem(path)
        for batch in batches:
            move(source, base.rstrip("/"), list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    if not folders:
        return
    n = sum(files for _, files in folders)
    names = ordering.spread(spark.createDataFrame(folders, "folder string, files long").mapInArrow(told, "old string, name string"), n, "name", most=FILES)
    if names.groupBy("name").count().filter("count > 1").limit(1).collect():
        raise ValueError("pieces of one file came from two tasks")
    if not overwrite and (found := names.mapInArrow(taken, "name string").limit(1).collect()):
        raise FileExistsError(f"{path}/{found[0]['name']}")
    if (done := names.mapInArrow(moved, "files long").agg(F.sum("files")).first()[0]) != n:
        raise ValueError(f"{done} of {n} files have been moved")


def _opened(spark: SparkSession, path: str, reader: RangeReader, split: int) -> DataFrame:
    """What a reader makes of the files' ranges, which are dealt as `partitions` deals them."""
    recordings = None if reader.only is None else sorted(reader.only)
    files = ordering.cut(listing(spark, path, reader.extension, recordings))
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    split = max(split, min(total // TASKS, SPLIT))
    first, last = reader.first, reader.last
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(split).cast("long"))).alias("low"))
    few = files.agg(F.coalesce(F.sum(F.greatest(F.ceil(F.col("size") / split), F.lit(1))), F.lit(0))).first()[0] <= EVEN

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield from reader.read(Ranges([(name, low, min(low + split, size), first, last) for name, size, low in pieces]))

    return (ranges.coalesce(1) if few else ranges).repartition(max(-(-total // split), 1)).mapInArrow(each, reader.schema)


def open_records(spark: SparkSession, path: str, extension: str, columns: str | None = None, recordings: list[str] | None = None, first: int = 0, last: int | None = None, split: int = SPLIT) -> DataFrame:
    """Records of all files of an extension below a path.

    `columns` is the DDL of those wanted; of files of the named recordings, or of all, the records numbered first to last.
    """
    kind = SOURCES[extension]
    options = {"path": path, "first": first} | ({} if last is None else {"last": last}) | ({} if recordings is None else {"recordings": json.dumps(recordings)})
    return _opened(spark, path, kind.reads(T.StructType.fromDDL(columns or kind.ddl), options), split)


def headers(spark: SparkSession, path: str, extension: str) -> DataFrame:
    kind = SOURCES[extension]
    return _opened(spark, path, HeaderReader(T.StructType.fromDDL(kind.headers), {"path": path}, kind.reads), SPLIT)


def track(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Chunks of the metadata tracks of all MP4 files below a path."""
    return _opened(spark, path, TrackReader(T.StructType.fromDDL(TRACK), {"path": path}), split)


def track_info(chunks: DataFrame) -> DataFrame:
    """Counts of each file's chunks, samples, frames and telemetry, with its metadata and calibration."""
    item = F.explode_outer("items").alias("item")
    rows = chunks.select("recording_id", "part", "chunk", "meta", "calibration", item)
    key, length = F.col("item.key"), F.length("item.payload")
    whole = lambda test, size: F.coalesce(F.sum(F.when(test, F.floor(length / size))), F.lit(0)).cast("long")
    return rows.groupBy("recording_id", "part").agg(
        F.count_distinct("chunk").alias("chunks"), whole(key == "TSNS", 8).alias("samples"), whole((key == "TFRM") & (F.col("item.size") > 0), F.greatest("item.size", F.lit(1))).alias("frames"), whole(key == "TSOC", records.TEL_RECORD.itemsize).alias("telemetry"),
        F.max("meta").alias("meta"), F.max("calibration").alias("calibration"))


def track_pieces(chunks: DataFrame, extension: str) -> DataFrame:
    """The sidecar files that the tracks embed, as pieces for `save`: the first header, then each chunk's records.

    Inertial records are put together from the chunks' columns by the version in the first header, which is brought to all
    chunks of its file by a window; chunks that follow each other and have columns of the same lengths make one piece, up to a
    few megabytes. The telemetry header's record count is that of the records.
    """
    header = {"imu": "IHDR", "vts": "VHDR", "tel": "THDR"}[extension]
    rows = chunks.filter("chunk is not null").select("recording_id", "part", "chunk", "items")
    items = rows.select("recording_id", "part", "chunk", F.posexplode("items").alias("at", "item"))
    first = items.filter(F.col("item.key") == header).groupBy("recording_id", "part").agg(F.min_by("item.payload", F.struct("chunk", "at")).alias("header"))
    if extension != "imu":
        key = "TFRM" if extension == "vts" else "TSOC"
        body = items.filter(F.col("item.key") == key).join(first.drop("header"), ["recording_id", "part"]).select("recording_id", "part", F.struct("chunk", "at").alias("seq"), F.col("item.payload").alias("content"))
        front = first
        if extension == "tel":
            counts = items.filter(F.col("item.key") == key).groupBy("recording_id", "part").agg(F.floor(F.sum(F.length("item.payload")) / records.TEL_RECORD.itemsize).alias("n"))
            n = F.lpad(F.hex(F.coalesce("n", F.lit(0)).cast("long")), 16, "0")
            little = F.unhex(F.concat(*(F.substring(n, k, 2) for k in (15, 13, 11, 9))))
            front = first.join(counts, ["recording_id", "part"], "left").withColumn("header", F.concat(F.substring("header", 1, 16), little, F.expr("substring(header, 21)")))
        return front.select("recording_id", "part", F.struct(F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("at")).alias("seq"), F.col("header").alias("content")).unionByName(body)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seqs, contents = [], [], []

            def done(first: int, seq: int, held: boxes.Track) -> None:
                whole = held.imu_bytes()
                at.append(first)
                seqs.append(seq)
                contents.append(whole[len(held.headers["imu"]) :] if whole else b"")

            # Items of all chunks side by side: nested values would cost more than all else.
            ends = np.cumsum([0, *batch.column("items").value_lengths().fill_null(0).to_pylist()]).tolist()
            found = batch.column("items").flatten()
            keys, payloads = (found.field(c).to_pylist() for c in ("key", "payload"))
            run: tuple | None = None  # place and number of its first chunk, its track, what its chunks have in common
            last = size = 0
            for k, (recording, part, seq, head, front) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("recording_id", "part", "seq", "header", "front")), strict=True)):
                columns: dict[bytes, bytes] = {}
                for key, payload in zip(keys[ends[k] : ends[k + 1]], payloads[ends[k] : ends[k + 1]], strict=True):
                    if key in KEYS:
                        columns[KEYS[key]] = columns.get(KEYS[key], b"") + payload
                alike = recording, part, head, sorted((key, len(payload)) for key, payload in columns.items())
                if run and (run[3] != alike or seq <= last or size >= BLOCK):
                    done(*run[:3])
                    run = None
                if front:
                    at.append(k)
                    seqs.append(-1)
                    contents.append(head)
                if not run:
                    run, size = (k, seq, boxes.Track(headers={"imu": head}), alike), 0
                for key, payload in columns.items():
                    run[2].columns.setdefault(key, bytearray()).extend(payload)
                    size += len(payload)
                last = seq
            if run:
                done(*run[:3])
            named = batch.select(["recording_id", "part"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*named.columns, pa.array(seqs, pa.int64()), pa.array(contents, pa.binary())], names=["recording_id", "part", "seq", "content"])

    # Chunks are read once and meet by file, where each is told its file's first header.
    own = F.get(F.filter("items", lambda x: x["key"] == header), F.lit(0))["payload"]
    w = W.partitionBy("recording_id", "part").orderBy("chunk")
    told = rows.withColumn("own", own).select("recording_id", "part", F.col("chunk").alias("seq"), "items", F.first("own", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("header"), (F.row_number().over(w) == 1).alias("front"))
    return told.filter("header is not null").mapInArrow(each, "recording_id string, part int, seq long, content binary")


def record_pieces(rows: DataFrame, header: DataFrame, extension: str, block: int = 20_000) -> DataFrame:
    """Samples (`imu`) or frames (`vts`) and their headers as pieces for `save`, a block of records a piece.

    The version in the header chooses the layout; columns that are missing or null are written as zeros. Blocks are cut at
    every `block` numbers of sample_idx or frame_idx, so a recording is encoded by many tasks.
    """
    encode, number, size = (records.encode_imu, "sample_idx", records.IMU_HEADER_SIZE) if extension == "imu" else (records.encode_vts, "frame_idx", records.VTS_HEADER_SIZE)
    keys = ["recording_id", "part"]
    versions = header.select(*keys, F.col("version").alias("layout"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def blocks(table: pa.Table) -> pa.Table:
        from isochron.sources.writers import _numpy

        group = table.sort_by(number)
        columns = {c: _numpy(group[c]) for c in group.column_names if c not in (*keys, "layout", "block", number)}
        content = encode({"version": group["layout"][0].as_py()}, columns)[size:]
        return pa.table({**{k: group[k].slice(0, 1) for k in keys}, "seq": group["block"].slice(0, 1), "content": pa.array([content], pa.binary())})

    body = rows.join(versions, keys).withColumn("block", F.floor(F.col(number) / block)).groupBy(*keys, "block").applyInArrow(blocks, f"{kinds}, seq long, content binary")

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = {c: np.empty((0, w) if w else 0) for c, w in (("ts_ns", 0), ("frame_number", 0))}
            contents = [encode({k: v for k, v in row.items() if v is not None}, empty) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("part"), pa.array([-1] * batch.num_rows, pa.int64()), pa.array(contents, pa.binary())], names=["recording_id", "part", "seq", "content"])

    return header.mapInArrow(fronts, f"{kinds}, seq long, content binary").unionByName(body)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; where none is set, of this machine under a local master."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="isochron-"))
        base = sc.getCheckpointDir()
    return f"{base}/files-{uuid.uuid4().hex}"
