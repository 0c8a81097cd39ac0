"""Registered queries over files whose bytes are put together by SQL from the driver's tables, not by our encoders.

Each writes the pieces with the sink, reads the files back through a data source or takes the bytes apart with a table
function, and is compared with a DuckDB statement over the numbers themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions import scalar
from isochron.operators import asof, charts, ordering, signal
from isochron.queries import _SIDES, DAY, E, events, query
from isochron.recording_queries import _N, _numbered
from isochron.sources import formats, readers, tables, writers
from isochron.streaming import ordered, stream

#: A few floats and their bytes on disk, by number; and the DuckDB list of them.
FLOATS = ((0.0, "00000000"), (1.0, "0000803F"), (2.0, "00000040"), (0.5, "0000003F"), (-1.5, "0000C0BF"))
_LIST = "(CAST([0.0, 1.0, 2.0, 0.5, -1.5] AS DOUBLE[]))"


def le(number: Column | int, size: int) -> Column:
    """Hexadecimal digits of a whole number, least byte first."""
    digits = F.lpad(F.hex((F.lit(number) if isinstance(number, int) else number).cast("long")), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size)))


def be(number: Column | int, size: int) -> Column:
    digits = F.lpad(F.hex((F.lit(number) if isinstance(number, int) else number).cast("long")), 16, "0")
    return F.substring(digits, 17 - 2 * size, 2 * size)


def f4(which: Column) -> Column:
    return F.element_at(F.array(*(F.lit(h) for _, h in FLOATS)), (which % len(FLOATS) + 1).cast("int"))


def text(value: str) -> Column:
    return F.lit(value.encode().hex())


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


def _piece(rows: DataFrame, seq: Column, digits: Column) -> DataFrame:
    return rows.select("recording_id", "part", seq.cast("long").alias("seq"), F.unhex(digits).alias("content"))


def _users(rows: DataFrame) -> DataFrame:
    return rows.select("recording_id", "part", "user_id").distinct()


def _float(k: str) -> str:
    return f"{_LIST}[({k}) % 5 + 1]"


def _sample(version: Column) -> Column:
    """One inertial record of a version: time, vectors, then what later versions added."""
    zero = F.lit("00000000")
    k = F.col("event_id")
    first = joined(le(F.col("u"), 8), zero, zero, f4(k), f4(k + 1), zero, zero, f4(F.col("cents")), zero, zero)
    second = joined(f4(k + 2), zero, zero, zero, f4(k + 3), zero, f4(k + 4), zero)
    return joined(first, F.when(version >= 2, second).otherwise(""), F.when(version >= 3, f4(F.col("cents") + 1)).otherwise(""))


def _imu_header(version: Column, user: Column) -> Column:
    device = F.when(version >= 3, F.lpad(F.lower(F.hex(user)), 32, "0")).otherwise("00" * 16)
    return joined(text("TRIMU001"), le(version, 4), le(400 + user % 3, 4), le(user % 4, 2), le(user % 3, 2), le(user * 5, 8), le(user * 7, 8), le(F.when(version >= 3, user % 4).otherwise(0), 4), device, le(F.when(version >= 4, -user).otherwise(0), 8))


def _imu(spark: SparkSession, sf_dir: str) -> str:
    rows = _numbered(spark, sf_dir)
    version = F.col("user_id") % 6 + 1
    pieces = _piece(_users(rows), F.lit(-1), _imu_header(version, F.col("user_id"))).union(_piece(rows, F.col("i"), _sample(version)))
    path = formats.scratch(spark)
    formats.save(pieces, path, "imu")
    return path


@query(_N + f""" SELECT CAST(user_id AS VARCHAR) AS recording_id, i AS sample_idx, u AS ts_ns, {_float("event_id")} AS accel_z, {_float("event_id + 1")} AS gyro_x, {_float("cents")} AS mag_x,
CASE WHEN v >= 2 THEN {_float("event_id + 2")} END AS temp_c, CASE WHEN v >= 2 THEN {_float("event_id + 3")} END AS quat_w, CASE WHEN v >= 2 THEN {_float("event_id + 4")} END AS lin_y,
CASE WHEN v IN (3, 4) THEN {_float("cents + 1")} END AS fsync_delay_us, CASE WHEN v >= 5 THEN {_float("cents + 1")} END AS mag_age_us FROM (SELECT *, user_id % 6 + 1 AS v FROM n)""")
def imu_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertial files of all six versions through the sink and the data source, in ranges of 64 KB."""
    rows = formats.open_records(spark, _imu(spark, sf_dir), "imu", split=1 << 16)
    parts = {"accel_z": "accel.z", "gyro_x": "gyro.x", "mag_x": "mag.x", "temp_c": "temp_c", "quat_w": "quat.w", "lin_y": "lin_accel.y", "fsync_delay_us": "fsync_delay_us", "mag_age_us": "mag_age_us"}
    return rows.select("recording_id", "sample_idx", "ts_ns", *(F.col(c).cast("double").alias(name) for name, c in parts.items()))


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS recording_id, CASE WHEN v < 3 OR user_id = 0 THEN '' ELSE lpad(lower(hex(user_id)), 32, '0') END AS device_id, v AS version, 400 + user_id % 3 AS rate_hz, user_id % 4 AS accel_fs, user_id % 3 AS gyro_fs,
CASE WHEN v >= 3 THEN user_id % 4 ELSE 0 END AS flags, user_id * 5 AS start_ns, user_id * 7 AS video_start_ns, CASE WHEN v >= 4 THEN -user_id END AS host_offset_ns FROM (SELECT *, user_id % 6 + 1 AS v FROM events)""")
def imu_header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of those files, of which nothing else is read."""
    rows = formats.headers(spark, _imu(spark, sf_dir), "imu")
    return rows.select("recording_id", "device_id", *(F.col(c).cast("long").alias(c) for c in ("version", "rate_hz", "accel_fs", "gyro_fs", "flags", "start_ns", "video_start_ns", "host_offset_ns")))


def _vts(spark: SparkSession, sf_dir: str) -> str:
    rows, user = _numbered(spark, sf_dir), F.col("user_id")
    version = user % 4 + 1
    header = joined(text("TRIVTS01"), le(version, 4), le(29_000 + user, 4), F.when(version >= 3, joined(le(-user * 1000, 8), le((user % 7 - 3) * 28617, 4), le(user % 900, 2), le(user % 4, 2))).otherwise("00" * 16))
    later = joined(le(F.col("i"), 4), le(F.col("u"), 8))
    entry = joined(le(F.col("i"), 4), le(F.col("u") + 1, 8), F.when(version >= 2, later).otherwise(""), F.when(version >= 4, joined(le(F.col("cents") % 1000, 4), le(F.col("event_id") % 16, 4), le(F.col("cents") % 30000, 4))).otherwise(""))
    path = formats.scratch(spark)
    formats.save(_piece(_users(rows), F.lit(-1), header).union(_piece(rows, F.col("i"), entry)), path, "vts")
    return path


@query(_N + """ SELECT CAST(user_id AS VARCHAR) AS recording_id, i AS frame_idx, i AS frame_number, CASE WHEN v = 1 THEN u + 1 ELSE u * 1000 END AS ts_ns, CASE WHEN v > 1 THEN u + 1 END AS sof_ns, CASE WHEN v > 1 THEN i END AS venc_seq, CASE WHEN v > 1 THEN u END AS venc_pts_us,
CASE WHEN v = 4 THEN cents % 1000 END AS exposure_us, CASE WHEN v = 4 THEN event_id % 16 END AS timing_flags, CASE WHEN v = 4 THEN cents % 30000 END AS readout_us FROM (SELECT *, user_id % 4 + 1 AS v FROM n)""")
def vts_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-timing files of all four versions."""
    return formats.open_records(spark, _vts(spark, sf_dir), "vts", split=1 << 16).drop("part")


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS recording_id, v AS version, 29000 + user_id AS frame_rate_milli, CASE WHEN v > 2 THEN -user_id * 1000 ELSE 0 END AS offset_ns, CASE WHEN v > 2 THEN (user_id % 7 - 3) * 28617 ELSE 0 END AS skew_ppb,
CASE WHEN v > 2 THEN user_id % 900 ELSE 0 END AS quality_us, CASE WHEN v > 2 THEN user_id % 4 ELSE 0 END AS sync_flags FROM (SELECT *, user_id % 4 + 1 AS v FROM events)""")
def vts_header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.headers(spark, _vts(spark, sf_dir), "vts")
    return rows.select("recording_id", *(F.col(c).cast("long").alias(c) for c in ("version", "frame_rate_milli", "offset_ns", "skew_ppb", "quality_us", "sync_flags")))


@query(_N + """ SELECT CAST(user_id AS VARCHAR) AS recording_id, i AS record_idx, u AS ts_ns, -cents AS temp_milli_c, cents AS cpu_khz, cents % 9000 AS bitrate_kbps, cents % 60 AS fps, event_id % 4 AS thermal_state, event_id % 3 AS led_state FROM n""")
def tel_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry files whose headers are 40 bytes long, of which readers know 32."""
    rows, user, cents, k = _numbered(spark, sf_dir), F.col("user_id"), F.col("cents"), F.col("event_id")
    header = joined(text("TRTEL01"), F.lit("00"), le(1, 4), le(40, 4), le(0, 4), le(0, 4), be(user, 8), F.lit("FF" * 8))
    record = joined(le(F.col("u"), 8), le(-cents, 4), le(cents, 4), le(cents % 9000, 4), le(cents % 60, 2), le(k % 4, 1), le(k % 3, 1))
    path = formats.scratch(spark)
    formats.save(_piece(_users(rows), F.lit(-1), header).union(_piece(rows, F.col("i"), record)), path, "tel")
    found = formats.open_records(spark, path, "tel", split=1 << 16)
    return found.select("recording_id", *(F.col(c).cast("long").alias(c) for c in ("record_idx", "ts_ns", "temp_milli_c", "cpu_khz", "bitrate_kbps", "fps", "thermal_state", "led_state")))


def _item(key: str, kind: str, size: int, repeat: Column | int, payload: Column) -> Column:
    return joined(text(key), text(kind), le(size, 1), le(repeat, 2), payload)


def _nest(key: str, length: Column | int, *parts: Column) -> Column:
    """A container: its type is zero and its length counts words of four bytes."""
    quarter = length // 4 if isinstance(length, int) else F.floor(length / 4)
    return joined(text(key), F.lit("0001"), le(quarter, 2), *parts)


_LE = "array_to_string(list_reverse(regexp_extract_all(printf('%016x', {0}), '..')), '')"


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT event_id, 0 AS pos, '/GRPA/TSNS' AS path, 8 AS size, {_LE.format("t")} || {_LE.format("cents")} AS payload FROM e UNION ALL
SELECT event_id, 1, '/GRPA/GRPB/NOTE', 1, repeat('2a', event_id % 6) FROM e UNION ALL SELECT event_id, 2, '/LAST', 4, {_LE.format("event_id")}[1:8] FROM e""")
def klv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested and padded items of a key-length-value stream by the table function klv_items."""
    tables.register(spark)
    k = F.col("event_id")
    pad = (4 - k % 6 % 4) % 4
    note = joined(_item("NOTE", "c", 1, k % 6, F.expr("repeat('2A', cast(event_id % 6 as int))")), F.expr("repeat('00', cast((4 - event_id % 6 % 4) % 4 as int))"))
    inner = _nest("GRPB", 8 + k % 6 + pad, note)
    outer = _nest("GRPA", 24 + 16 + k % 6 + pad, _item("TSNS", "J", 8, 2, joined(le(F.col("t"), 8), le(F.col("cents"), 8))), inner)
    rows = events(spark, sf_dir).select("event_id", F.unhex(joined(outer, _item("LAST", "L", 4, 1, le(k, 4)))).alias("content"))
    found = spark.sql("SELECT r.event_id, i.pos, i.path, i.size, lower(hex(i.payload)) AS payload FROM {rows} r, LATERAL klv_items(r.content) i", rows=rows)
    return found


def _box(kind: str, length: Column | int, *parts: Column) -> Column:
    """length: bytes of the body."""
    return joined(be(length + 8, 4), text(kind), *parts)


@query("""WITH e AS (SELECT event_id, event_id % 5 AS a, CAST(round(value * 100) AS BIGINT) % 10 AS b FROM events)
SELECT event_id, 0 AS depth, '/ftyp' AS path, 8 AS low, 12 AS high FROM e UNION ALL SELECT event_id, 0, '/moov', 20, 36 + a FROM e UNION ALL SELECT event_id, 1, '/moov/trak', 28, 36 + a FROM e UNION ALL
SELECT event_id, 2, '/moov/trak/tkhd', 36, 36 + a FROM e UNION ALL SELECT event_id, 0, '/mdat', 52 + a, 52 + a + b FROM e UNION ALL SELECT event_id, 0, '/free', 60 + a + b, 63 + a + b FROM e""")
def mp4_box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in containers, one with a 64-bit size and a last one that reaches to the end, by the table function mp4_boxes."""
    tables.register(spark)
    a, b = F.col("event_id") % 5, F.col("cents") % 10
    head = _box("tkhd", a, F.expr("repeat('AB', cast(event_id % 5 as int))"))
    movie = _box("moov", 16 + a, _box("trak", 8 + a, head))
    data = joined(be(1, 4), text("mdat"), be(16 + b, 8), F.expr("repeat('CD', cast(cents % 10 as int))"))
    rows = events(spark, sf_dir).select("event_id", F.unhex(joined(_box("ftyp", 4, text("isom")), movie, data, be(0, 4), text("free"), F.lit("EEEEEE"))).alias("content"))
    return spark.sql("SELECT r.event_id, b.depth, b.path, b.low, b.high FROM {rows} r, LATERAL mp4_boxes(r.content) b", rows=rows)


#: The identifier of an inertial payload, a fixed value.
_PAYLOAD = "5452494e4554494d5553454900010000"


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One elementary stream an event: a message unit with emulation prevention, a coded picture, and a zero at the end."""
    k, zero = F.col("event_id"), F.lit("00000000")
    version, n = 5 + k % 2, k % 4
    timing = joined(le(F.col("t"), 8), le(F.col("cents"), 4), le(k % 16, 1), le(26470, 4))
    samples = [joined(le(F.col("t") + j, 8), zero, zero, f4(k + j), f4(k + j + 1), zero, zero, zero, zero, zero, f4(k + j + 2), zero, zero, zero, F.lit("0000803F"), zero, zero, zero, f4(F.col("cents") + j)) for j in range(3)]
    body = joined(F.lit(_PAYLOAD), le(version, 1), le(n, 2), le(k % 3, 2), le(k % 5, 2), F.when(version == 6, timing).otherwise(""), *(F.when(n > j, s).otherwise("") for j, s in enumerate(samples)))
    # Streams are made and read by many tasks, though the events are a small file.
    rows = ordering.dealt(events(spark, sf_dir), "event_id").withColumn("body", body)
    length = F.length("body") / 2
    size = joined(F.expr("repeat('FF', cast(floor(length(body) / 2 / 255) as int))"), le(length % 255, 1))
    # Bytes apart by blanks, so that the pattern meets whole bytes only.
    spaced = F.regexp_replace(joined(F.lit("05"), size, F.col("body")), "(..)", "$1 ")
    escaped = F.regexp_replace(F.regexp_replace(spaced, "00 00 (?=0[0-3])", "00 00 03 "), " ", "")
    start = F.when(k % 3 == 0, "00000001").otherwise("000001")
    return rows.select("event_id", F.unhex(joined(start, F.lit("06"), escaped, F.lit("80"), F.lit("000001410707"), F.lit("00000001"), F.lit("67AA00"))).alias("content"))


_SEI = "WITH e AS (SELECT event_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents, 5 + event_id % 2 AS v, event_id % 4 AS n FROM events)"


@query(_SEI + """, l AS (SELECT *, 23 + CASE WHEN v = 6 THEN 17 ELSE 0 END + 80 * n AS body FROM e) SELECT event_id, 0 AS pos, 6 AS kind, 3 + body // 255 + body + 1 AS n_bytes FROM l UNION ALL SELECT event_id, 1, 1, 3 FROM l UNION ALL SELECT event_id, 2, 7, 2 FROM l""")
def nal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of three kinds, the first without its emulation prevention, by the table function nal_units."""
    tables.register(spark)
    return spark.sql("SELECT s.event_id, u.pos, u.kind, length(u.payload) AS n_bytes FROM {rows} s, LATERAL nal_units(s.content) u", rows=_streams(spark, sf_dir))


@query(_SEI + " SELECT event_id, 0 AS frame, v AS version, event_id % 3 AS accel_fs, event_id % 5 AS gyro_fs, n, CASE WHEN v = 6 THEN t END AS sof_ns, CASE WHEN v = 6 THEN cents END AS exposure_us, CASE WHEN v = 6 THEN event_id % 16 END AS timing_flags, CASE WHEN v = 6 THEN 26470 END AS readout_us FROM e")
def sei_packet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT s.event_id, p.frame, p.version, p.accel_fs, p.gyro_fs, p.n, p.sof_ns, p.exposure_us, p.timing_flags, p.readout_us FROM {rows} s, LATERAL sei_packets(s.content) p", rows=_streams(spark, sf_dir))


@query(_SEI + f" SELECT event_id, j AS nth, t + j AS ts_ns, {_float('event_id + j + 1')} AS gyro_x, {_float('event_id + j')} AS accel_z, {_float('event_id + j + 2')} AS temp_c, {_float('cents + j')} AS tail FROM (SELECT *, unnest(range(n)) AS j FROM e)")
def sei_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT s.event_id, p.at AS nth, p.ts_ns, double(p.gyro_x) gyro_x, double(p.accel_z) accel_z, double(p.temp_c) temp_c, double(p.tail) tail FROM {rows} s, LATERAL sei_samples(s.content) p", rows=_streams(spark, sf_dir))


def _movies(spark: SparkSession, sf_dir: str) -> str:
    """One MP4 file a user, a chunk of two samples for each event; the tables stand behind the data."""
    rows, user, i = _numbered(spark, sf_dir), F.col("user_id"), F.col("i")
    zero = F.lit("00000000")
    header = _item("IHDR", "c", 1, 64, _imu_header(F.lit(5), user))
    pair = lambda a, b: joined(zero, zero, a, zero, zero, b)
    columns = [_item("TSNS", "J", 8, 2, joined(le(F.col("u"), 8), le(F.col("u") + 1, 8))), _item("ACCL", "f", 12, 2, pair(f4(F.col("event_id")), f4(F.col("event_id") + 1))), _item("MAGA", "f", 4, 2, joined(f4(F.col("cents")), f4(F.col("cents") + 1)))]
    size = F.when(i == 0, 152).otherwise(80)
    chunk = F.when(i == 0, _nest("CHNK", 144, header, *columns)).otherwise(_nest("CHNK", 72, *columns))
    offset = F.when(i == 0, 8).otherwise(8 + 152 + 80 * (i - 1))
    files = rows.groupBy("recording_id", "part", "user_id").agg(F.count("*").alias("n"))
    n, meta = F.col("n"), joined(text('{"session": '), F.hex(user.cast("string")), text("}"))
    told = F.length(meta) / 2
    tail = _box("udta", 8 + told, _box("tmfm", told, meta))
    table = 24 + 20 + 4 * n + 16 + 4 * n  # stsd, stsz, stco
    head = joined(be(100 + 8 * n + 16 + told, 4), text("moov"), be(32 + table, 4), text("trak"), be(24 + table, 4), text("mdia"), be(16 + table, 4), text("minf"), be(8 + table, 4), text("stbl"))
    head = joined(head, _box("stsd", 16, be(0, 8), be(16, 4), text("tmfd")), be(20 + 4 * n, 4), text("stsz"), be(0, 4), be(0, 4), be(n, 4))
    placed = lambda frame, stage, digits: _piece(frame, F.lit(stage) * F.lit(1 << 40) + (i if "i" in frame.columns else 0), digits)
    pieces = placed(files, 0, joined(be(8 + 152 + 80 * (n - 1), 4), text("mdat")))
    for frame, stage, digits in ((rows, 1, chunk), (files, 2, head), (rows, 3, be(size, 4)), (files, 4, joined(be(16 + 4 * n, 4), text("stco"), be(0, 4), be(n, 4))), (rows, 5, be(offset, 4)), (files, 6, tail)):
        pieces = pieces.union(placed(frame, stage, digits))
    path = formats.scratch(spark)
    formats.save(pieces, path, "mp4")
    return path


@query("SELECT CAST(user_id AS VARCHAR) AS recording_id, count(*) AS chunks, 2 * count(*) AS samples, 0 AS frames, user_id AS session FROM events GROUP BY user_id")
def track_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata tracks of MP4 files by byte ranges: chunks and samples counted, the session from the file's metadata."""
    info = formats.track_info(formats.track(spark, _movies(spark, sf_dir), 1 << 14))
    return info.select("recording_id", "chunks", "samples", "frames", F.get_json_object("meta", "$.session").cast("long").alias("session"))


@query(_N + f""" SELECT CAST(user_id AS VARCHAR) AS recording_id, 2 * i + j AS sample_idx, u + j AS ts_ns, {_float("event_id + j")} AS accel_z, {_float("cents + j")} AS mag_age_us FROM (SELECT *, unnest([0, 1]) AS j FROM n)""")
def track_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inertial files that the tracks embed, rebuilt in a folder by the sink and read again."""
    rebuilt = formats.scratch(spark)
    formats.save(formats.track_pieces(formats.track(spark, _movies(spark, sf_dir), 1 << 14), "imu"), rebuilt, "imu")
    rows = formats.open_records(spark, rebuilt, "imu", split=1 << 16)
    return rows.select("recording_id", "sample_idx", "ts_ns", F.col("accel.z").cast("double").alias("accel_z"), F.col("mag_age_us").cast("double").alias("mag_age_us"))


@query(_N + """, k AS (SELECT user_id, count(*) AS n, max(u) - min(u) AS span FROM n GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS recording_id, n AS samples, CAST(round(span / 1e9::DOUBLE * 1e6) AS BIGINT) AS duration_us, CASE WHEN span > 0 THEN CAST(round((n - 1) / (span / 1e9::DOUBLE) * 1e6) AS BIGINT) END AS rate_micro,
CASE WHEN user_id % 6 + 1 < 5 THEN 'v1' ELSE 'v3' END AS since, (SELECT CAST(round(avg(sqrt(x * x + y * y)) * 1e6) AS BIGINT) FROM (SELECT user_id AS w, """ + f"{_float('event_id')} AS x, 0 AS y FROM n) WHERE w = k.user_id) AS accel_micro FROM k")
def inspected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each inertial file: samples, duration, actual rate, generation, mean magnitude."""
    from isochron.plans import takes

    rows = takes.inspected(spark, _imu(spark, sf_dir))
    micro = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return rows.select("recording_id", "samples", micro("duration_s").alias("duration_us"), micro("actual_rate_hz").alias("rate_micro"), F.when(F.col("version") < 5, "v1").otherwise("v3").alias("since"), micro("mean_accel").alias("accel_micro"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 1000 END AS session, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 2 = 0 END AS synced, CASE WHEN s_suppkey % 5 > 0 THEN -s_suppkey END AS master_clock_offset_ns FROM supplier")
def meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files of recordings; each fifth is no JSON and gives nulls."""
    k = F.col("s_suppkey")
    whole = F.to_json(F.struct((k * 1000).alias("session"), (k % 2 == 0).alias("synced"), (-k).alias("master_clock_offset_ns"), F.lit("x").alias("more")))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("string").alias("recording_id"), F.lit(0).alias("part"), F.lit(0).alias("seq"), F.when(k % 5 > 0, whole).otherwise("{no").cast("binary").alias("content"))
    path = formats.scratch(spark)
    formats.save(rows, path, "json")
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/part000\.json$", 1).alias("recording_id"), "value")
    return readers.meta_of(raw).select("recording_id", "session", "synced", "master_clock_offset_ns")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, 700.0::DOUBLE + s_suppkey AS fx, CAST(s_suppkey % 7 AS DOUBLE) / 8 AS d0, 'radtan' AS model FROM supplier")
def calibration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations that are JSON, not blobs."""
    k = F.col("s_suppkey")
    lens = F.struct((700.0 + k).alias("fx"), F.lit(701.0).alias("fy"), F.lit(960.0).alias("cx"), F.lit(540.0).alias("cy"), F.lit("radtan").alias("model"), F.array(k % 7 / 8, F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("distortion"), F.array(F.lit(1920), F.lit(1080)).alias("image_size"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("string").alias("recording_id"), F.lit(0).alias("part"), F.to_json(F.struct(lens.alias("intrinsics"))).cast("binary").alias("content"))
    return readers.calibrations(rows).select("recording_id", "calibration.intrinsics.fx", F.col("calibration.intrinsics.distortion")[0].alias("d0"), "calibration.intrinsics.model")


@query("SELECT l_orderkey, l_linenumber, printf('%.3f', l_orderkey / 8.0::DOUBLE) AS t, printf('%.4f', l_quantity / 16.0::DOUBLE) AS x, printf('%.4f', -l_linenumber / 4.0::DOUBLE) AS y, '2.5000' AS z FROM lineitem")
def landmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks written as text with fixed decimals, and the text read again."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    points = rows.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("topic"), (F.col("l_orderkey") / 8.0).alias("t"), (F.col("l_quantity").cast("double") / 16).alias("x"), (-F.col("l_linenumber") / 4.0).alias("y"), F.lit(2.5).alias("z"))
    path = formats.scratch(spark)
    writers.landmarks_csv(points, path)
    read = spark.read.option("header", "true").csv(path)
    return read.select(F.split("topic", "/")[0].cast("long").alias("l_orderkey"), F.split("topic", "/")[1].cast("long").alias("l_linenumber"), "t", "x", "y", "z")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 AND event_id % 5 > 0 THEN event_type || ' t' || event_id % 5 WHEN event_id % 3 > 0 THEN event_type WHEN event_id % 5 > 0 THEN 't' || event_id % 5 ELSE 'e' || event_id END AS label FROM events")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of cameras: role and tag where there are any, else the base name."""
    k = F.col("event_id")
    role, tag = F.when(k % 3 > 0, F.col("event_type")), F.when(k % 5 > 0, F.concat(F.lit("t"), k % 5)).otherwise("")
    return events(spark, sf_dir).select("event_id", scalar.label(role, tag, F.concat(F.lit("e"), k)).alias("label"))


@query(_SEI + f""", x AS (SELECT * FROM e WHERE n > 0) SELECT CAST(event_id AS VARCHAR) AS recording_id, t AS start_ns, n AS samples, {_float('event_id + 1')} AS gyro_x, v AS version, CASE WHEN v = 6 THEN t ELSE 0 END AS sof_ns, 0 AS venc_pts_us FROM x""")
def side_channel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertial and frame-timing files recovered from elementary streams without presentation times."""
    rows = _streams(spark, sf_dir).select(F.col("event_id").cast("string").alias("recording_id"), F.lit(0).alias("part"), "content", F.lit(None).cast("array<long>").alias("pts_us"), F.lit(30.0).alias("fps"))
    # Three relations are read from the recovered files, which are recovered once.
    found = ordering.cut(readers.side_channel(rows).filter(F.length("imu") > 64))
    own = lambda c: found.select("recording_id", "part", F.col(c).alias("content"))
    samples = readers.imu_samples_of(own("imu")).groupBy("recording_id").agg(F.min("ts_ns").alias("start_ns"), F.count("*").alias("samples"), F.min_by("gyro.x", "ts_ns").cast("double").alias("gyro_x"))
    versions = readers.imu_headers_of(own("imu")).select("recording_id", F.col("version").cast("long").alias("version"))
    return samples.join(versions, "recording_id").join(readers.frames_of(own("vts")).select("recording_id", "sof_ns", "venc_pts_us"), "recording_id")


@query(_N + """, f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS f, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM n WHERE event_type = 'error'), z AS (SELECT user_id, max(n) AS n FROM s GROUP BY 1)
SELECT f.event_id, s.cents FROM f LEFT JOIN z USING (user_id) LEFT JOIN s ON s.user_id = f.user_id AND s.p = CAST(floor(f.f / f.total::DOUBLE * (z.n - 1)) AS BIGINT)""")
def asof_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples for frames without times: the one at the same share of the recording."""
    left, right = events(spark, sf_dir, "click").select("event_id", "user_id"), events(spark, sf_dir, "error")
    return asof.by_share(left, right, ["user_id"], "event_id", ["cents"], ["t", "event_id"]).select("event_id", "match.cents")


@query(_N + ", k AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, user_id % 6 + 1 AS v FROM n GROUP BY user_id) SELECT recording_id, unnest(CASE WHEN v = 1 THEN ['accel', 'gyro'] WHEN v = 2 THEN ['accel', 'gyro', 'temp_c'] WHEN v < 5 THEN ['accel', 'gyro', 'temp_c', 'fsync_delay_us'] ELSE ['accel', 'gyro', 'temp_c', 'mag_age_us'] END) AS channel FROM k")
def channels_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of files of each version that can be drawn."""
    rows = formats.open_records(spark, _imu(spark, sf_dir), "imu")
    return charts.available(rows, ["recording_id"], ["accel", "gyro", "temp_c", "fsync_delay_us", "mag_age_us"])


@query(_N + """, r AS (SELECT user_id, list(CASE WHEN event_id % 5 > 0 THEN value END ORDER BY i) AS x FROM n GROUP BY 1)
SELECT user_id, CAST(round(list_reduce(list_concat([NULL::DOUBLE], x), lambda s, v: CASE WHEN v IS NULL THEN NULL WHEN s IS NULL THEN v ELSE 0.9 * s + 0.1 * v END) * 1e6 + 0.23) AS BIGINT) AS last_micro FROM r""")
def ema_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential average that starts anew after each value that is none."""
    rows = _numbered(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("v")))), lambda r: r["v"]).alias("x"))
    return rows.select("user_id", F.round(signal.smoothed(F.col("x"), 0.9) * 1e6 + 0.23).cast("long").alias("last_micro"))


_END = 9 * 10**18


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as a stream of parquet files, with event time; a last row, far behind, lets the watermark pass all others."""
    path = formats.scratch(spark)
    rows.write.parquet(path)
    ended = spark.createDataFrame([(-1, _END)], "k long, ts_ns long")
    ended.select(*(F.col(c) if c in ("k", "ts_ns") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns)).coalesce(1).write.parquet(f"{path}/end")
    read = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 16).parquet(path)
    return stream.with_event_time(read, late="3650 days")


def _drained(table: DataFrame) -> DataFrame:
    """What a stream has written when all of its files are read."""
    spark = table.sparkSession
    path = formats.scratch(spark)
    table.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(table.schema).parquet(f"{path}/out")


@query(f"WITH e AS ({E}), s AS (SELECT DISTINCT user_id, t FROM e), g AS (SELECT user_id AS k, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS b, t FROM s) SELECT k, b * 1000 AS before_ns, t * 1000 AS after_ns FROM g WHERE t - b > {DAY}")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses of more than a day, from a stream with state and timers."""
    rows = events(spark, sf_dir).select(F.col("user_id").cast("long").alias("k"), (F.col("t") * 1000).alias("ts_ns"))
    return _drained(ordered.gap_stream(_streamed(spark, rows), "k", DAY * 1000, idle_ms=10**12)).filter("k >= 0")


@query(f"WITH e AS ({E}) SELECT user_id AS k, (t - t % {DAY}) * 1000 AS start_ns, count(*) AS n, min(cents) AS low, max(cents) AS high FROM e GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes by day, from a stream."""
    rows = events(spark, sf_dir).select(F.col("user_id").cast("long").alias("k"), (F.col("t") * 1000).alias("ts_ns"), F.col("cents").cast("double").alias("v"))
    found = _drained(stream.windowed(_streamed(spark, rows), "k", "v", "1 day")).filter("k >= 0")
    return found.select("k", (F.unix_micros("window.start") * 1000).alias("start_ns"), "n", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query(_SIDES + f""", b AS (SELECT c.*, p.t AS bt, p.cents AS bc FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t), a AS (SELECT b.*, p.t AS aft, p.cents AS ac FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t < p.t),
n AS (SELECT *, aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) AS early FROM a), m AS (SELECT event_id, t, CASE WHEN early THEN bt ELSE aft END AS mt, CASE WHEN early THEN bc ELSE ac END AS mc FROM n)
SELECT event_id, CASE WHEN abs(mt - t) <= {DAY} THEN mt * 1000 END AS match_ns, CASE WHEN abs(mt - t) <= {DAY} THEN mc END AS cents FROM m""")
def stream_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the purchase nearest to it, not farther than a day, from two streams."""
    side = lambda kind, v: events(spark, sf_dir, kind).select(F.col("user_id").cast("long").alias("k"), (F.col("t") * 1000).alias("ts_ns"), F.col(v).cast("double").alias("v"))
    found = _drained(ordered.nearest_stream(_streamed(spark, side("click", "event_id")), _streamed(spark, side("purchase", "cents")), "k", "v", DAY * 1000, idle_ms=10**12))
    return found.filter("k >= 0").select(F.col("left_value").cast("long").alias("event_id"), "match_ns", F.col("match_value").cast("long").alias("cents"))


def _floats_of(k: Column, n: int) -> list[Column]:
    """`n` of the known floats, one after the other from number k."""
    return [f4(k + i) for i in range(n)]


def _lens_bytes(k: Column) -> Column:
    """1920 x 1080, model by parity, four coefficients of five, all floats by number k."""
    return joined(le(1920, 2), le(1080, 2), le(k % 2, 1), le(4, 1), F.lit("0000"), *_floats_of(k, 8), F.lit("00000000"))


def _sealed(body: Column) -> Column:
    whole = F.unhex(body)
    return F.concat(whole, F.unhex(le(F.crc32(whole), 4)))


def _blobs(spark: SparkSession, sf_dir: str, chip: bool) -> DataFrame:
    """Calibration blobs of one camera for odd suppliers, of two for even ones: (recording_id, part, content, k)."""
    k = F.col("s_suppkey")
    flags = 2 + 4 + 8 + 16 + (1 if chip else 0)
    device = F.lpad(F.lower(F.hex(k)), 32, "0") if chip else F.lit("00" * 16)
    head = lambda version: joined(le(0x434C4254, 4), le(version, 2), le(flags, 2), device)
    noise = joined(*_floats_of(k + 1, 4), *_floats_of(k + 2, 3), *_floats_of(k + 3, 3))
    one = joined(head(1), _lens_bytes(k), *_floats_of(k, 12), f4(k + 4), noise, *_floats_of(k + 1, 3), f4(k + 2), F.lit("00" * 20))
    camera = lambda n: joined(_lens_bytes(k + n), f4(k + n), f4(k + n + 1))
    two = joined(head(2), le(2, 1), F.lit("000000"), camera(0), camera(1), *_floats_of(k, 12), *_floats_of(k + 1, 12), noise, *_floats_of(k + 2, 2), f4(k + 2), F.lit("00" * 16))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(k.cast("string").alias("recording_id"), F.lit(0).alias("part"), F.when(k % 2 == 1, _sealed(one)).otherwise(_sealed(two)).alias("content"), k.cast("long").alias("k"))


@query(f"""SELECT CAST(k AS VARCHAR) AS recording_id, 2 - k % 2 AS version, 31 AS flags, lpad(lower(hex(k)), 32, '0') AS chip_id, CASE WHEN k % 2 = 0 THEN 2 END AS num_cams, CASE WHEN k % 2 = 1 THEN 'equidistant' ELSE 'radtan' END AS model, {_float('k')} AS fx,
{_float('k + 5')} AS d1, {_float('k + 10')} AS t_y, CASE WHEN k % 2 = 0 THEN {_float('k + 2')} END AS second_fy, {_float('k + 2')} AS rate, {_float('k + 4')} AS gyro_bias_y, true AS valid FROM (SELECT s_suppkey AS k FROM supplier)""")
def calibration_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of one and two cameras whose bytes and checksum SQL has made."""
    blobs = _blobs(spark, sf_dir, True)
    c = readers.calibrations(blobs)
    first = F.coalesce(F.col("calibration.intrinsics"), F.get(F.col("calibration.cameras"), F.lit(0))["intrinsics"])
    placed = F.coalesce("calibration.T_cam_imu", "calibration.T_cam0_imu")
    wide = lambda name: F.col(f"calibration.{name}").cast("long").alias(name)
    read = c.select("recording_id", wide("version"), wide("flags"), "calibration.chip_id", wide("num_cams"), first["model"].alias("model"), first["fx"].alias("fx"), first["distortion"][1].alias("d1"), placed[1][3].alias("t_y"), F.get(F.col("calibration.cameras"), F.lit(1))["intrinsics"]["fy"].alias("second_fy"), F.col("calibration.imu.sample_rate_hz").alias("rate"), F.col("calibration.imu.gyro_bias_rad_s")[1].alias("gyro_bias_y"))
    return read.join(blobs.select("recording_id", readers.blob_valid(F.col("content")).alias("valid")), "recording_id")


def _number(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v, _ in FLOATS)), (k % len(FLOATS) + 1).cast("int"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, true AS same FROM supplier")
def calibration_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations of one and two cameras packed by the writer, byte for byte what SQL makes of the same numbers."""
    blobs = _blobs(spark, sf_dir, False)
    k = F.col("k")
    numbers = lambda start, n: F.array(*(_number(start + i) for i in range(n)))
    lens = lambda k: F.struct(*(_number(k + i).alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))), F.when(k % 2 == 1, "equidistant").otherwise("radtan").alias("model"), numbers(k + 4, 4).alias("distortion"), F.array(F.lit(1920), F.lit(1080)).alias("image_size"))
    placed = lambda k: F.array(*(F.array(*(_number(k + 3 * r + i) for i in range(3)), _number(k + 9 + r)) for r in range(3)), F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    names = ("accel_noise_density", "gyro_noise_density", "accel_random_walk", "gyro_random_walk")
    imu = F.struct(F.struct(*(_number(k + 1 + i).alias(c) for i, c in enumerate(names))).alias("noise_model"), numbers(k + 2, 3).alias("accel_bias_m_s2"), numbers(k + 3, 3).alias("gyro_bias_rad_s"), _number(k + 2).alias("sample_rate_hz")).alias("imu")
    one = F.to_json(F.struct(lens(k).alias("intrinsics"), F.struct(placed(k).alias("T_cam_imu"), _number(k + 4).alias("timeshift_cam_imu_s"), _number(k + 1).alias("reprojection_rms_px"), _number(k + 2).alias("kalibr_gyro_error_mean"), _number(k + 3).alias("kalibr_accel_error_mean")).alias("extrinsics"), imu))
    camera = lambda n: F.struct(lens(k + n).alias("intrinsics"), _number(k + n).alias("timeshift_cam_imu_s"), _number(k + n + 1).alias("reprojection_rms_px"))
    two = F.to_json(F.struct(F.array(camera(0), camera(1)).alias("cameras"), placed(k).alias("T_cam0_imu"), placed(k + 1).alias("T_cam1_cam0"), imu, _number(k + 2).alias("kalibr_gyro_error_mean"), _number(k + 3).alias("kalibr_accel_error_mean")))
    packed = writers.calibration_blobs(blobs.select("recording_id", F.when(k % 2 == 1, one).otherwise(two).alias("json"))).withColumnRenamed("content", "packed")
    return blobs.join(packed, "recording_id").select("recording_id", (F.col("content") == F.col("packed")).alias("same"))
