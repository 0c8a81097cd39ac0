"""Registered queries over recordings that are made from the driver's tables: encoded files read back, clocks, poses, fusion.

A user's events are a recording's samples and frames; a supplier is a calibration. Each query has a DuckDB statement that
knows nothing of files or operators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import geometry, scalar
from isochron.operators import charts, clock, disparity, frames, fusion, ordering, session, signal, stereo, volume
from isochron.queries import DAY, E, _SIDES, _sides, _spun, events, query
from isochron.sources import readers, resolve, writers

_N = f"WITH e AS ({E}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, t - min(t) OVER (PARTITION BY user_id) AS u FROM e)"
_REC = "CAST(user_id AS VARCHAR) AS recording_id"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id")
    return events(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("t", "event_id")).cast("long") - 1, "u": F.col("t") - F.min("t").over(w), "recording_id": F.col("user_id").cast("string"), "part": F.lit(0)})


def _xyz(x, y=None, z=None, **more):
    parts = {"x": x, "y": F.lit(0.0) if y is None else y, "z": F.lit(0.0) if z is None else z} | more
    return F.struct(*(v.cast("float").alias(k) for k, v in parts.items()))


def _imu_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir)
    none = _xyz(F.lit(0.0))
    samples = rows.select("recording_id", "part", F.col("i").alias("sample_idx"), (F.col("t") * 1000).alias("ts_ns"), _xyz(F.col("u") % 100, None, F.lit(9.81)).alias("accel"), _xyz(F.col("value")).alias("gyro"), _xyz(F.col("cents") % 100).alias("mag"), none.alias("lin_accel"), _xyz(F.lit(0.0), w=F.lit(1.0)).alias("quat"), F.lit(20.5).cast("float").alias("temp_c"), F.lit(None).cast("float").alias("fsync_delay_us"), (F.col("event_id") % 50).cast("float").alias("mag_age_us"))
    user = F.col("user_id")
    headers = rows.select("recording_id", "part", "user_id").distinct().select("recording_id", "part", F.lpad(F.lower(F.hex(user)), 32, "0").alias("device_id"), (5 + user % 2).cast("int").alias("version"), (400 + user % 3).cast("long").alias("rate_hz"), (user % 4).cast("int").alias("accel_fs"), (user % 3).cast("int").alias("gyro_fs"), (user % 8).cast("long").alias("flags"), (user * 5).alias("start_ns"), (user * 7).alias("video_start_ns"), (-user).alias("host_offset_ns"))
    return writers.imu_files(samples, headers)


def _vts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir)
    made = rows.select("recording_id", "part", F.col("i").alias("frame_idx"), F.col("i").alias("frame_number"), F.lit(0).cast("long").alias("ts_ns"), (F.col("u") + 1).alias("sof_ns"), F.col("i").alias("venc_seq"), F.col("u").alias("venc_pts_us"), (F.col("cents") % 1000).alias("exposure_us"), (F.col("event_id") % 16).alias("timing_flags"), (F.col("cents") % 30000).alias("readout_us"))
    user = F.col("user_id")
    headers = rows.select("recording_id", "part", "user_id").distinct().select("recording_id", "part", F.lit(4).alias("version"), (29_000 + user).cast("long").alias("frame_rate_milli"), (user * 1000).alias("offset_ns"), ((user % 7 - 3) * 28617).cast("int").alias("skew_ppb"), (user % 900).cast("int").alias("quality_us"), (user % 4).cast("int").alias("sync_flags"))
    return writers.vts_files(made, headers)


@query(_N + f" SELECT {_REC}, i AS sample_idx, t * 1000 AS ts_ns, CAST(CAST(value AS FLOAT) AS DOUBLE) AS gyro_x, CAST(cents % 100 AS DOUBLE) AS mag_x, CAST(event_id % 50 AS DOUBLE) AS mag_age_us FROM n")
def imu_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.imu_samples_of(_imu_files(spark, sf_dir))
    return rows.select("recording_id", "sample_idx", "ts_ns", F.col("gyro.x").cast("double").alias("gyro_x"), F.col("mag.x").cast("double").alias("mag_x"), F.col("mag_age_us").cast("double").alias("mag_age_us"))


@query(f"SELECT DISTINCT {_REC}, CASE WHEN user_id = 0 THEN '' ELSE lpad(lower(hex(user_id)), 32, '0') END AS device_id, 5 + user_id % 2 AS version, 400 + user_id % 3 AS rate_hz, user_id % 8 AS flags, user_id * 5 AS start_ns, -user_id AS host_offset_ns FROM events")
def imu_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.imu_headers_of(_imu_files(spark, sf_dir))
    return rows.select("recording_id", "device_id", F.col("version").cast("long").alias("version"), "rate_hz", "flags", "start_ns", "host_offset_ns")


@query(_N + f" SELECT {_REC}, i AS frame_idx, u + 1 AS sof_ns, u AS venc_pts_us, cents % 1000 AS exposure_us, event_id % 16 AS timing_flags, cents % 30000 AS readout_us FROM n")
def vts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.frames_of(_vts_files(spark, sf_dir)).select("recording_id", "frame_idx", "sof_ns", "venc_pts_us", "exposure_us", "timing_flags", "readout_us")


@query(f"SELECT DISTINCT {_REC}, (29000 + user_id) / 1000.0::DOUBLE AS fps, user_id * 1000 AS offset_ns, (user_id % 7 - 3) * 28617 AS skew_ppb, user_id % 4 AS sync_flags FROM events")
def vts_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.vts_headers_of(_vts_files(spark, sf_dir))
    return rows.select("recording_id", "fps", "offset_ns", F.col("skew_ppb").cast("long").alias("skew_ppb"), F.col("sync_flags").cast("long").alias("sync_flags"))


@query(f"SELECT DISTINCT {_REC}, 'TRIMU00' AS magic, 5 + user_id % 2 AS version FROM events UNION ALL SELECT DISTINCT {_REC}, 'TRIVTS0', 4 FROM events")
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.versions_of(_imu_files(spark, sf_dir).unionByName(_vts_files(spark, sf_dir)))
    return rows.select("recording_id", "magic", F.col("version").cast("long").alias("version"))


@query(_N + f", k AS (SELECT *, greatest(count(*) OVER (PARTITION BY user_id) - 40, 0) AS d FROM n) SELECT {_REC}, i - d AS frame_idx, u + 1 AS sof_ns FROM k WHERE i >= d")
def realigned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.drop_leading(readers.frames_of(_vts_files(spark, sf_dir)), F.lit(40)).select("recording_id", "frame_idx", "sof_ns")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS recording_id, CASE WHEN s_suppkey % 2 = 1 THEN 'equidistant' ELSE 'radtan' END AS model, CAST(CAST(700 + s_suppkey * 0.1 AS FLOAT) AS DOUBLE) AS fx,
CAST(CAST(s_suppkey * 0.001 AS FLOAT) AS DOUBLE) AS d0, CAST(CAST(s_suppkey * -0.00001 AS FLOAT) AS DOUBLE) AS timeshift, true AS valid, 200 AS n_bytes FROM supplier""")
def calibration_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("double")
    lens = F.struct((700 + k * 0.1).alias("fx"), F.lit(701.0).alias("fy"), F.lit(960.0).alias("cx"), F.lit(540.0).alias("cy"), F.when(F.col("s_suppkey") % 2 == 1, "equidistant").otherwise("radtan").alias("model"), F.array(k * 0.001, F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("distortion"), F.array(F.lit(1920), F.lit(1080)).alias("image_size"))
    placed = F.struct(F.array(*(F.array(*(F.lit(float(a == b)) for b in range(4))) for a in range(4))).alias("T_cam_imu"), (k * -0.00001).alias("timeshift_cam_imu_sec"))
    texts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("recording_id"), F.to_json(F.struct(lens.alias("intrinsics"), placed.alias("extrinsics"))).alias("json"))
    blobs = writers.calibration_blobs(texts).select("recording_id", F.lit(0).alias("part"), "content")
    checked = blobs.select("recording_id", readers.blob_valid(F.col("content")).alias("valid"), F.length("content").cast("long").alias("n_bytes"))
    read = readers.calibrations(blobs).select("recording_id", "calibration.intrinsics.model", "calibration.intrinsics.fx", F.col("calibration.intrinsics.distortion")[0].alias("d0"), F.col("calibration.timeshift_cam_imu_s").alias("timeshift"))
    return read.join(checked, "recording_id")


@query("SELECT CAST(o_custkey AS VARCHAR) AS recording_id, CAST(o_orderkey AS DOUBLE) AS t_s, CAST(o_orderkey % 100 AS DOUBLE) AS x, CAST(o_custkey % 10 AS DOUBLE) AS qw FROM orders WHERE o_orderkey % 5 <> 0")
def pose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    whole = F.concat(k.cast("string"), F.when(k % 2 == 0, ", ").otherwise("  "), (k % 100).cast("string"), F.lit(" 1.5,2\t0 0 0 "), (c % 10).cast("string"))
    line = F.when(k % 5 != 0, whole).when(k % 10 == 0, F.concat(F.lit("# "), whole)).otherwise("1 2 3")
    poses = readers.poses_of(rows.select(c.cast("string").alias("recording_id"), line.alias("value")))
    return poses.select("recording_id", "t_s", "x", "qw")


_FRAMES = _N + """, f AS (SELECT *, CASE WHEN user_id % 3 = 0 OR event_id % 4 = 0 THEN 0 ELSE u END AS sof FROM n),
b AS (SELECT *, CASE WHEN max(sof <> 0) OVER (PARTITION BY user_id) THEN sof ELSE u * 1000 END AS best FROM f)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    sof = F.when((F.col("user_id") % 3 == 0) | (F.col("event_id") % 4 == 0), 0).otherwise(F.col("u"))
    return _numbered(spark, sf_dir).select("user_id", "event_id", "recording_id", "part", F.col("i").alias("frame_idx"), sof.cast("long").alias("sof_ns"), F.col("u").alias("venc_pts_us"), F.lit(None).cast("long").alias("ts_ns"), (F.col("event_id") % 16).alias("timing_flags"), F.when(F.col("event_type") == "purchase", F.col("cents") % 30000).otherwise(0).alias("readout_us"))


@query(_FRAMES + """, x AS (SELECT *, best - first_value(best) OVER (PARTITION BY user_id ORDER BY i) AS d, (user_id % 7 - 3) * 7 AS k FROM b), v AS (SELECT *, k * d AS p FROM x)
SELECT event_id, best AS best_ns, CASE WHEN user_id % 2 = 1 THEN best + user_id * 1000 + (p - ((p % 1000000000) + 1000000000) % 1000000000) // 1000000000 END AS global_ns FROM v""")
def global_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir)
    user = F.col("user_id")
    headers = rows.select("user_id", "recording_id", "part").distinct().select("recording_id", "part", (user * 1000).alias("offset_ns"), ((user % 7 - 3) * 7).cast("int").alias("skew_ppb"), (user % 2).cast("int").alias("sync_flags"))
    return clock.global_time(rows, headers).select("event_id", "best_ns", "global_ns")


@query(_FRAMES + """, r AS (SELECT *, CASE WHEN event_type = 'purchase' THEN cents % 30000 ELSE 0 END AS ro FROM b),
d AS (SELECT *, coalesce(first_value(CASE WHEN ro > 0 THEN ro END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS fr,
 first_value(event_id) OVER (PARTITION BY user_id ORDER BY i) & 8 AS c FROM r)
SELECT event_id, CAST(fr AS DOUBLE) / CAST(1080000000 AS DOUBLE) AS line_delay_s, CAST(CASE WHEN c <> 0 THEN 100 - 540 ELSE 100 END AS DOUBLE) * (CAST(fr AS DOUBLE) / CAST(1080000000 AS DOUBLE)) AS row_offset_s FROM d""")
def row_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.row_times(_frames(spark, sf_dir), 1080, F.lit(100)).select("event_id", "line_delay_s", "row_offset_s")


@query(f"WITH e AS ({E}) SELECT event_id, CAST(t + round_even(CAST(cents AS DOUBLE) / CAST(1e9 AS DOUBLE) * CAST(1e9 AS DOUBLE), 0) AS BIGINT) AS imu_ns, t - (cents % 50) * 1000 AS mag_ns FROM e")
def sensor_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select("event_id", clock.imu_time(F.col("t"), F.col("cents") / F.lit(1e9)).alias("imu_ns"), clock.mag_time(F.col("t"), F.col("cents") % 50).alias("mag_ns"))


_AROUND = _SIDES + """, b AS (SELECT c.*, p.t AS bt, p.cents AS bc FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t),
a AS (SELECT b.*, p.t AS aft, p.cents AS ac FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t < p.t)"""
_SHARE = "CAST(t - bt AS DOUBLE) / CAST(aft - bt AS DOUBLE)"


@query(_AROUND + f""" SELECT event_id, CAST(bc AS DOUBLE) + {_SHARE} * (CAST(ac AS DOUBLE) - CAST(bc AS DOUBLE)) AS x, CASE WHEN {_SHARE} > 0.5 THEN CAST(ac % 7 AS DOUBLE) ELSE CAST(bc % 7 AS DOUBLE) END AS qw
FROM a WHERE bt IS NOT NULL AND aft IS NOT NULL AND aft - bt <= {5 * DAY}""")
def poses_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    still = {c: F.lit(0.0) for c in ("y", "z", "qx", "qy", "qz")}
    poses = right.select("user_id", "t", F.col("cents").cast("double").alias("x"), (F.col("cents") % 7).cast("double").alias("qw")).withColumns(still)
    return frames.poses_at(left, poses, ["user_id"], "t", 5 * DAY, 20_000, bucket=7 * DAY).select("event_id", "x", "qw")


@query(_AROUND + f""", g AS (SELECT event_id, CASE WHEN bt IS NULL THEN ac % 100 / 100.0::DOUBLE WHEN aft IS NULL OR bt = t THEN bc % 100 / 100.0::DOUBLE
 ELSE bc % 100 / 100.0::DOUBLE + (ac % 100 / 100.0::DOUBLE - bc % 100 / 100.0::DOUBLE) * ({_SHARE}) END AS angle FROM a)
SELECT event_id, CAST(round(sin(angle / 2) * 1e6) AS BIGINT) AS z_micro, CAST(round(cos(angle / 2) * 1e6) AS BIGINT) AS w_micro FROM g""")
def slerp_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    half = F.col("cents") % 100 / F.lit(200.0)
    turned = right.select("user_id", "t", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    q = frames.slerp_at(left, turned, ["user_id"], "t", bucket=7 * DAY)
    return q.select("event_id", F.round(F.col("q.z") * 1e6).cast("long").alias("z_micro"), F.round(F.col("q.w") * 1e6).cast("long").alias("w_micro"))


@query(f"""WITH e AS ({E}), c AS (SELECT * FROM e WHERE event_type = 'click'), x AS (SELECT * FROM e WHERE event_type = 'error')
SELECT c.event_id, coalesce(CAST(sum(x.cents) AS DOUBLE) / count(x.t), 0) AS mean_x FROM c LEFT JOIN x ON c.user_id = x.user_id AND x.t BETWEEN c.t AND c.t + {DAY} GROUP BY 1""")
def readout_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = events(spark, sf_dir, "click").select("event_id", "user_id", "t")
    right = events(spark, sf_dir, "error").select("user_id", "t", F.struct((-F.col("cents")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias("gyro"))
    return frames.readout_motion(left, right, ["user_id"], "t", DAY).select("event_id", "mean_x")


@query("SELECT event_id FROM events c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.event_id % 5 = c.event_id % 5)")
def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("user_id").alias("recording_id"), (F.col("event_id") % 5).alias("part"))
    return session.complete(rows.filter("event_type = 'click'"), rows.filter("event_type = 'purchase'")).select("event_id")


@query("""WITH s AS (SELECT user_id, event_id % 5 AS part, min(event_id) AS own FROM events WHERE event_type = 'click' GROUP BY 1, 2), r AS (SELECT user_id, event_id % 5 AS part, min(event_id) AS inside FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT user_id AS recording_id, part, coalesce(own, inside) AS content FROM s FULL JOIN r USING (user_id, part)""")
def sidecar_or_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("user_id").alias("recording_id"), (F.col("event_id") % 5).alias("part"))
    first = lambda kind, name: rows.filter(F.col("event_type") == kind).groupBy("recording_id", "part").agg(F.min("event_id").alias(name))
    return readers.prefer_sidecar(first("click", "content"), first("purchase", "imu"), "imu")


_TURNS = f"""WITH RECURSIVE e AS ({E}), k AS (SELECT user_id, t - min(t) OVER (PARTITION BY user_id) AS ts, value / 400 AS gx, (cents % 7) / 10.0::DOUBLE AS gz FROM e),
s AS (SELECT user_id, ts, gx, gz, row_number() OVER w AS i, (ts - lag(ts) OVER w) / 1e9::DOUBLE AS dt FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, gx, gz)),"""
_MICRO = "SELECT user_id AS recording_id, ts AS ts_ns, CAST(round(x * 1e6) AS BIGINT) AS qx, CAST(round(y * 1e6) AS BIGINT) AS qy, CAST(round(z * 1e6) AS BIGINT) AS qz, CAST(round(w * 1e6) AS BIGINT) AS qw FROM q"


def _micro(attitudes: DataFrame) -> DataFrame:
    return attitudes.select("recording_id", "ts_ns", *(F.round(F.col(c) * 1e6).cast("long").alias(c) for c in fusion.TURN))


@query(_TURNS + """ q AS (SELECT user_id, ts, i, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM s WHERE i = 1 UNION ALL
 SELECT user_id, ts, i, w / l, x / l, y / l, z / l FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM (
  SELECT s.user_id, s.ts, s.i, CASE WHEN go THEN q.w * c - q.x * a - q.z * b ELSE q.w END AS w, CASE WHEN go THEN q.w * a + q.x * c + q.y * b ELSE q.x END AS x,
   CASE WHEN go THEN q.y * c + q.z * a - q.x * b ELSE q.y END AS y, CASE WHEN go THEN q.w * b + q.z * c - q.y * a ELSE q.z END AS z
  FROM q JOIN (SELECT *, cos(h / 2) AS c, gx * dt * sin(h / 2) / h AS a, gz * dt * sin(h / 2) / h AS b, dt > 0 AND dt <= 0.5 AND h >= 1e-10 AS go FROM (SELECT *, sqrt(gx * gx + gz * gz) * dt AS h FROM s)) s ON s.user_id = q.user_id AND s.i = q.i + 1))) """ + _MICRO)
def gyro_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micro(fusion.attitudes(_spun(spark, sf_dir), mode="gyro"))


@query(_TURNS + """ q AS (SELECT user_id, ts, i, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM s WHERE i = 1 UNION ALL
 SELECT user_id, ts, i, w / l, x / l, y / l, z / l FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM (
  SELECT user_id, ts, i, CASE WHEN go THEN w + dt * (0.5 * (-x * gx - z * gz) - CASE WHEN m > 1e-9 THEN 0.08 * s0 / m ELSE 0 END) ELSE w END AS w,
   CASE WHEN go THEN x + dt * (0.5 * (w * gx + y * gz) - CASE WHEN m > 1e-9 THEN 0.08 * s1 / m ELSE 0 END) ELSE x END AS x,
   CASE WHEN go THEN y + dt * (0.5 * (z * gx - x * gz) - CASE WHEN m > 1e-9 THEN 0.08 * s2 / m ELSE 0 END) ELSE y END AS y,
   CASE WHEN go THEN z + dt * (0.5 * (w * gz - y * gx) - CASE WHEN m > 1e-9 THEN 0.08 * s3 / m ELSE 0 END) ELSE z END AS z
  FROM (SELECT *, sqrt(s0 * s0 + s1 * s1 + s2 * s2 + s3 * s3) AS m FROM (
   SELECT s.user_id, s.ts, s.i, s.dt, s.gx, s.gz, s.dt > 0 AND s.dt <= 0.5 AS go, q.w, q.x, q.y, q.z, 4 * q.w * q.y * q.y + 4 * q.w * q.x * q.x AS s0,
    4 * q.x * q.z * q.z + 4 * q.w * q.w * q.x - 4 * q.x + 8 * q.x * q.x * q.x + 8 * q.x * q.y * q.y + 4 * q.x AS s1,
    4 * q.w * q.w * q.y + 4 * q.y * q.z * q.z - 4 * q.y + 8 * q.y * q.x * q.x + 8 * q.y * q.y * q.y + 4 * q.y AS s2, 4 * q.x * q.x * q.z + 4 * q.y * q.y * q.z AS s3
   FROM q JOIN s ON s.user_id = q.user_id AND s.i = q.i + 1))))) """ + _MICRO)
def gradient_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micro(fusion.attitudes(_spun(spark, sf_dir), mode="gravity"))


@query(_N + f" SELECT event_id FROM n WHERE i >= {int(0.5 * 29.65)} AND i < {int(1.2 * 29.65)}")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.frame_range(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 29.65, 0.5, 1.2).select("event_id")


@query(_N + f" SELECT event_id, u FROM n WHERE u BETWEEN {DAY} AND {9 * DAY}")
def take_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.within(_numbered(spark, sf_dir), "u", DAY, 9 * DAY).select("event_id", "u")


@query(f"""WITH e AS ({E}), s AS (SELECT *, abs(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t, event_id)) > 20000 AS j FROM e), o AS (SELECT user_id, min(CASE WHEN j THEN t END) AS onset FROM s GROUP BY 1),
m AS (SELECT user_id, CASE WHEN t >= onset AND event_id % 9 <> 0 THEN value END AS v FROM e JOIN o USING (user_id))
SELECT user_id, count(v) AS n, CAST(round(quantile_cont(v, 0.5) * 1000) AS BIGINT) AS median_milli, max(v) AS largest FROM m GROUP BY 1""")
def masked_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    joined = rows.join(signal.onset(rows, ["user_id"], ["t", "event_id"], "cents", 20000), "user_id")
    noisy = joined.withColumn("value", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    out = signal.delays(noisy.withColumn("v", signal.masked_before("value", "t", F.col("onset"))), ["user_id"], "v")
    return out.select("user_id", "n", F.round(F.col("median") * 1000).cast("long").alias("median_milli"), "largest")


@query(f"WITH e AS ({E}) SELECT user_id, min(cents) / 1000.0::DOUBLE AS low_c, max(cents) / 1000.0::DOUBLE AS high_c, count(*) FILTER (event_id % 4 > 0) AS throttled FROM e GROUP BY 1")
def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.thermal(events(spark, sf_dir).select("user_id", F.col("cents").alias("temp_milli_c"), (F.col("event_id") % 4).alias("thermal_state")), ["user_id"])


@query("""SELECT l_orderkey, l_linenumber, CAST(round((1.5 * l_quantity - 0.5 * l_linenumber) * 1000) AS BIGINT) AS x_milli, CAST(round((2.0 + 0.25 * l_quantity) * 1000) AS BIGINT) AS y_milli FROM lineitem""")
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two placements, one after the other, and the second undone and done again: points (quantity, line number)."""
    mat = lambda rows: F.array(*(F.array(*(x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in r)) for r in rows))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").cast("double").alias("n"))
    turn = mat([[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    point = mat([[1, 0, 0, 1.5 * F.col("q") - 0.5 * F.col("n")], [0, 1, 0, 2.0 + 0.25 * F.col("q")], [0, 0, 1, 0], [0, 0, 0, 1]])
    back = geometry.matmul(geometry.inverse(turn), geometry.matmul(turn, point))
    at = lambda r: F.round(back[r][3] * 1000).cast("long")
    return rows.select("l_orderkey", "l_linenumber", at(0).alias("x_milli"), at(1).alias("y_milli"))


_KIND = "CASE event_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'vts' WHEN 2 THEN 'imu' ELSE 'tel' END"


@query(f"""WITH m AS (SELECT user_id AS u, event_id % 5 AS p, {_KIND} AS k, '/takes/u' || user_id || '/part00' || event_id % 5 || '.' || {_KIND} AS path FROM events)
SELECT 'u' || u AS recording_id, CAST(p AS INTEGER) AS part, min(path) FILTER (k = 'mp4') AS mp4, min(path) FILTER (k = 'vts') AS vts, min(path) FILTER (k = 'imu') AS imu, min(path) FILTER (k = 'tel') AS tel,
CASE u % 3 WHEN 0 THEN '/takes/u' || u || '.json' WHEN 1 THEN '/takes/u' || u || '/meta.json' END AS meta, bool_or(k = 'mp4') AND bool_or(k = 'vts') AS placeable FROM m GROUP BY u, p""")
def recording_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    path = F.concat(F.lit("/takes/u"), "user_id", F.lit("/part00"), F.col("event_id") % 5, F.lit("."), F.expr(_KIND))
    meta = F.when(F.col("user_id") % 3 < 2, F.concat(F.lit("/takes/u"), "user_id", F.lit("/meta.json")))
    own = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("/takes/u"), "user_id", F.lit(".json")))
    listed = rows.select(path.alias("path")).union(rows.select(meta)).union(rows.select(own)).filter("path is not null").distinct()
    return resolve.parts(resolve.members(listed))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 7 AS k FROM orders), p AS (SELECT c, bool_or(k = 0) AS l, bool_or(k = 1) AS r, bool_or(k = 2) AS vl, bool_or(k = 3) AS vr, bool_or(k = 4) AS i FROM m GROUP BY c)
SELECT 'take' || c AS take, CASE WHEN l THEN '/s/take' || c || '_L.mp4' END AS mp4_l, CASE WHEN r THEN '/s/take' || c || '_R.mp4' END AS mp4_r, l AND r AS complete,
CASE WHEN vl THEN 'sidecar' ELSE 'embedded' END AS vts_l_from, CASE WHEN vr THEN 'sidecar' ELSE 'embedded' END AS vts_r_from, CASE WHEN i THEN 'sidecar' ELSE 'embedded' END AS imu_from FROM p WHERE l OR r""")
def stereo_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ("_L.mp4", "_R.mp4", "_L.vts", "_R.vts", ".imu", ".json", ".tel"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    listed = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("/s/take"), "o_custkey", ending).alias("path")).distinct()
    return resolve.stereo_takes(resolve.members(listed)).select("take", "mp4_l", "mp4_r", "complete", "vts_l_from", "vts_r_from", "imu_from")


@query(f"""WITH e AS ({E}), n AS (SELECT user_id, event_id, (t - min(t) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS s, CASE WHEN event_id % 11 > 0 THEN cents END AS c FROM e),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k, min(c) OVER (PARTITION BY user_id) / 100.0::DOUBLE - 0.5 AS y0, max(c) OVER (PARTITION BY user_id) / 100.0::DOUBLE + 0.5 AS y1, row_number() OVER (PARTITION BY user_id ORDER BY s, coalesce(c, 1e12)) - 1 AS i FROM n WHERE s BETWEEN 100000 AND 1500000),
d AS (SELECT *, sum(CASE WHEN c IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS segment FROM w WHERE k > 1 AND y0 IS NOT NULL AND i % greatest(k // 20, 1) = 0)
SELECT user_id, CAST(round(s) AS BIGINT) AS s, c AS cents, CAST(segment AS BIGINT) AS segment, CAST(round((s - 100000) / 1400000 * 1000000) AS BIGINT) AS across_ppm,
CAST(round(CASE WHEN y1 - y0 < 1 THEN (c / 100.0::DOUBLE - (y0 + y1) / 2 + 1) / 2 ELSE (c / 100.0::DOUBLE - y0) / (y1 - y0) END * 1000000) AS BIGINT) AS up_ppm FROM d WHERE c IS NOT NULL""")
def chart_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("cents") / 100)
    rows = _numbered(spark, sf_dir).select("user_id", (F.col("u") / 1e6).alias("s"), broken.alias("v"))
    whole = lambda c, by=1: F.round(F.col(c) * by).cast("long")
    return charts.panel(rows, ["user_id"], "s", "v", 800_000.0, 700_000.0, 20).select("user_id", whole("s").alias("s"), whole("v", 100).alias("cents"), "segment", whole("across", 1_000_000).alias("across_ppm"), whole("up", 1_000_000).alias("up_ppm"))


_ANGLE = "radians(CAST(l_orderkey % 360 AS DOUBLE))"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(round(cos({_ANGLE}) * 1e6) AS BIGINT) AS x_right, CAST(round(0.85 * sin({_ANGLE}) * 1e6) AS BIGINT) AS x_up,
CAST(round(-sin({_ANGLE}) * 1e6) AS BIGINT) AS y_right, CAST(round(0.85 * cos({_ANGLE}) * 1e6) AS BIGINT) AS y_up, 0::BIGINT AS z_right, -530000::BIGINT AS z_up FROM lineitem""")
def axis_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about z by whole degrees."""
    half = F.radians((F.col("l_orderkey") % 360).cast("double")) / 2
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("tips", geometry.axis_tips(geometry.quat(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))))
    micro = lambda k, side: F.round(F.col("tips")[k][side] * 1e6).cast("long").alias(f"{'xyz'[k]}_{side}")
    return rows.select("l_orderkey", "l_linenumber", *(micro(k, side) for k in range(3) for side in ("right", "up")))


@query("""SELECT l_orderkey, l_linenumber, CAST(round((l_quantity - 25) / 20.0::DOUBLE * 1e6) AS BIGINT) AS x_micro, CAST(round((l_linenumber - 4) / 4.0::DOUBLE * 1e6) AS BIGINT) AS y_micro,
CAST(round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber + 4.0::DOUBLE) * 1e6) AS BIGINT) AS baseline_micro, l_orderkey / 1000.0::DOUBLE AS fps FROM lineitem""")
def fisheye_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays (x, y, 1) to image points and back, the distance of two cameras, and a rate."""
    lens = ((0.05, -0.01, 0.004, -0.0008), 820.0, 815.0, 960.0, 540.0)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"q": F.col("l_quantity").cast("double"), "n": F.col("l_linenumber").cast("double")})
    seen = rows.withColumn("p", geometry.fisheye((F.col("q") - 25) / 20, (F.col("n") - 4) / 4, F.lit(1.0), *lens))
    ray = seen.withColumn("r", geometry.unfisheye(F.col("p.u"), F.col("p.v"), *lens))
    placed = F.array(*(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), c) for c in (F.col("q"), F.col("n"), F.lit(2.0))))
    micro = lambda c: F.round(c * 1e6).cast("long")
    return ray.select("l_orderkey", "l_linenumber", micro(F.col("r.x")).alias("x_micro"), micro(F.col("r.y")).alias("y_micro"), micro(geometry.baseline(placed)).alias("baseline_micro"), scalar.frame_rate(F.col("l_orderkey")).alias("fps"))


_TILTED = """WITH RECURSIVE e AS (SELECT event_id, user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 200 AS ts, value, CAST(round(value * 100) AS BIGINT) AS c FROM events),
k AS (SELECT user_id, ts, value / 400 AS gx, (c % 7) / 10.0::DOUBLE AS gz, (c % 5 - 2) / 2.0::DOUBLE AS ax, (event_id % 3 - 1) / 2.0::DOUBLE AS ay, 9.0::DOUBLE AS az, 20 + c % 7 AS mx, event_id % 5 AS my, -30 AS mz FROM e QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS nth FROM k),"""


def _tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples most of whose steps move: times a two-hundredth of the events', a tilted accelerometer, a field."""
    rows = events(spark, sf_dir)
    k, c = F.col("event_id"), F.col("cents")
    xyz = lambda *v: F.struct(*(x.cast("double").alias(a) for a, x in zip("xyz", v, strict=True)))
    sample = F.struct(xyz(F.col("value") / 400, F.lit(0), c % 7 / F.lit(10.0)).alias("gyro"), xyz((c % 5 - 2) / F.lit(2.0), (k % 3 - 1) / F.lit(2.0), F.lit(9)).alias("accel"), xyz(20 + c % 7, k % 5, F.lit(-30)).alias("mag"))
    late = F.floor((F.col("t") - F.min("t").over(W.partitionBy("user_id"))) / 200).cast("long")
    return rows.select(F.col("user_id").alias("recording_id"), late.alias("ts_ns"), "event_id", sample.alias("s")).groupBy("recording_id", "ts_ns").agg(F.min_by("s", "event_id").alias("s")).select("recording_id", "ts_ns", "s.*")


def _turns(source: str) -> str:
    """DuckDB CTE s: samples in order with their step in seconds."""
    return f" s AS (SELECT *, row_number() OVER w AS i, (ts - lag(ts) OVER w) / 1e9::DOUBLE AS dt FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"


#: Seed from the accelerometer by two angles, and half the product of attitude and turn rate.
_SEED = "cos(b / 2) * cos(r / 2) AS w, cos(b / 2) * sin(r / 2) AS x, sin(b / 2) * cos(r / 2) AS y, -sin(b / 2) * sin(r / 2) AS z FROM (SELECT *, atan2(ay, az) AS r, atan2(-ax, sqrt(ay * ay + az * az)) AS b FROM s WHERE i = 1)"
_SPEED = {"w": "-x * gx - z * gz", "x": "w * gx + y * gz", "y": "z * gx - x * gz", "z": "w * gz - y * gx"}
_PULL = {"w": "2 * x * f2 - 2 * y * f1", "x": "2 * z * f1 + 2 * w * f2 - 4 * x * f3", "y": "2 * z * f2 - 2 * w * f1 - 4 * y * f3", "z": "2 * x * f1 + 2 * y * f2"}


def _filtered(pull: dict[str, str], gain: float, inner: str, seed: str) -> str:
    """DuckDB CTE q: a filter's attitudes; `inner` adds to each step what the pull's formulas name."""
    moved = ", ".join(f"CASE WHEN dt > 0 AND dt <= 0.5 THEN {c} + dt * (0.5 * ({_SPEED[c]}) - CASE WHEN m > 1e-9 THEN {gain} * s_{c} / m ELSE 0 END) ELSE {c} END AS {c}" for c in "wxyz")
    pulls = ", ".join(f"{v} AS s_{c}" for c, v in pull.items())
    return f""" q AS ({seed} UNION ALL SELECT user_id, ts, i, w / l, x / l, y / l, z / l FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM (SELECT user_id, ts, i, {moved}
 FROM (SELECT *, sqrt(s_w * s_w + s_x * s_x + s_y * s_y + s_z * s_z) AS m FROM (SELECT *, {pulls} FROM ({inner}))))))"""


_STEP = "SELECT s.*, q.w, q.x, q.y, q.z, sqrt(ax * ax + ay * ay + az * az) AS la FROM q JOIN s ON s.user_id = q.user_id AND s.i = q.i + 1"
_GRAVITY = _filtered(_PULL, 0.08, f"SELECT *, 2 * (x * z - w * y) - ax / la AS f1, 2 * (y * z + w * x) - ay / la AS f2, 1 - 2 * (x * x + y * y) - az / la AS f3 FROM ({_STEP})", f"SELECT user_id, ts, i, {_SEED}")


@query(_TILTED + _turns("p") + """ q AS (SELECT user_id, ts, i, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM s WHERE i = 1 UNION ALL
 SELECT s.user_id, s.ts, s.i, CASE WHEN go THEN q.w * c - q.x * a - q.z * b ELSE q.w END, CASE WHEN go THEN q.w * a + q.x * c + q.y * b ELSE q.x END, CASE WHEN go THEN q.y * c + q.z * a - q.x * b ELSE q.y END, CASE WHEN go THEN q.w * b + q.z * c - q.y * a ELSE q.z END
 FROM q JOIN (SELECT *, cos(h / 2) AS c, gx * dt * sin(h / 2) / h AS a, gz * dt * sin(h / 2) / h AS b, dt > 0 AND dt <= 0.5 AND h >= 1e-10 AS go FROM (SELECT *, sqrt(gx * gx + gz * gz) * dt AS h FROM s)) s ON s.user_id = q.user_id AND s.i = q.i + 1) """ + _MICRO)
def gyro_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn rates integrated by the scan in blocks of two seconds; three steps of four move."""
    return _micro(fusion.gyro_scan(_tilted(spark, sf_dir), ["recording_id"], 2_000_000_000))


@query(_TILTED + _turns("p") + _GRAVITY + _MICRO)
def gravity_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micro(fusion.attitudes(_tilted(spark, sf_dir), mode="gravity"))


_THIN = "t AS (SELECT user_id, ts, gx - 0.01 AS gx, gz + 0.02 AS gz, ax - 0.1 AS ax, ay + 0.2 AS ay, az - 0.3 AS az FROM p WHERE nth % 3 = 0),"


@query(_TILTED + _THIN + _turns("t") + _GRAVITY + """ SELECT user_id AS recording_id, ts AS ts_ns, CAST(round((x + z - w - y) / 2 * 1e6) AS BIGINT) AS qx, CAST(round((x + y - w - z) / 2 * 1e6) AS BIGINT) AS qy,
CAST(round((y + z - w - x) / 2 * 1e6) AS BIGINT) AS qz, CAST(round((w + x + y + z) / 2 * 1e6) AS BIGINT) AS qw FROM q""")
def camera_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera a third of a turn from the sensor, whose biases are taken off every third sample."""
    rows = fusion.camera_attitudes(_tilted(spark, sf_dir), 400.0, (0.5, 0.5, 0.5, 0.5), (0.01, 0.0, -0.02), (0.1, -0.2, 0.3))
    return _micro(rows.select("recording_id", "ts_ns", *(F.col(f"q.{c[1]}").alias(c) for c in fusion.TURN)))


_ROWS = {"w": (("0", "-2 * z", "2 * y"), ("-2 * y", "2 * x", "0")), "x": (("0", "2 * y", "2 * z"), ("2 * z", "2 * w", "-4 * x")), "y": (("-4 * y", "2 * x", "2 * w"), ("-2 * w", "2 * z", "-4 * y")), "z": (("-4 * z", "-2 * w", "2 * x"), ("2 * x", "2 * y", "0"))}
_FIELD_PULL = {c: " + ".join(f"({low[j]}) * a{j} + (fx * ({top[j]}) + fz * ({low[j]})) * m{j}" for j in range(3)) for c, (top, low) in _ROWS.items()}
_MATRIX = "1 - 2 * (y * y + z * z) AS r11, 2 * (x * y - w * z) AS r12, 2 * (x * z + w * y) AS r13, 2 * (x * y + w * z) AS r21, 1 - 2 * (x * x + z * z) AS r22, 2 * (y * z - w * x) AS r23, 2 * (x * z - w * y) AS r31, 2 * (y * z + w * x) AS r32, 1 - 2 * (x * x + y * y) AS r33"
_ERRORS = f"""SELECT *, r31 - ax / la AS a0, r32 - ay / la AS a1, r33 - az / la AS a2, fx * r11 + fz * r31 - ux AS m0, fx * r12 + fz * r32 - uy AS m1, fx * r13 + fz * r33 - uz AS m2 FROM (
 SELECT *, sqrt(pow(r11 * ux + r12 * uy + r13 * uz, 2) + pow(r21 * ux + r22 * uy + r23 * uz, 2)) AS fx, r31 * ux + r32 * uy + r33 * uz AS fz FROM (
 SELECT *, {_MATRIX}, mx / sqrt(mx * mx + my * my + mz * mz) AS ux, my / sqrt(mx * mx + my * my + mz * mz) AS uy, mz / sqrt(mx * mx + my * my + mz * mz) AS uz FROM ({_STEP})))"""
_NORTH = f"""SELECT user_id, ts, i, cos(o) * w - sin(o) * z AS w, cos(o) * x - sin(o) * y AS x, cos(o) * y + sin(o) * x AS y, cos(o) * z + sin(o) * w AS z FROM (
 SELECT *, -atan2(r21 * mx + r22 * my + r23 * mz, r11 * mx + r12 * my + r13 * mz) / 2 AS o FROM (SELECT *, {_MATRIX} FROM (SELECT *, {_SEED})))"""


@query(_TILTED + _turns("p") + _filtered(_FIELD_PULL, 0.041, _ERRORS, _NORTH) + _MICRO)
def field_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine axes: gravity and the direction of the horizontal field."""
    return _micro(fusion.attitudes(_tilted(spark, sf_dir), mode="field"))


@query(_AROUND + f""", k AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, CAST(CAST(CASE WHEN k.n IS NULL THEN NULL WHEN k.n < 2 THEN 0 WHEN bt IS NULL THEN ac WHEN aft IS NULL OR bt = t THEN bc ELSE bc + (ac - bc) * ({_SHARE}) END AS FLOAT) AS DOUBLE) AS accel_x,
CAST(CAST(CASE WHEN k.n IS NULL THEN NULL WHEN k.n < 2 THEN 0 WHEN bt IS NULL THEN ac % 7 WHEN aft IS NULL OR bt = t THEN bc % 7 ELSE bc % 7 + (ac % 7 - bc % 7) * ({_SHARE}) END AS FLOAT) AS DOUBLE) AS quat_w, CAST(NULL AS DOUBLE) AS mag_x FROM a LEFT JOIN k USING (user_id)""")
def imu_at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as frames, purchases as samples: channels interpolated, zeros for one sample, nulls for channels that are missing."""
    left, right = _sides(spark, sf_dir)
    value = F.col("cents").cast("double")
    samples = right.select("user_id", F.col("t").alias("ts_ns"), F.struct(value.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias("accel"), F.expr("cast(null as struct<x:double,y:double,z:double>)").alias("mag"), geometry.quat(0.0, 0.0, 0.0, (F.col("cents") % 7).cast("double")).alias("quat"))
    out = frames.imu_at_frames(samples, left.withColumnRenamed("t", "time_ns"), ["user_id"], 7 * DAY, ("accel", "mag", "quat"))
    return out.select("event_id", F.col("accel.x").cast("double").alias("accel_x"), F.col("quat.w").cast("double").alias("quat_w"), F.col("mag.x").cast("double").alias("mag_x"))


@query(_N + """, f AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 12 ELSE 6 END AS k, 40 + user_id % 50 AS d FROM n), g AS (SELECT *, 1000000000 + i * 2500000 AS ts, count(*) FILTER (i % k = 0) OVER (PARTITION BY user_id) AS pulses FROM f)
SELECT user_id AS recording_id, i // k AS frame_idx, ts - d * 1000 AS pulse_ns FROM g WHERE i % k = 0 AND pulses >= 2 AND user_id % 5 > 0""")
def pulse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by their pulses in files of two frame rates; each fifth recording says that it has no frame sync."""
    k = F.when(F.col("user_id") % 2 == 0, 12).otherwise(6)
    rows = _numbered(spark, sf_dir).select(F.col("user_id").alias("recording_id"), "user_id", "event_id", "i", k.alias("k"), (1_000_000_000 + F.col("i") * 2_500_000).alias("ts_ns"))
    pulse = F.col("i") % F.col("k") == 0
    late = 40 + F.col("user_id") % 50
    samples = rows.select("recording_id", "ts_ns", F.when(pulse, late).otherwise(0).cast("float").alias("fsync_delay_us"))
    seen = rows.filter(pulse).select("recording_id", F.floor(F.col("i") / F.col("k")).alias("frame_idx"), (F.col("ts_ns") - late * 1000 + (F.col("event_id") % 7 - 3) * 100_000).alias("best_ns"))
    files = rows.select("recording_id", "user_id", "k").distinct()
    headers = files.select("recording_id", F.when(F.col("user_id") % 5 > 0, 1).otherwise(0).alias("flags"))
    rates = files.select("recording_id", (F.lit(400.0) / F.col("k")).alias("fps"))
    return frames.pulse_times(samples, seen, headers, rates, ["recording_id"])


_LENSES = ([820.0, 815.0, 960.0, 540.0, 0.05, -0.01, 0.004, -0.0008], [805.0, 810.0, 955.0, 550.0, 0.04, -0.02, 0.005, -0.0005])
_TURNED = 0.06


def _rig(rows: DataFrame) -> DataFrame:
    """Two lenses 12 cm apart, one turned about x against the other, for each of the rows' takes."""
    c, s = math.cos(_TURNED), math.sin(_TURNED)
    numbers = lambda v: F.array(*map(F.lit, v))
    placed = F.array(*map(numbers, ([1.0, 0.0, 0.0, -0.12], [0.0, c, -s, 0.0], [0.0, s, c, 0.0], [0.0, 0.0, 0.0, 1.0])))
    return rows.select("take", numbers(_LENSES[0]).alias("lens0"), numbers(_LENSES[1]).alias("lens1"), placed.alias("placed"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(0.0).alias("cy1_shift"))


def _pictured(rows: DataFrame, shift: Column) -> DataFrame:
    """Points (x, y, z) in the first camera's frame as both cameras picture them; the second's cy is off by `shift`."""
    c, s = math.cos(_TURNED), math.sin(_TURNED)
    lens = lambda k: (tuple(_LENSES[k][4:]), *_LENSES[k][:4])
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    first, second = geometry.fisheye(x, y, z, *lens(0)), geometry.fisheye(x - 0.12, c * y - s * z, s * y + c * z, *lens(1))
    both = rows.withColumns({"p": first, "q": second})
    return both.select(*rows.columns, F.col("p.u").alias("u0"), F.col("p.v").alias("v0"), F.col("q.u").alias("u1"), (F.col("q.v") + shift).alias("v1"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, n, k = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.col("l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", ((q - 25) / 20).alias("x"), ((n - 4) / 4).alias("y"), (2 + k % 5).cast("double").alias("z"), (k % 3).alias("take"))


@query(f"""SELECT l_orderkey, l_linenumber, 0 AS rows_apart_micro, CAST(round(((l_linenumber - 4) / 4.0::DOUBLE * sin({_TURNED / 2}::DOUBLE) + (2 + l_orderkey % 5) * cos({_TURNED / 2}::DOUBLE)) * 1e6) AS BIGINT) AS depth_micro, 120000 AS baseline_micro FROM lineitem""")
def stereo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points pictured by two turned fisheye lenses: once rectified they share rows, and disparity gives their depth."""
    rows = _points(spark, sf_dir)
    seen = stereo.rectified_points(_pictured(rows, F.lit(0.0)), stereo.rectified_rigs(_rig(rows.select("take").distinct())))
    micro = lambda c: F.round(c * 1e6).cast("long")
    return seen.select("l_orderkey", "l_linenumber", micro(F.col("y0") - F.col("y1")).alias("rows_apart_micro"), micro(F.col("focal") * F.col("baseline") / (F.col("x0") - F.col("x1"))).alias("depth_micro"), micro(F.col("baseline")).alias("baseline_micro"))


@query("SELECT l_suppkey AS take, CASE WHEN count(*) > 100 THEN l_suppkey % 9 - 4 ELSE 0 END AS shift_px, CASE WHEN count(*) > 100 THEN count(*) END AS n FROM lineitem GROUP BY 1")
def stereo_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes whose second camera has moved by whole pixels: the rounds find by how many, from more than 100 matches."""
    rows = _points(spark, sf_dir).withColumn("take", F.col("l_suppkey"))
    found = stereo.aligned(_pictured(rows, F.col("take") % 9 - 4), _rig(rows.select("take").distinct()))
    return found.select("take", F.round("shift").cast("long").alias("shift_px"), "n")


def _floats(value: Column) -> Column:
    """Bytes of a 32-bit float that is a whole number of 64ths from 1 up to below 2, by its digits."""
    share = F.lpad(F.hex((value * 64 - 64).cast("long") * 131072), 6, "0")
    number = F.concat(F.lit("3F"), F.lpad(F.hex(F.conv(F.substring(share, 1, 2), 16, 10).cast("long") + 128), 2, "0"), F.substring(share, 3, 4))
    return F.concat(*(F.substring(number, k, 2) for k in (7, 5, 3, 1)))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS take, CAST(round((1 + s_suppkey % 60 / 64.0::DOUBLE) * 1e6) AS BIGINT) AS low_micro, CAST(round((1 + s_suppkey % 60 / 64.0::DOUBLE) * 1e6) AS BIGINT) AS high_micro, true AS covered FROM supplier")
def plane_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall a supplier's distance away, seen twice: voxels fused from its depth images, and the extent of the surface."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("take"), (1 + F.col("s_suppkey") % 60 / F.lit(64.0)).alias("z"))
    depth = F.unhex(F.repeat(_floats(F.col("z")), 24 * 18)).alias("depth")
    pose = F.array(*(F.array(*(F.lit(float(a == b)) for b in range(4))) for a in range(4))).alias("pose")
    images = rows.withColumn("view", F.explode(F.array(F.lit(0), F.lit(1)))).select("take", F.lit(24).alias("width"), F.lit(18).alias("height"), depth, F.array(*map(F.lit, (30.0, 30.0, 11.5, 8.5))).alias("lens"), pose)
    triangles = volume.surface(volume.fused(images, 0.1), 0.1)
    micro = lambda c: F.round(c * 1e6).cast("long")
    zs = F.array("z0", "z1", "z2")
    return triangles.groupBy("take").agg(micro(F.min(F.array_min(zs))).alias("low_micro"), micro(F.max(F.array_max(zs))).alias("high_micro"), (F.count("*") > 20).alias("covered"))


@query("SELECT s_suppkey AS take, 2 + s_suppkey % 9 AS disparity_px FROM supplier")
def shifted_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of hashed brightness whose left one is the right one moved by whole pixels: the disparity of most pixels."""
    # Pictures are drawn by many tasks, though their numbers are one small file.
    rows = ordering.dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("take"), (2 + F.col("s_suppkey") % 9).cast("int").alias("shift")), "take")
    bright = lambda k: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(64 * 24 - 1)), lambda i: F.substring(F.md5(F.concat_ws(":", F.col("take"), F.floor(i / 64), i % 64 - k).cast("binary")), 1, 2)), ""))
    pairs = rows.select("take", F.lit(64).alias("width"), F.lit(24).alias("height"), bright(F.col("shift")).alias("left_pixels"), bright(F.lit(0)).alias("right_pixels"))
    found = disparity.disparities(pairs, 16)
    # Each disparity is four bytes; those that are no number end in 7F, least byte first.
    at = F.explode(F.sequence(F.lit(1), F.length("disparity"), F.lit(4)))
    bits = found.select("take", "disparity", at.alias("at")).select("take", F.hex(F.substring("disparity", F.col("at"), F.lit(4))).alias("h"))
    number = F.conv(F.concat(*(F.substring("h", k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    kept = bits.select("take", number.alias("n")).filter(F.shiftright(F.col("n"), 23).bitwiseAND(F.lit(255)) < 255)
    # A float's exponent and fraction, from 2 up.
    power = F.shiftright(F.col("n"), 23).bitwiseAND(F.lit(255)) - 127
    value = F.pow(F.lit(2.0), power) * (1 + F.col("n").bitwiseAND(F.lit(8388607)) / F.lit(8388608.0))
    counted = kept.groupBy("take", F.round(value).cast("long").alias("disparity_px")).count()
    return counted.groupBy("take").agg(F.max_by("disparity_px", F.struct("count", "disparity_px")).alias("disparity_px"))
