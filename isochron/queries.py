"""Registered queries: the operators over the driver's tables, each with the DuckDB statement of the same rows.

Events stand for samples (user = recording, event type = stream, cents = an exact value), orders and line items for
trajectories, embeddings for descriptors. Sums that are compared are taken over whole cents, so that no order of
addition shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions import scalar
from isochron.operators import asof, clock, frames, matching, ordering, session, signal

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Time buckets that long series are split by in as-of joins.
BUCKET = 7 * DAY
#: Percentiles are compared in thousandths: the last bit of an interpolation differs between engines.
PERCENTILES = (("p2", 0.02), ("p50", 0.5), ("p95", 0.95), ("p98", 0.98))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

E = "SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents, props FROM events"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    if kind:
        rows = rows.filter(F.col("event_type") == kind)
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return rows.select("event_id", t.alias("t"), "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("cents"), "props")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return events(spark, sf_dir, "click").select("event_id", "user_id", "t"), events(spark, sf_dir, "purchase").select("user_id", "t", "cents", F.col("event_id").alias("match_id"))


_SIDES = f"""WITH e AS ({E}), c AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'),
p AS (SELECT user_id, t, min(cents) AS cents, arg_min(event_id, (cents, event_id)) AS match_id FROM e WHERE event_type = 'purchase' GROUP BY user_id, t)"""


@query(_SIDES + " SELECT c.event_id, c.t, p.match_id, p.cents, c.t - p.t AS gap_us FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t")
def asof_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    out = asof.backward(left, right, ["user_id"], "t", ["cents", "match_id"], BUCKET)
    return out.select("event_id", "t", "match.match_id", "match.cents", (F.col("t") - F.col("match.t")).alias("gap_us"))


@query(_SIDES + " SELECT c.event_id, c.t, p.match_id, p.cents, p.t - c.t AS gap_us FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t <= p.t")
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    out = asof.forward(left, right, ["user_id"], "t", ["cents", "match_id"], BUCKET)
    return out.select("event_id", "t", "match.match_id", "match.cents", (F.col("match.t") - F.col("t")).alias("gap_us"))


_NEAR = _SIDES + """, b AS (SELECT c.*, p.t AS bt, p.match_id AS bm FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t),
a AS (SELECT b.*, p.t AS aft, p.match_id AS am FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.t),
n AS (SELECT *, CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) THEN bt ELSE aft END AS mt,
 CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) THEN bm ELSE am END AS mm FROM a)"""


@query(_NEAR + f" SELECT event_id, t, CASE WHEN abs(mt - t) <= {DAY} THEN mm END AS match_id FROM n")
def nearest_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    out = asof.nearest(left, right, ["user_id"], "t", ["match_id"], gate=DAY, bucket=BUCKET)
    return out.select("event_id", "t", "match.match_id")


@query(_NEAR + " SELECT event_id, mm AS match_id, abs(mt - t) AS distance_us FROM n")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    out = asof.nearest(left, right, ["user_id"], "t", ["match_id"], bucket=BUCKET)
    return out.select("event_id", "match.match_id", F.abs(F.col("match.t") - F.col("t")).alias("distance_us"))


@query(_SIDES + """, s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM c),
g AS (SELECT user_id, CAST(floor(0.5 * quantile_cont(d, 0.5)) AS BIGINT) AS gate FROM s GROUP BY 1),
b AS (SELECT c.*, p.t AS bt, p.match_id AS bm FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t),
a AS (SELECT b.*, p.t AS aft, p.match_id AS am FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.t),
n AS (SELECT *, aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) AS behind FROM a)
SELECT event_id, CASE WHEN behind THEN bm ELSE am END AS match_id FROM n JOIN g USING (user_id) WHERE abs(CASE WHEN behind THEN bt ELSE aft END - t) <= gate""")
def stereo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return frames.stereo_pairs(left, right, ["user_id"], "t", ["match_id"], BUCKET).select("event_id", "match.match_id")


@query(_SIDES + """, b AS (SELECT c.*, p.t AS bt, p.cents AS bc FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.t),
a AS (SELECT b.*, p.t AS aft, p.cents AS ac FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t < p.t)
SELECT event_id, CASE WHEN bt IS NULL THEN CAST(ac AS DOUBLE) WHEN aft IS NULL OR bt = t THEN CAST(bc AS DOUBLE)
 ELSE CAST(bc AS DOUBLE) + (CAST(ac AS DOUBLE) - CAST(bc AS DOUBLE)) * (CAST(t - bt AS DOUBLE) / CAST(aft - bt AS DOUBLE)) END AS cents_at FROM a""")
def interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return asof.interpolate(left, right, ["user_id"], "t", ["cents"], BUCKET).select("event_id", "cents_at")


@query(f"""WITH e AS ({E}), c AS (SELECT * FROM e WHERE event_type = 'click'), x AS (SELECT * FROM e WHERE event_type = 'error')
SELECT c.event_id, count(x.t) AS n, CASE WHEN count(x.t) > 0 THEN CAST(sum(x.cents) AS DOUBLE) / count(x.t) END AS mean_cents
FROM c LEFT JOIN x ON c.user_id = x.user_id AND x.t BETWEEN c.t AND c.t + {HOUR} GROUP BY 1""")
def interval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = events(spark, sf_dir, "click").select("event_id", "user_id", "t")
    right = events(spark, sf_dir, "error").select("user_id", "t", "cents")
    met = asof.between(left, right, ["user_id"], "t", HOUR, ["cents"])
    return met.groupBy("event_id").agg(F.count("sample_t").alias("n"), F.try_divide(F.sum("sample_cents").cast("double"), F.count("sample_t")).alias("mean_cents"))


@query(f"""WITH e AS ({E}), c AS (SELECT * FROM e WHERE event_type = 'click'), x AS (SELECT * FROM e WHERE event_type = 'error'),
m AS (SELECT c.event_id, sum(x.cents) AS s, count(*) AS n FROM c JOIN x ON c.user_id = x.user_id AND x.t BETWEEN c.t AND c.t + {DAY} GROUP BY 1)
SELECT event_id FROM m WHERE s <= 5000 * n""")
def motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = events(spark, sf_dir, "click").select("event_id", "user_id", "t")
    right = events(spark, sf_dir, "error").select("user_id", "t", F.struct(F.col("cents").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias("gyro"))
    return frames.calm(left, right, ["user_id"], "t", DAY, 5000).select("event_id")


@query(f"""WITH e AS ({E}), r AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), o AS (SELECT max(lo) AS lo, min(hi) AS hi FROM r),
g AS (SELECT unnest(generate_series(lo, hi, {DAY})) AS t FROM o), k AS (SELECT g.t, r.event_type FROM g, r),
s AS (SELECT event_type, t, min(event_id) AS id FROM e GROUP BY 1, 2),
b AS (SELECT k.*, s.t AS bt, s.id AS bi FROM k ASOF LEFT JOIN s ON k.event_type = s.event_type AND k.t >= s.t),
a AS (SELECT b.*, s.t AS aft, s.id AS ai FROM b ASOF LEFT JOIN s ON b.event_type = s.event_type AND b.t <= s.t),
n AS (SELECT t, CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) THEN bt ELSE aft END AS mt FROM a)
SELECT t, count(mt) AS n, max(mt) - min(mt) AS spread_us FROM n GROUP BY 1""")
def grid_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asof.grid(events(spark, sf_dir).select("event_type", "t", "event_id"), "event_type", "t", DAY, ["event_id"], BUCKET)
    return rows.groupBy("t").agg(F.count("match").alias("n"), (F.max("match.t") - F.min("match.t")).alias("spread_us"))


@query(f"""WITH e AS ({E}), r AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), o AS (SELECT max(lo) AS lo, min(hi) AS hi FROM r),
g AS (SELECT unnest(generate_series(lo, hi, {DAY // 2})) AS t FROM o), k AS (SELECT g.t, r.event_type FROM g, r), s AS (SELECT DISTINCT event_type, t FROM e),
b AS (SELECT k.*, s.t AS bt FROM k ASOF LEFT JOIN s ON k.event_type = s.event_type AND k.t >= s.t), a AS (SELECT b.*, s.t AS aft FROM b ASOF LEFT JOIN s ON b.event_type = s.event_type AND b.t <= s.t),
n AS (SELECT t, event_type, CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) THEN bt ELSE aft END AS mt FROM a)
SELECT n.t AS global_ns, n.event_type AS recording_id, n.mt - m.mt AS offset_ns FROM n JOIN n m ON n.t = m.t AND m.event_type = 'purchase'""")
def grid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's distance from the master's sample at every second half-day of the common time."""
    rows = events(spark, sf_dir).select(F.col("event_type").alias("recording_id"), F.col("t").alias("global_ns"), F.col("event_id").alias("frame_idx"))
    return frames.camera_offsets(rows, 1e9 / (DAY // 2), "purchase", BUCKET).select("global_ns", "recording_id", "offset_ns")


@query(f"WITH e AS ({E}), r AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1) SELECT max(lo) AS low, min(hi) AS high FROM r")
def overlap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.common_range(events(spark, sf_dir), "event_type", "t")


_STEPS = f"WITH e AS ({E}), s AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e)"


@query(_STEPS + " SELECT user_id, count(*) AS n, max(t) - min(t) AS span, CAST(sum(d) AS DOUBLE) / count(d) AS mean_step, quantile_cont(d, 0.5) AS median_step FROM s GROUP BY 1")
def diff_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.cadence(events(spark, sf_dir), ["user_id"], "t").select("user_id", "n", "span", "mean_step", "median_step")


@query("WITH e AS (" + E + "), s AS (SELECT user_id, CAST(stddev_pop(d / 1e6) AS DOUBLE) AS sd FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e) GROUP BY 1) SELECT user_id, CAST(round(sd * 1000) AS BIGINT) AS std_ms FROM s")
def cadence_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.cadence(events(spark, sf_dir), ["user_id"], "t").select("user_id", F.round(F.col("std_step") / 1000).cast("long").alias("std_ms"))


@query(_STEPS + ", m AS (SELECT user_id, quantile_cont(d, 0.5) AS nominal FROM s GROUP BY 1) SELECT event_id, s.user_id, d AS step FROM s JOIN m USING (user_id) WHERE d > nominal * 1.5")
def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.gaps(events(spark, sf_dir), ["user_id"], "t").select("event_id", "user_id", "step")


@query(f"WITH e AS ({E}), s AS (SELECT user_id, t, abs(cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t, event_id)) > 200 AS j FROM e) SELECT user_id, min(CASE WHEN j THEN t END) AS onset FROM s GROUP BY 1")
def onset_first_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.onset(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "cents", 200)


@query(_STEPS + ", l AS (SELECT user_id, list_sort(list(d) FILTER (d > 0)) AS x FROM s GROUP BY 1) SELECT user_id, x[len(x) // 2 + 1] AS upper_median FROM l WHERE len(x) > 10")
def upper_median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = events(spark, sf_dir).withColumn("step", signal.step("t", ["user_id"], ["t"])).filter("step > 0")
    return signal.upper_median(steps, ["user_id"], "step", 10).filter("upper is not null").select("user_id", F.col("upper").alias("upper_median"))


@query(f"WITH e AS ({E}) SELECT event_type, " + ", ".join(f"CAST(round(quantile_cont(cents, {q}) * 1000) AS BIGINT) AS {n}" for n, q in PERCENTILES) + " FROM e GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordering.statistics(events(spark, sf_dir), ["event_type"], "cents", dict(PERCENTILES))
    return found.select("event_type", *(F.round(F.col(n) * 1000).cast("long").alias(n) for n, _ in PERCENTILES))


@query("WITH b AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events) SELECT event_id, value FROM events, b WHERE value BETWEEN lo - 0.5 AND hi + 0.5")
def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.percentile_clip(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), ["value"])


@query(f"WITH e AS ({E}) SELECT user_id, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, user_id DESC LIMIT 1")
def session_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = events(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("recording_id"))
    return session.largest(meta).select(F.col("session").alias("user_id"), "n")


@query("SELECT user_id, count(DISTINCT event_type) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS members FROM events GROUP BY 1")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_type").alias("recording_id"))
    return session.members(meta).select(F.col("session").alias("user_id"), "n", F.array_join("members", ",").alias("members"))


@query(f"WITH e AS ({E}) SELECT event_id, (t - min(t) OVER (PARTITION BY user_id)) / 1e9 AS relative_s FROM e")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", clock.relative_s("t", ["user_id"]).alias("relative_s"))


@query(f"WITH e AS ({E}) SELECT user_id, arg_min(cents, t) FILTER (cents > 10000) AS first_valid FROM e GROUP BY 1")
def first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.col("cents") > 10_000
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by(F.when(over, F.col("cents")), F.when(over, F.col("t"))).alias("first_valid"))


@query(f"""WITH e AS ({E}), s AS (SELECT event_id, t, t - min(t) OVER (PARTITION BY user_id) AS d, user_id % 7 - 3 AS k FROM e),
x AS (SELECT *, k * 28617 * d AS v FROM s) SELECT event_id, t - 1000 + (v - ((v % 1000000000) + 1000000000) % 1000000000) // 1000000000 AS global_us FROM x""")
def skew_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    first = F.min("t").over(W.partitionBy("user_id"))
    return rows.select("event_id", clock.skewed(F.col("t"), first, F.lit(-1000), (F.col("user_id") % 7 - 3) * 28617).alias("global_us"))


@query("SELECT event_id, (event_id & 1) <> 0 AS fsync, (event_id & 2) <> 0 AS mag FROM events")
def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", scalar.has_flag(F.col("event_id"), 1).alias("fsync"), scalar.has_flag(F.col("event_id"), 2).alias("mag"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '±2 g' WHEN 1 THEN '±4 g' WHEN 2 THEN '±8 g' WHEN 3 THEN '±16 g' ELSE 'unknown(4)' END AS accel_range,
CASE WHEN event_id % 7 >= 5 THEN 'v3' ELSE 'legacy' END AS generation FROM events""")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", scalar.code_name(F.col("event_id") % 5, scalar.ACCEL_RANGES).alias("accel_range"), scalar.generation(F.col("event_id") % 7).alias("generation"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT vec_id, CAST(round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * 1e6) AS BIGINT) AS norm_micro FROM embeddings")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", F.round(F.sqrt(square) * 1e6).cast("long").alias("norm_micro"))


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM orders),
s AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS d FROM o)
SELECT o_custkey, count(*) AS n, CAST(coalesce(sum(d), 0) AS BIGINT) AS path_length, max(x) - min(x) AS extent FROM s GROUP BY 1""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("x"))
    whole = signal.trajectory(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["x"])
    return whole.select("o_custkey", "n", F.col("path_length").cast("long").alias("path_length"), F.col("extent_x").alias("extent"))


@query(f"WITH e AS ({E}), n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS row_idx FROM e) SELECT event_id, row_idx FROM n WHERE row_idx % 5 = 0")
def stride_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.every_nth(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 5).select("event_id", F.col("row_idx").cast("long").alias("row_idx"))


@query(f"""WITH e AS ({E}), n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT DISTINCT event_id FROM n WHERE i IN (floor(0.1 * (n - 1)), floor({0.1 + 0.8 / 4} * (n - 1)), floor({0.1 + 1.6 / 4} * (n - 1)), floor({0.1 + 0.8 * 3 / 4} * (n - 1)), floor({0.1 + 0.8} * (n - 1)))""")
def linspace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.evenly(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 5, 0.1, 0.9).select("event_id")


@query(f"WITH e AS ({E}) SELECT user_id, list_reduce(list(value ORDER BY t, event_id), lambda s, x: s * 0.75 + x * 0.25) AS ema FROM e GROUP BY 1")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))).alias("rows"))
    return ordered.select("user_id", signal.smoothed(F.transform("rows", lambda r: r["value"]), 0.75).alias("ema"))


@query(f"""WITH e AS ({E}), s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM s WHERE event_type <> 'error' GROUP BY 1, 2""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal.islands(events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"""WITH e AS ({E}), s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e)
SELECT user_id, CAST(g AS BIGINT) AS grp, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY 1, 2""")
def next_frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal.ahead_group(events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "purchase")
    return rows.groupBy("user_id", F.col("group").alias("grp")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"WITH e AS ({E}) SELECT event_id, t FROM e WHERE event_type = 'click' UNION ALL SELECT event_id, t FROM e WHERE event_type = 'purchase'")
def union_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.parts_in_line([events(spark, sf_dir, k).select("event_id", "t") for k in ("click", "purchase")], ["t", "event_id"])


@query("SELECT event_id FROM events c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.value > 300)")
def semi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = rows.filter((F.col("event_type") == "purchase") & (F.col("value") > 300)).select("user_id")
    return rows.filter(F.col("event_type") == "click").join(keys, "user_id", "left_semi").select("event_id")


@query("WITH l AS (SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS cell_q, CAST(floor(l_extendedprice / 10000.0) AS BIGINT) AS cell_p, CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem) SELECT cell_q, cell_p, count(*) AS n, CAST(sum(q) AS DOUBLE) / count(*) AS mean_quantity FROM l GROUP BY 1, 2")
def downsample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return signal.voxels(rows, ["q", "p"], [5.0, 10000.0]).select("cell_q", "cell_p", "n", F.col("q").alias("mean_quantity"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0.5 AND 700 * 0.12 / l_quantity BETWEEN 2.0 AND 40.0 THEN 700 * 0.12 / l_quantity END AS depth_m FROM lineitem")
def depth_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", scalar.depth(F.col("l_quantity"), 700, 0.12, 2.0, 40.0).alias("depth_m"))


@query("""WITH l AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) * 8 AS dx, CAST(round(l_discount * 1000) AS BIGINT) - 40 AS dy FROM lineitem),
k AS (SELECT l_suppkey, CASE WHEN dx > 0 AND dx < 300 AND abs(dy) < 60 THEN dy END AS dy FROM l)
SELECT l_suppkey, CASE WHEN count(dy) > 100 THEN quantile_cont(dy, 0.5) END AS offset_px FROM k GROUP BY 1""")
def vertical_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", (F.col("l_quantity").cast("long") * 8).alias("dx"), (F.round(F.col("l_discount") * 1000).cast("long") - 40).alias("dy"))
    return rows.groupBy("l_suppkey").agg(scalar.vertical_offset(F.col("dx"), F.col("dy")).alias("offset_px"))


@query("SELECT event_type, greatest(60.0, 1.05 * max(abs(value))) AS plot_limit FROM events GROUP BY 1")
def plot_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(scalar.plot_limit(F.col("value"), 60.0).alias("plot_limit"))


@query("SELECT event_id, value / 1000.0 AS celsius, least(abs(value) / 300.0, 1.0) * 380.0 AS bar_px FROM events")
def row_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", scalar.celsius(F.col("value")).alias("celsius"), scalar.bar_px(F.col("value")).alias("bar_px"))


@query("SELECT user_id, bool_and(value < 300) AS synced, CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS quality FROM events GROUP BY 1")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", (F.col("value") < 300).cast("int").alias("sync_flags"), F.col("cents").alias("quality_us"))
    return session.sync_quality(rows, ["user_id"]).select("user_id", "synced", F.col("quality_us").alias("quality"))


@query("SELECT event_id, c.user_id, coalesce(p.k, c.user_id) AS k FROM (SELECT * FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT user_id, min(event_id) AS k FROM events WHERE event_type = 'signup' GROUP BY 1) p ON c.user_id = p.user_id")
def coalesce_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = rows.filter(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("event_id").alias("k"))
    return rows.filter(F.col("event_type") == "click").join(own, "user_id", "left").select("event_id", "user_id", F.coalesce("k", "user_id").alias("k"))


_PAIRS = """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.label = b.label),
r AS (SELECT label, a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM d)"""


@query(_PAIRS + " SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.i = 1 AND y.i = 1")
def vec_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual nearest descriptors within every label, without the label."""
    return vec_pairs(spark, sf_dir).select("a", "b")


@query(_PAIRS + " SELECT x.label, x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.i = 1 AND y.i = 1")
def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual nearest descriptors within every label, over the whole table."""
    return matching.mutual_nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "label", "vec_id", "embedding")


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS e FROM embeddings),
d AS (SELECT l.label, l.vec_id AS a, r.vec_id AS b, list_sum(list_transform(list_zip(l.e, r.e), lambda z: xor(z[1], z[2]))) AS d FROM n l JOIN n r ON l.label = r.label AND l.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY label, b ORDER BY d, a) AS j FROM d) SELECT label, a, b, CAST(d AS BIGINT) AS distance FROM k WHERE i = 1 AND j = 1""")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual nearest binary descriptors of two pictures' sets: the signs of vectors of even and of odd numbers, by label."""
    bits = F.rpad(F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), ""), F.expr("8 * cast(ceil(size(embedding) / 8) as int)"), F.lit("0"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", bits.alias("bits"))
    packed = F.expr("unhex(array_join(transform(sequence(1, cast(length(bits) as int), 8), k -> lpad(conv(substring(bits, k, 8), 2, 16), 2, '0')), ''))")
    rows = rows.select("vec_id", "label", packed.alias("descriptor"))
    return matching.mutual_hamming(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), "label", "vec_id", "descriptor")


def _spun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inertial samples: one recording a user, a stationary accelerometer, turn rates from the values."""
    rows = events(spark, sf_dir)
    turn = F.struct((F.col("value") / 400).alias("x"), F.lit(0.0).alias("y"), (F.col("cents") % 7 / 10).alias("z"))
    rest = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(9.81).alias("z"))
    first = F.min("t").over(W.partitionBy("user_id"))
    return rows.select(F.col("user_id").alias("recording_id"), (F.col("t") - first).alias("ts_ns"), turn.alias("gyro"), rest.alias("accel"))
