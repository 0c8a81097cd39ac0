"""Which files belong together: members of a recording, its parts, stereo takes. Only paths are listed; no file is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("mp4", "vts", "imu", "tel")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files under a folder that hold anything."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def members(listed: DataFrame) -> DataFrame:
    """(path) to recording_id, part, take, eye, kind, path.

    `<recording>/part003.mp4` is part 3 of the folder's recording, `<recording>/meta.json` tells of all its parts, and any
    other file is part 0 of the recording of its name. A name that ends in _L or _R is also one eye of a stereo take.
    """
    folder, stem = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), F.regexp_extract("path", r"([^/]+)\.[^/.]+$", 1)
    part, eye = F.regexp_extract("path", r"/part(\d+)\.[^/.]+$", 1), F.regexp_extract("path", r"_([LR])\.[^/.]+$", 1)
    inside = (part != "") | (stem == "meta")
    return listed.select(
        F.when(inside, folder).otherwise(stem).alias("recording_id"), F.when(part != "", part.try_cast("int")).otherwise(F.lit(0)).alias("part"),
        F.when(inside, folder).otherwise(F.regexp_replace(stem, "_[LR]$", "")).alias("take"), F.when(eye != "", eye).alias("eye"),
        F.lower(F.regexp_extract("path", r"\.([^/.]+)$", 1)).alias("kind"), "path",
    )


def _path(kind: str, eye: str | None = None) -> Column:
    return F.min(F.when((F.col("kind") == kind) & (F.lit(True) if eye is None else F.col("eye") == eye), F.col("path")))


def parts(found: DataFrame) -> DataFrame:
    """Members to one row for each part: a path for each kind, meta, and whether it can be put on the shared clock.

    meta is the recording's own .json, else the meta.json of its folder; a part is placeable with both video and frame times.
    """
    own = F.col("path").endswith("/meta.json")
    every = W.partitionBy("recording_id")
    json = lambda inner: F.min(F.when((F.col("kind") == "json") & (own if inner else ~own), F.col("path"))).over(every)
    described = found.withColumn("meta", F.coalesce(json(False), json(True))).filter(F.col("kind").isin(*KINDS))
    out = described.groupBy("recording_id", "part").agg(*(_path(k).alias(k) for k in KINDS), F.min("meta").alias("meta"))
    return out.withColumn("placeable", F.col("mp4").isNotNull() & F.col("vts").isNotNull())


def stereo_takes(found: DataFrame) -> DataFrame:
    """Members to one row for each take with a left or right video: paths, where times come from, whether it is complete.

    Times and samples come from the sidecar where there is one, else from what the videos embed (samples: the left one).
    """
    eyes = found.filter(F.col("eye").isNotNull() | (F.col("kind") == "imu"))
    out = eyes.groupBy("take").agg(
        *(_path(kind, eye).alias(f"{kind}_{eye.lower()}") for kind in ("mp4", "vts") for eye in "LR"),
        F.min(F.when((F.col("kind") == "imu") & F.col("eye").isNull(), F.col("path"))).alias("imu"),
    )
    source = lambda c: F.when(F.col(c).isNotNull(), F.lit("sidecar")).otherwise(F.lit("embedded"))
    out = out.filter("mp4_l is not null or mp4_r is not null").withColumn("complete", F.col("mp4_l").isNotNull() & F.col("mp4_r").isNotNull())
    return out.withColumns({f"{c}_from": source(c) for c in ("vts_l", "vts_r", "imu")})
