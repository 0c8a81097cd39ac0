"""Takes of several recordings: grouping by session, common time, parts in one line, pairs and members."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(meta: DataFrame) -> DataFrame:
    """Per session: how many recordings, and which, sorted."""
    return meta.filter("session is not null").groupBy("session").agg(F.countDistinct("recording_id").alias("n"), F.sort_array(F.collect_set("recording_id")).alias("members"))


def largest(meta: DataFrame) -> DataFrame:
    """The session with most recordings, the later one of equals."""
    return members(meta).orderBy(F.desc("n"), F.desc("session")).limit(1)


def parts_in_line(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """All parts, sorted by global time with part and frame to settle ties."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def common_range(rows: DataFrame, stream: str, on: str) -> DataFrame:
    """(low, high): the time that all streams share; no row where they share none."""
    each = rows.groupBy(stream).agg(F.min(on).alias("low"), F.max(on).alias("high"))
    return each.agg(F.max("low").alias("low"), F.min("high").alias("high")).filter("low <= high")


def sync_quality(headers: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Over the parts: whether all are synced, and the worst quality."""
    synced = F.col("sync_flags").bitwiseAND(F.lit(1)) != 0
    return headers.groupBy(*keys).agg(F.bool_and(synced).alias("synced"), F.max("quality_us").alias("quality_us"))


def complete(videos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Videos that have a sidecar of the same recording and part."""
    return videos.join(sidecars.select("recording_id", "part").distinct(), ["recording_id", "part"], "left_semi")
