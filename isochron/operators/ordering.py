"""Exact ranks and order statistics of keys of any size.

Rows are range-partitioned by key and value and sorted within their part, so that a key may hold all rows; the ranks of a
part start after the rows of the key in the parts before it, of which there is one count for each part and key. The sorted
rows are written to the shared folder once, as range bounds come from a sample that another run would draw anew.
No row, and no task's memory, grows with a key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in spark.checkpoint.dir; where none is set, of this machine under a local master."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="isochron-"))
    return df.checkpoint(eager=True)


def dealt(rows: DataFrame, *by: str | Column) -> DataFrame:
    """The rows over four tasks a core, or as many as Spark shuffles to, however few bytes they have: for small rows that are much work."""
    spark = rows.sparkSession
    return rows.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


#: Rows that a task of `spread` is given on average, at most, unless the caller says otherwise.
SPREAD = 250_000


def spread(rows: DataFrame, n: int, *by: str | Column, most: int | None = None) -> DataFrame:
    """`n` rows as `dealt` deals them, but over more tasks the more rows there are, so that no task's share grows with the table."""
    spark = rows.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, -(-n // (most or SPREAD))), *by)


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds `rank`, each row's place from 0 among its key's rows in the order of these columns; nulls come first.

    Which of several equal rows has which place is not defined. Columns named rank_* are taken.
    """
    whole = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order) if keys or order else rows
    placed = cut(whole.withColumn("rank_at", F.monotonically_increasing_id())).withColumn("rank_part", F.shiftright("rank_at", 33))
    parts = placed.groupBy(*keys, "rank_part").agg(F.min("rank_at").alias("rank_low"), F.count("*").alias("rank_n"))
    by = f"partition by {', '.join(f'`{k}`' for k in keys)}" if keys else "partition by 1"
    before = f"coalesce(sum(rank_n) over ({by} order by rank_part rows between unbounded preceding and 1 preceding), 0) - rank_low"
    offsets = parts.select(*(F.col(k).alias(f"rank_{i}") for i, k in enumerate(keys)), F.col("rank_part").alias("rank_of"), F.expr(before).alias("rank_shift"))
    same = F.col("rank_part") == F.col("rank_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"rank_{i}"))
    return placed.join(offsets, same).select(*rows.columns, (F.col("rank_at") + F.col("rank_shift")).alias("rank"))


def statistics(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float | str]) -> DataFrame:
    """One row per key with the wanted order statistics of its values that are no null: exact, by rank.

    A number q is the interpolated quantile at q (n - 1); `upper` is the value at place n div 2, the upper of two middles.
    `n` counts the values; a key without any has no row.
    """
    named = rows.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.col(value).alias("value")).filter("value is not null")
    by = [f"key_{i}" for i in range(len(keys))]
    placed = ranked(named, by, ["value"])
    sizes = placed.groupBy(*by).agg(F.count("*").alias("n"))
    places = []
    for name, q in wanted.items():
        at = F.floor(F.col("n") / 2).cast("double") if q == "upper" else (F.col("n") - 1) * F.lit(float(q))
        places += [F.struct(F.lit(name).alias("name"), F.floor(at).cast("long").alias("place"), (1 - (at - F.floor(at))).alias("share")), F.struct(F.lit(name).alias("name"), F.ceil(at).cast("long").alias("place"), (at - F.floor(at)).alias("share"))]
    asked = sizes.select(*(F.col(k).alias(f"asked_{k}") for k in by), "n", F.explode(F.array(*places)).alias("at")).filter("at.share > 0")
    same = F.col("rank") == F.col("at.place")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"asked_{k}"))
    met = placed.join(asked, same)
    own = lambda name, x: F.when(F.col("at.name") == name, x)
    whole = lambda name: (F.max(own(name, F.col("value"))) if wanted[name] == "upper" else F.sum(own(name, F.col("value") * F.col("at.share")))).alias(name)
    out = met.groupBy(*by).agg(F.first("n").alias("n"), *(whole(name) for name in wanted))
    return out.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), "n", *wanted)
