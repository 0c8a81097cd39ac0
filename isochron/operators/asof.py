"""As-of, nearest, interpolating, interval and grid joins on long times.

All point joins rest on one rewrite, `bracket`: queries and samples are put into one relation, sorted by time within
their key, and each query takes the last sample before or at its time and the first one after it. That is one shuffle
and a sort each way, whatever the number of matches: both sides are running values, one from the start of the series and
one from its end. With `bucket`, long series are split by time buckets, so that one key may hold most rows: each bucket
is given the nearest samples around it, found on one row for each key and bucket.

Samples that share key and time are reduced to one, the smallest by their columns in order. Samples with a null key or
time match nothing; queries with a null key or time stay, without a match; repeated queries each stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def floor_div(x: Column | str, n: int) -> Column:
    """Floor of x / n in exact long arithmetic, for negative x too."""
    x = F.col(x) if isinstance(x, str) else x
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("long")), F.lit(n).cast("long"))


def bracket(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], bucket: int | None = None) -> DataFrame:
    """The queries with `lo` and `hi`: structs (t, values...) of the samples at or before and after each time, or null."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, on)))
    right = samples.filter(known).groupBy(*keys, on).agg(F.min(F.struct(*values)).alias("v"))
    right = right.select(*keys, F.col(on).alias("asof_t"), F.struct(F.col(on).alias("t"), *(F.col(f"v.{c}").alias(c) for c in values)).alias("asof_sample"))
    left = queries.withColumn("asof_query", F.struct(*queries.columns)).select(*keys, F.col(on).alias("asof_t"), "asof_query")
    kind = right.schema["asof_sample"].dataType
    parts = left.withColumn("asof_sample", F.lit(None).cast(kind)).withColumn("asof_order", F.lit(1))
    given = right.withColumn("asof_query", F.lit(None).cast(left.schema["asof_query"].dataType)).withColumn("asof_order", F.lit(0))
    both = parts.unionByName(given)
    by = list(keys)
    if bucket:
        both = both.withColumn("asof_bucket", floor_div("asof_t", bucket))
        edges = both.groupBy(*keys, "asof_bucket").agg(F.min("asof_sample").alias("first"), F.max("asof_sample").alias("last"))
        whole = W.partitionBy(*keys).orderBy("asof_bucket")
        before = F.last("last", ignorenulls=True).over(whole.rowsBetween(W.unboundedPreceding, -1))
        after = F.last("first", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("asof_bucket")).rowsBetween(W.unboundedPreceding, -1))
        around = edges.select(*keys, "asof_bucket", F.array(before, after).alias("around"))
        carried = around.select(*keys, "asof_bucket", F.explode("around").alias("asof_sample")).filter("asof_sample is not null")
        carried = carried.withColumns({"asof_t": F.col("asof_sample.t"), "asof_query": F.lit(None).cast(left.schema["asof_query"].dataType), "asof_order": F.lit(0)})
        both = both.unionByName(carried)
        by.append("asof_bucket")
    behind = W.partitionBy(*by).orderBy("asof_t", "asof_order").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(F.desc("asof_t"), F.desc("asof_order")).rowsBetween(W.unboundedPreceding, 0)
    timed = lambda w: F.when(F.col("asof_t").isNotNull(), F.last("asof_sample", ignorenulls=True).over(w))
    return both.select("asof_query", timed(behind).alias("lo"), timed(ahead).alias("hi")).filter("asof_query is not null").select("asof_query.*", "lo", "hi")


def backward(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Each query with `match`, the last sample at or before its time."""
    return bracket(queries, samples, keys, on, values, bucket).withColumnRenamed("lo", "match").drop("hi")


def forward(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], bucket: int | None = None, clamp: bool = False) -> DataFrame:
    """Each query with `match`, the first sample at or after its time; clamped to the last one where asked for."""
    both = bracket(queries, samples, keys, on, values, bucket)
    match = F.when(F.col("lo.t") == F.col(on), F.col("lo")).otherwise(F.col("hi"))
    return both.withColumn("match", F.coalesce(match, F.col("lo")) if clamp else match).drop("lo", "hi")


def by_share(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each query with `match`, the sample at the same share of its key's length: for streams that have no times in common.

    Of n samples and `total` queries, in the order of `on`, query number f takes sample int(f / total * (n - 1)). A key
    without samples has no match.
    """
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    placed = samples.select(*(F.col(k).alias(f"share_{k}") for k in keys), F.struct(*values).alias("match"), place.alias("share_place"), F.count("*").over(W.partitionBy(*keys)).alias("share_n"))
    sizes = placed.groupBy(*(f"share_{k}" for k in keys)).agg(F.first("share_n").alias("share_n"))
    known = queries.withColumns({"share_f": F.row_number().over(W.partitionBy(*keys).orderBy(on)) - 1, "share_total": F.count("*").over(W.partitionBy(*keys))})
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"share_{k}") for k in keys))
    sized = known.join(sizes, same, "left").withColumn("share_at", F.floor(F.col("share_f") / F.col("share_total") * (F.col("share_n") - 1)).cast("int")).drop(*(f"share_{k}" for k in keys), "share_n")
    at = F.col("share_at") == F.col("share_place")
    return sized.join(placed.drop("share_n"), same & at, "left").select(*queries.columns, "match")


def nearest(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], gate: int | Column | None = None, bucket: int | None = None) -> DataFrame:
    """Each query with `match`, the sample nearest in time: the earlier one of two as near, null beyond the gate."""
    both = bracket(queries, samples, keys, on, values, bucket)
    behind, ahead = F.col(on) - F.col("lo.t"), F.col("hi.t") - F.col(on)
    match = F.when(F.col("hi").isNull() | (F.col("lo").isNotNull() & (behind <= ahead)), F.col("lo")).otherwise(F.col("hi"))
    out = both.withColumn("match", match).drop("lo", "hi")
    if gate is not None:
        limit = F.lit(gate) if isinstance(gate, int) else gate
        out = out.withColumn("match", F.when(F.abs(F.col("match.t") - F.col(on)) <= limit, F.col("match")))
    return out


def interpolate(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Each query with the values interpolated linearly between the samples around it, clamped at both ends."""
    both = bracket(queries, samples, keys, on, values, bucket)
    share = (F.col(on) - F.col("lo.t")).cast("double") / (F.col("hi.t") - F.col("lo.t")).cast("double")

    def at(c: str) -> Column:
        low, high = F.col(f"lo.{c}").cast("double"), F.col(f"hi.{c}").cast("double")
        return F.when(F.col("lo").isNull(), high).when(F.col("hi").isNull() | (F.col("lo.t") == F.col(on)), low).otherwise(low + (high - low) * share)

    return both.select(*queries.columns, *(at(c).alias(f"{c}_at") for c in values))


def between(queries: DataFrame, samples: DataFrame, keys: Sequence[str], on: str, length: int, values: Sequence[str]) -> DataFrame:
    """Each query joined with the samples in [t, t + length], both ends included; queries without one stay, with nulls.

    Times fall into buckets of `length`, so that an interval touches two of them and the join is one on equal keys. What
    is met depends on key and time alone: it is found once for each of them and joined back by them, so that queries
    that repeat or have nulls in other columns keep a row for each match.
    """
    at = floor_div(on, length)
    times = queries.select(*keys, on).filter(F.col(on).isNotNull()).distinct()
    left = times.withColumn("between_bucket", F.explode(F.array(at, at + 1)))
    right = samples.select(*keys, F.col(on).alias("sample_t"), *(F.col(c).alias(f"sample_{c}") for c in values)).withColumn("between_bucket", floor_div("sample_t", length))
    met = left.join(right, [*keys, "between_bucket"]).filter((F.col("sample_t") >= F.col(on)) & (F.col("sample_t") <= F.col(on) + length))
    found = queries.join(met.select(*keys, on, "sample_t", *(f"sample_{c}" for c in values)), [*keys, on], "left")
    return found.select(*queries.columns, "sample_t", *(f"sample_{c}" for c in values))


def grid(samples: DataFrame, streams: str, on: str, step: int, values: Sequence[str], bucket: int | None = None) -> DataFrame:
    """N-way synchronised grid: over the time all streams share, every `step`, each stream's nearest sample.

    (t, stream, match); streams without a common time give no rows. The two bounds are read first, so that the grid is a
    range that Spark deals over tasks.
    """
    ranges = samples.filter(F.col(streams).isNotNull()).groupBy(streams).agg(F.min(on).alias("low"), F.max(on).alias("high"))
    low, high = ranges.agg(F.max("low"), F.min("high")).first()
    if low is None or high is None or low > high:
        low, high = 0, -1
    times = samples.sparkSession.range(low, high + 1, step).select(F.col("id").alias(on))
    # The result itself has a row for each time and stream.
    points = times.crossJoin(ranges.select(streams))
    return nearest(points, samples, [streams], on, values, bucket=bucket)
