"""Differences, gaps, onsets, islands, robust statistics, smoothing and trajectory measures over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.operators import ordering


def step(value: str | Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Difference from the row before; null for a key's first row."""
    value = F.col(value) if isinstance(value, str) else value
    return value - F.lag(value).over(W.partitionBy(*keys).orderBy(*order))


def cadence(rows: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
    """Per key: rows, span, mean, population deviation and median of the steps; rates are null without a span."""
    steps = rows.withColumn("step", step(on, keys, [on]))
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.max(on) - F.min(on)).alias("span"),
        F.avg("step").alias("mean_step"),
        F.stddev_pop("step").alias("std_step"),
        F.median("step").alias("median_step"),
        F.try_divide(F.count("*") - 1, F.max(on) - F.min(on)).alias("rate"),
    )


def gaps(rows: DataFrame, keys: Sequence[str], on: str, factor: float = 1.5, nominal: Column | None = None) -> DataFrame:
    """Rows that come later than factor * nominal after the one before; nominal is the key's median step by default."""
    steps = rows.withColumn("step", step(on, keys, [on]))
    if nominal is None:
        middle = steps.groupBy(*keys).agg(F.median("step").alias("nominal"))
        steps = steps.join(middle, list(keys))
    else:
        steps = steps.withColumn("nominal", nominal)
    return steps.filter(F.col("step") > F.col("nominal") * factor)


def onset(rows: DataFrame, keys: Sequence[str], on: str | Sequence[str], value: str, jump: float = 2.0) -> DataFrame:
    """Per key the first time at which the value moves by more than `jump`; null where it never does."""
    order = _order(on)
    moved = rows.withColumn("moved", F.abs(step(value, keys, order)) > jump)
    return moved.groupBy(*keys).agg(F.min(F.when(F.col("moved"), F.col(order[0]))).alias("onset"))


def upper_median(rows: DataFrame, keys: Sequence[str], value: str, least: int = 0) -> DataFrame:
    """Per key `upper`, element n div 2 of its sorted values (the upper one of two middles), and their number n.

    Null with `least` values or fewer; a key without values has no row. Exact for keys of any size, see `ordering`.
    """
    found = ordering.statistics(rows, keys, value, {"upper": "upper"})
    return found.withColumn("upper", F.when(F.col("n") > least, F.col("upper")))


def sample_rate(rows: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
    """Per key round(1e9 / upper median of the positive steps), from more than 10 steps; else null."""
    steps = rows.withColumn("step", step(on, keys, [on]))
    middle = upper_median(steps.withColumn("step", F.when(F.col("step") > 0, F.col("step"))), keys, "step", 10)
    found = middle.select(*(F.col(k).alias(f"rate_{k}") for k in keys), F.bround(F.lit(1e9) / F.col("upper")).cast("long").alias("rate_hz"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"rate_{k}"))
    return rows.select(*keys).distinct().join(found, same, "left").select(*keys, "rate_hz")


def _order(on: str | Sequence[str]) -> list[str]:
    """Columns that put rows in order; with ties in time, give more than one."""
    return [on] if isinstance(on, str) else list(on)


def islands(rows: DataFrame, keys: Sequence[str], on: str | Sequence[str], breaks: Column) -> DataFrame:
    """Rows with `island`: how many breaking rows came before; breaking rows are left out, an unknown break is none."""
    before = F.coalesce(F.sum(breaks.cast("int")).over(W.partitionBy(*keys).orderBy(*_order(on)).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("island", before.cast("long")).filter(~F.coalesce(breaks, F.lit(False)))


def ahead_group(rows: DataFrame, keys: Sequence[str], on: str | Sequence[str], closes: Column) -> DataFrame:
    """Rows with `group`: the number of the closing row that each belongs to, itself or the next one (data before frame)."""
    before = F.sum(closes.cast("int")).over(W.partitionBy(*keys).orderBy(*_order(on)).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("group", F.coalesce(before, F.lit(0)).cast("long"))


def every_nth(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, with_last: bool = False) -> DataFrame:
    """Each key's rows 0, n, 2n, ...; and its last one where asked for."""
    w = W.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("row_idx", F.row_number().over(w) - 1)
    keep = F.col("row_idx") % n == 0
    if with_last:
        numbered = numbered.withColumn("row_last", F.count("*").over(W.partitionBy(*keys)) - 1)
        return numbered.filter(keep | (F.col("row_idx") == F.col("row_last"))).drop("row_last")
    return numbered.filter(keep)


def evenly(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """`n` rows of each key at even shares of its length from `low` to `high`."""
    numbered = rows.withColumn("row_idx", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).withColumn("row_n", F.count("*").over(W.partitionBy(*keys)))
    shares = [low + (high - low) * k / max(n - 1, 1) for k in range(n)]
    wanted = F.array(*(F.floor(F.lit(s) * (F.col("row_n") - 1)).cast("long") for s in shares))
    return numbered.filter(F.array_contains(wanted, F.col("row_idx").cast("long"))).drop("row_n")


def smoothed(values: Column, keep: float) -> Column:
    """Exponential average of an ordered array: the first value seeds, null resets; the value after the last one."""
    added = float(1 - Decimal(str(keep)))  # 0.1 for 0.9, not 0.09999999999999998
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.when(x.isNull(), F.lit(None).cast("double")).when(s.isNull(), x).otherwise(s * keep + x * added))


def percentile_clip(rows: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98, margin: float = 0.5) -> DataFrame:
    """Rows inside [p_low - margin, p_high + margin] in every column, by exact percentiles of the whole table."""
    joined = rows
    for c in columns:
        bounds = ordering.statistics(rows, [], c, {"low": low, "high": high}).select(F.col("low").alias("clip_low"), F.col("high").alias("clip_high"))
        kept = (F.col(c) >= F.col("clip_low") - margin) & (F.col(c) <= F.col("clip_high") + margin)
        joined = joined.crossJoin(F.broadcast(bounds)).filter(kept).drop("clip_low", "clip_high")  # one row of bounds
    return joined


def trajectory(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Per key: points, path length, displacement, drift in percent of the length, and extents."""
    moved, last = [step(a, keys, _order(order)) for a in axes], F.struct(*_order(order))
    measured = rows.withColumn("moved", F.sqrt(sum((m * m for m in moved[1:]), moved[0] * moved[0])))
    ends = [F.max_by(a, last) - F.min_by(a, last) for a in axes]
    length = F.coalesce(F.sum("moved"), F.lit(0.0))
    displacement = F.sqrt(sum((e * e for e in ends[1:]), ends[0] * ends[0]))
    return measured.groupBy(*keys).agg(
        F.count("*").alias("n"), length.alias("path_length"), displacement.alias("displacement"),
        (100 * displacement / F.greatest(length, F.lit(1e-9))).alias("drift_pct"), *((F.max(a) - F.min(a)).alias(f"extent_{a}") for a in axes),
    )


def voxels(rows: DataFrame, axes: Sequence[str], size: float | Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One averaged point for each occupied cube of `size`, or box of a size for each axis."""
    sizes = [size] * len(axes) if isinstance(size, (int, float)) else size
    cells = [F.floor(F.col(a) / s).alias(f"cell_{a}") for a, s in zip(axes, sizes, strict=True)]
    return rows.groupBy(*keys, *cells).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in axes))


def within(rows: DataFrame, on: str, low: Column | float | None = None, high: Column | float | None = None, closed: bool = True) -> DataFrame:
    """Rows of a take's time range: both ends included, or without the later one; no bound, no limit on that side."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    if low is not None:
        rows = rows.filter(F.col(on) >= as_column(low))
    if high is not None:
        rows = rows.filter((F.col(on) <= as_column(high)) if closed else (F.col(on) < as_column(high)))
    return rows


def frame_range(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fps: float, start_s: float = 0.0, end_s: float | None = None) -> DataFrame:
    """Rows whose place in their recording lies in [int(start * fps), int(end * fps)), with row_idx."""
    numbered = rows.withColumn("row_idx", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return within(numbered, "row_idx", int(start_s * fps), None if end_s is None else int(end_s * fps), closed=False)


def masked_before(value: str, on: str, onset: Column) -> Column:
    """The value from its onset on; null before it, and everywhere where there is no onset."""
    return F.when(F.col(on) >= onset, F.col(value))


def present(values: Column) -> Column:
    """The values with null for those that are no number, so that aggregates leave them out."""
    return F.when(~F.isnan(values), values)


def delays(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: how many values are numbers, their mean, median and maximum; null where none is."""
    v = present(F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("largest"))


def sampled(rows: DataFrame, identity: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """`n` rows without replacement, the same ones for a seed: those with the smallest keyed hashes of their identity."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *identity), *identity).limit(n)


def thermal(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: lowest and highest temperature in degrees, and how many records are throttled (a state above 0)."""
    milli = F.col("temp_milli_c")
    return rows.groupBy(*keys).agg((F.min(milli) / 1000).alias("low_c"), (F.max(milli) / 1000).alias("high_c"), F.count_if(F.col("thermal_state") > 0).alias("throttled"))
