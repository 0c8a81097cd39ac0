"""The tables behind charts: points of a time window scaled to a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.operators import signal

#: Fixed values of a panel: margin of the values, and the least span that is not widened to one unit around its middle.
MARGIN, LEAST_SPAN = 0.5, 1.0


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def panel(rows: DataFrame, keys: Sequence[str], on: str, value: str, center: Column | float, half: float, width: int) -> DataFrame:
    """keys, on, value, segment, across, up: the points of [max(0, center - half), center + half], shares from left and bottom.

    At most about 2 * width points of a key are kept, evenly by place. Points that are no finite number end a segment and
    are left out; a key with fewer than two points in the window, or without a finite one, has no rows.
    """
    middle = center if isinstance(center, Column) else F.lit(float(center))
    low, high = F.greatest(middle - half, F.lit(0.0)), middle + half
    whole = W.partitionBy(*keys)
    line = whole.orderBy(on, value)
    shown = signal.within(rows.select(*keys, on, F.col(value).cast("double").alias(value)), on, low, high).withColumn("number", finite(F.col(value)))
    shown = shown.withColumns({"n": F.count("*").over(whole), "least": F.min("number").over(whole) - MARGIN, "most": F.max("number").over(whole) + MARGIN, "place": F.row_number().over(line) - 1})
    shown = shown.filter((F.col("n") > 1) & F.col("least").isNotNull() & (F.col("place") % F.greatest(F.expr(f"n div {int(width)}"), F.lit(1)) == 0))
    pieces = signal.islands(shown, keys, [on, "place"], F.col("number").isNull()).withColumnRenamed("island", "segment")
    flat, mid = F.col("most") - F.col("least") < LEAST_SPAN, (F.col("most") + F.col("least")) / 2
    bottom, top = F.when(flat, mid - 1).otherwise(F.col("least")), F.when(flat, mid + 1).otherwise(F.col("most"))
    return pieces.select(*keys, on, value, "segment", ((F.col(on) - low) / (high - low)).alias("across"), ((F.col("number") - bottom) / (top - bottom)).alias("up"))


def available(samples: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """(keys, channel) of the channels that a recording has any value of, so that panels of the others are left out."""
    known = samples.groupBy(*keys).agg(*(F.count(c).alias(c) for c in channels))
    there = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in channels)))
    return known.select(*keys, F.explode(there).alias("channel"))
