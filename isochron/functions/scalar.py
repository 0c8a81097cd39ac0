"""Column expressions: code names, flags, identifiers, depth and image geometry of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-scale ranges by code.
ACCEL_RANGES = {0: "±2 g", 1: "±4 g", 2: "±8 g", 3: "±16 g"}
GYRO_RANGES = {0: "±250 dps", 1: "±500 dps", 2: "±1000 dps", 3: "±2000 dps"}


def code_name(code: Column, names: dict[int, str]) -> Column:
    """The code's name, or unknown(code)."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, code.cast("int")), F.concat(F.lit("unknown("), code.cast("string"), F.lit(")")))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def generation(version: Column) -> Column:
    return F.when(version >= 5, "v3").otherwise("legacy")


def identifier(raw: Column) -> Column:
    """Lower-case hexadecimal of bytes, empty for all zeros."""
    text = F.lower(F.hex(raw))
    return F.when(text.rlike("^0*$"), "").otherwise(text)


def label(role: Column, tag: Column, base: Column) -> Column:
    """Role and tag where there are any, else the base name."""
    named = F.concat_ws(" ", F.nullif(role, F.lit("")), F.nullif(tag, F.lit("")))
    return F.when(named != "", named).otherwise(base)


def norm(v: Column) -> Column:
    return F.sqrt(v["x"].cast("double") ** 2 + v["y"].cast("double") ** 2 + v["z"].cast("double") ** 2)


def celsius(milli: Column) -> Column:
    return milli / F.lit(1000.0)


def depth(disparity: Column, fx: float, baseline_m: float, low: float, high: float) -> Column:
    """Depth of a disparity over half a pixel, null outside [low, high]."""
    d = F.when(disparity > 0.5, F.lit(fx * baseline_m) / disparity)
    return F.when(d.between(low, high), d)


def inverse_depth_share(d: Column, low: float, high: float) -> Column:
    """1 at the nearest, 0 at the farthest depth, linear in 1 / depth, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 / d - 1 / high) / (1 / low - 1 / high)))


def shear_px(fx: Column, yaw_dps: Column, readout_s: Column) -> Column:
    """Predicted rolling-shutter shear."""
    return fx * F.radians(yaw_dps) * readout_s


def bar_px(yaw_dps: Column, full: float = 300.0, width: float = 380.0) -> Column:
    return F.least(F.abs(yaw_dps) / full, F.lit(1.0)) * width


def plot_limit(values: Column, floor: float, margin: float = 1.05) -> Column:
    """Aggregate: margin times the largest magnitude, at least the floor."""
    return F.greatest(F.lit(floor), margin * F.max(F.abs(values)))


def match_kept(dx: Column, dy: Column) -> Column:
    """Gate of stereo matches."""
    return (dx > 0) & (dx < 300) & (F.abs(dy) < 60)


def vertical_offset(dx: Column, dy: Column, least: int = 100) -> Column:
    """Aggregate: median vertical offset of the kept matches; null with `least` or fewer."""
    kept = F.when(match_kept(dx, dy), dy)
    return F.when(F.count(kept) > least, F.median(kept))


def frame_rate(milli: Column) -> Column:
    """Frames a second from thousandths."""
    return milli / 1000
