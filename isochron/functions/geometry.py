"""Matrices, quaternions (structs x, y, z, w) and fisheye projection, as column expressions and for the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rigid_inverse(t: np.ndarray) -> np.ndarray:
    """Inverse of a 4x4 rigid transform: transposed rotation, turned translation."""
    out = np.eye(4)
    out[:3, :3] = t[:3, :3].T
    out[:3, 3] = -t[:3, :3].T @ t[:3, 3]
    return out


def once(value: Column, body) -> Column:
    """body(value), the value computed once for each row however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matmul(a: Column, b: Column) -> Column:
    """Product of matrices as arrays of rows."""
    return once(a, lambda left: once(b, lambda right: _product(left, right)))


def _product(a: Column, b: Column) -> Column:
    cell = lambda row, j: F.aggregate(F.zip_with(row, F.transform(b, lambda r: F.get(r, j)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), F.size(F.get(b, F.lit(0))) - 1), lambda j: cell(row, j)))


def inverse(t: Column) -> Column:
    """Inverse of a rigid transform given as four rows."""
    return once(t, _inverse)


def _inverse(t: Column) -> Column:
    e = lambda i, j: F.get(F.get(t, F.lit(i)), F.lit(j))
    moved = [-(e(0, i) * e(0, 3) + e(1, i) * e(1, 3) + e(2, i) * e(2, 3)) for i in range(3)]
    return F.array(*(F.array(e(0, i), e(1, i), e(2, i), moved[i]) for i in range(3)), F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def quat(x, y, z, w) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip("xyzw", (x, y, z, w), strict=True)))


def multiply(a: Column, b: Column) -> Column:
    """Hamilton product a b: the turn b, then a."""
    ax, ay, az, aw = (a[n] for n in "xyzw")
    bx, by, bz, bw = (b[n] for n in "xyzw")
    return quat(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def conjugate(q: Column) -> Column:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def magnitude(q: Column) -> Column:
    return F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"])


def unit(q: Column) -> Column:
    return once(q, lambda v: once(magnitude(v), lambda n: quat(v["x"] / n, v["y"] / n, v["z"] / n, v["w"] / n)))


def slerp(a: Column, b: Column, share: Column) -> Column:
    """Spherical interpolation along the shorter arc; linear where the ends nearly agree."""

    def between(v: Column) -> Column:
        dot = sum((v["a"][n] * v["b"][n] for n in "yzw"), v["a"]["x"] * v["b"]["x"])
        return once(F.struct(F.when(dot < 0, -1.0).otherwise(1.0).alias("sign"), F.acos(F.least(F.abs(dot), F.lit(1.0))).alias("angle")), lambda arc: blended(v, arc))

    def blended(v: Column, arc: Column) -> Column:
        angle, share = arc["angle"], v["share"]
        flat = F.sin(angle) < 1e-6
        left = F.when(flat, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
        right = arc["sign"] * F.when(flat, share).otherwise(F.sin(share * angle) / F.sin(angle))
        return once(F.struct(left.alias("left"), right.alias("right")), lambda k: quat(*(k["left"] * v["a"][n] + k["right"] * v["b"][n] for n in "xyzw")))

    return unit(once(F.struct(a.alias("a"), b.alias("b"), share.alias("share")), between))


def matrix(q: Column) -> Column:
    """Rotation matrix of a unit quaternion, as three rows."""
    x, y, z, w = (q[n] for n in "xyzw")
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def euler_deg(q: Column) -> Column:
    """Roll, pitch and yaw about fixed x, y, z axes in degrees."""
    x, y, z, w = (q[n] for n in "xyzw")
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x))))
    return F.struct(F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))).alias("roll"), F.degrees(pitch).alias("pitch"), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))).alias("yaw"))


def fisheye(x: Column, y: Column, z: Column, k: tuple[float, float, float, float], fx: float, fy: float, cx: float, cy: float) -> Column:
    """Image point of a camera-frame point by the equidistant model."""
    r = F.sqrt(x * x + y * y)
    theta = F.atan2(r, z)
    t2 = theta * theta
    bent = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    scale = F.when(r > 1e-12, bent / r).otherwise(F.lit(0.0))
    return F.struct((fx * x * scale + cx).alias("u"), (fy * y * scale + cy).alias("v"))


def unfisheye(u: Column, v: Column, k: tuple[float, float, float, float], fx: float, fy: float, cx: float, cy: float, steps: int = 12) -> Column:
    """The ray (x, y, 1) that `fisheye` puts at an image point: the angle by Newton steps; rays ahead of the camera only."""
    a, b = (u - cx) / fx, (v - cy) / fy
    bent = F.sqrt(a * a + b * b)

    def nearer(theta: Column, _: Column) -> Column:
        t2 = theta * theta
        value = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
        slope = 1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
        return theta - (value - bent) / slope

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bent, nearer)
    scale = F.when(bent > 1e-12, F.tan(theta) / bent).otherwise(F.lit(1.0))
    return F.struct((a * scale).alias("x"), (b * scale).alias("y"))


def baseline(placed: Column) -> Column:
    """Distance of two cameras from the 4x4 placement of one in the other; rectified images keep it."""
    return F.sqrt(sum((placed[k][3] * placed[k][3] for k in (1, 2)), placed[0][3] * placed[0][3]))


#: The panel's view of the axes.
VIEW = ((1.0, 0.0, 0.0), (0.0, 0.85, -0.53), (0.0, 0.53, 0.85))


def axis_tips(q: Column, view: Sequence[Sequence[float]] = VIEW) -> Column:
    """Where the tips of the turned x, y and z axes lie in the panel: three structs (right, up), in axis lengths."""
    seen = lambda m, row, axis: sum((view[row][j] * m[j][axis] for j in (1, 2)), view[row][0] * m[0][axis])
    return once(matrix(q), lambda m: F.array(*(F.struct(seen(m, 0, k).alias("right"), seen(m, 1, k).alias("up")) for k in range(3))))
