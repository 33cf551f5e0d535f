"""Geometry as Column expressions: everything here stays inside Catalyst's generated code.

A vector is a struct (x, y, z), a pose a struct (qx, qy, qz, qw, tx, ty, tz) of a unit quaternion and a translation.
Divisions are guarded, since filters may be moved past them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


@dataclass(frozen=True)
class Intrinsics:
    """A pinhole camera without distortion, and its image size."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int = 0
    height: int = 0


def vec(x, y, z) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip("xyz", (x, y, z), strict=True)))


def pose(qx, qy, qz, qw, tx, ty, tz, normalize: bool = True) -> Column:
    """A pose; the quaternion is normalised as a constructor would."""
    q = [F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (qx, qy, qz, qw)]
    t = [F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (tx, ty, tz)]
    if normalize:
        n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        q = [F.try_divide(v, n) for v in q]
    return F.struct(*(v.alias(n) for n, v in zip(("qx", "qy", "qz", "qw", "tx", "ty", "tz"), (*q, *t), strict=True)))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: nested pose expressions would otherwise be copied into each of their uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def rotate(q: Column, v: Column) -> Column:
    """The rotation of a pose applied to a vector: p + w * uv + q x uv with uv = 2 (q x p)."""
    ux = 2 * (q.qy * v.z - q.qz * v.y)
    uy = 2 * (q.qz * v.x - q.qx * v.z)
    uz = 2 * (q.qx * v.y - q.qy * v.x)
    return vec(
        v.x + q.qw * ux + (q.qy * uz - q.qz * uy),
        v.y + q.qw * uy + (q.qz * ux - q.qx * uz),
        v.z + q.qw * uz + (q.qx * uy - q.qy * ux),
    )


def act(p: Column, v: Column) -> Column:
    """A pose applied to a point."""
    r = rotate(p, v)
    return vec(r.x + p.tx, r.y + p.ty, r.z + p.tz)


def compose(a: Column, b: Column) -> Column:
    """a after b."""
    t = act(a, vec(b.tx, b.ty, b.tz))
    return pose(
        a.qw * b.qx + a.qx * b.qw + a.qy * b.qz - a.qz * b.qy,
        a.qw * b.qy + a.qy * b.qw + a.qz * b.qx - a.qx * b.qz,
        a.qw * b.qz + a.qz * b.qw + a.qx * b.qy - a.qy * b.qx,
        a.qw * b.qw - a.qx * b.qx - a.qy * b.qy - a.qz * b.qz,
        t.x, t.y, t.z,
    )


def inverse(p: Column) -> Column:
    back = F.struct((-p.qx).alias("qx"), (-p.qy).alias("qy"), (-p.qz).alias("qz"), p.qw.alias("qw"))
    t = rotate(back, vec(-p.tx, -p.ty, -p.tz))
    return pose(-p.qx, -p.qy, -p.qz, p.qw, t.x, t.y, t.z, normalize=False)


def project(k: Intrinsics, v: Column) -> tuple[Column, Column]:
    """(u, v) in pixels; null for a point that isn't in front of the camera."""
    z = F.when(v.z > 0, v.z)
    return k.fx * v.x / z + k.cx, k.fy * v.y / z + k.cy


def back_project(k: Intrinsics, u: Column, v: Column, depth: Column) -> Column:
    return vec((u - k.cx) / k.fx * depth, (v - k.cy) / k.fy * depth, depth)


def pixel(x: Column, size: int) -> Column:
    """The nearest whole pixel (halves away from zero) as int; null outside 0 .. size - 1."""
    # `round` goes through decimal numbers, some microseconds each; what is cut off here is exact
    whole = x.cast("int")
    return F.when((x > -0.5) & (x < size - 0.5), whole + F.when(x - whole >= 0.5, 1).otherwise(0))


def slerp(a: Column, b: Column, alpha: Column) -> Column:
    """The rotation between two, on the shorter arc, as a struct (qx, qy, qz, qw)."""
    dot = a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw
    near = F.least(F.abs(dot), F.lit(1.0))
    theta = F.acos(near)
    bent = near < 1 - 2.220446049250313e-16
    sin = F.when(bent, F.sin(theta))
    wa = F.when(bent, F.sin((1 - alpha) * theta) / sin).otherwise(1 - alpha)
    wb = F.when(bent, F.sin(alpha * theta) / sin).otherwise(alpha) * F.when(dot < 0, -1.0).otherwise(1.0)
    return F.struct(*((wa * a[n] + wb * b[n]).alias(n) for n in ("qx", "qy", "qz", "qw")))


def blend(a: Column, b: Column, alpha: Column) -> Column:
    """The pose between two: translation on the line, rotation on the arc."""
    q = slerp(a, b, alpha)
    return pose(q.qx, q.qy, q.qz, q.qw, *((1 - alpha) * a[t] + alpha * b[t] for t in ("tx", "ty", "tz")))


def rotation_exp(x, y, z) -> Column:
    """The unit quaternion of a rotation vector, as a struct."""
    x, y, z = (F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (x, y, z))
    square = x * x + y * y + z * z
    theta = F.sqrt(square)
    small = square < EPSILON * EPSILON
    imag = F.when(small, 0.5 - square / 48 + square * square / 3840).otherwise(F.try_divide(F.sin(theta / 2), theta))
    real = F.when(small, 1 - square / 8 + square * square / 384).otherwise(F.cos(theta / 2))
    return F.struct((imag * x).alias("qx"), (imag * y).alias("qy"), (imag * z).alias("qz"), real.alias("qw"))


def rotation_log(q: Column) -> Column:
    """The rotation vector of a unit quaternion."""
    square = q.qx * q.qx + q.qy * q.qy + q.qz * q.qz
    n = F.sqrt(square)
    angle = F.when(q.qw < 0, F.atan2(-n, -q.qw)).otherwise(F.atan2(n, q.qw))
    factor = F.when(square < EPSILON * EPSILON, F.try_divide(F.lit(2.0), q.qw) - F.try_divide(2 * square, 3 * q.qw * q.qw * q.qw)).otherwise(F.try_divide(2 * angle, n))
    return vec(factor * q.qx, factor * q.qy, factor * q.qz)


def pose_exp(ux, uy, uz, wx, wy, wz) -> Column:
    """The pose of a tangent (translation part first, then rotation)."""
    ux, uy, uz, wx, wy, wz = (F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (ux, uy, uz, wx, wy, wz))
    q = rotation_exp(wx, wy, wz)
    square = wx * wx + wy * wy + wz * wz
    theta = F.sqrt(square)
    small = square < EPSILON
    a = F.when(small, 0.5 - square / 24).otherwise(F.try_divide(1 - F.cos(theta), square))
    b = F.when(small, 1 / F.lit(6.0) - square / 120).otherwise(F.try_divide(theta - F.sin(theta), square * theta))
    c1 = (wy * uz - wz * uy, wz * ux - wx * uz, wx * uy - wy * ux)
    c2 = (wy * c1[2] - wz * c1[1], wz * c1[0] - wx * c1[2], wx * c1[1] - wy * c1[0])
    t = [u + a * p + b * r for u, p, r in zip((ux, uy, uz), c1, c2, strict=True)]
    return pose(q.qx, q.qy, q.qz, q.qw, *t, normalize=False)


def pose_log(p: Column, w: Column | None = None) -> Column:
    """The tangent of a pose as a struct (ux, uy, uz, wx, wy, wz).

    w: the pose's `rotation_log`, where a column has it already; that keeps the expression small.
    """
    w = rotation_log(p) if w is None else w
    square = w.x * w.x + w.y * w.y + w.z * w.z
    theta = F.sqrt(square)
    half = theta / 2
    factor = F.when(square < EPSILON, 1 / F.lit(12.0) + square / 720).otherwise(F.try_divide(1 - F.try_divide(half * F.cos(half), F.sin(half)), square))
    c1 = (w.y * p.tz - w.z * p.ty, w.z * p.tx - w.x * p.tz, w.x * p.ty - w.y * p.tx)
    c2 = (w.y * c1[2] - w.z * c1[1], w.z * c1[0] - w.x * c1[2], w.x * c1[1] - w.y * c1[0])
    t = [u - 0.5 * a + factor * b for u, a, b in zip((p.tx, p.ty, p.tz), c1, c2, strict=True)]
    return F.struct(*(v.alias(n) for n, v in zip(("ux", "uy", "uz", "wx", "wy", "wz"), (*t, w.x, w.y, w.z), strict=True)))


def heading(q: Column) -> Column:
    """The camera's viewing direction (its z axis in the world), of length 1; zero where the quaternion is."""
    x = 2 * (q.qx * q.qz + q.qw * q.qy)
    y = 2 * (q.qy * q.qz - q.qw * q.qx)
    z = 1 - 2 * (q.qx * q.qx + q.qy * q.qy)
    n = F.sqrt(x * x + y * y + z * z)
    safe = F.when(n > 0, n).otherwise(1.0)
    return vec(x / safe, y / safe, z / safe)


def rotation_matrix(q: Column) -> list[list[Column]]:
    x, y, z, w = q.qx, q.qy, q.qz, q.qw
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def axis_angle(q: Column, axis: str) -> Column:
    """The rotation about one axis, from the matching 2 x 2 block."""
    r = rotation_matrix(q)
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    return F.atan2(r[j][i] - r[i][j], r[i][i] + r[j][j])


def rotation_about(axis: str, angle: Column) -> Column:
    return rotation_exp(*(angle if a == axis else F.lit(0.0) for a in "xyz"))


def translation_along(x=0.0, y=0.0, z=0.0) -> Column:
    return pose(0.0, 0.0, 0.0, 1.0, x, y, z, normalize=False)


def plane_of(p: Column) -> Column:
    """The plane z = 0 of a pose as (normal, offset): normal . x + d = 0."""
    n = vec(*(row[2] for row in rotation_matrix(p)))
    return F.struct(n.x.alias("nx"), n.y.alias("ny"), n.z.alias("nz"), (-(n.x * p.tx + n.y * p.ty + n.z * p.tz)).alias("d"))


def huber(square: Column, delta: float = 1.0) -> Column:
    """The robust value of a squared residual."""
    return F.when(square <= delta * delta, square).otherwise(2 * delta * F.sqrt(square) - delta * delta)


def spline_basis(u: Column) -> list[Column]:
    """The cumulative cubic basis at u in 0 .. 1."""
    return [(5 + 3 * u - 3 * u * u + u * u * u) / 6, (1 + 3 * u + 3 * u * u - 2 * u * u * u) / 6, u * u * u / 6]
