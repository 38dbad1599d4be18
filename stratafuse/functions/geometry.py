"""Rigid transforms, pinhole cameras and boxes as Column expressions.

A vector is a tuple of three Columns, a rotation nine in row-major order, a pose a rotation
and a translation. Everything stays inside generated code; divisions are guarded because
filters need not run first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(name: str) -> Vec:
    """The components of an array column of three."""
    return tuple(F.col(name)[i] for i in range(3))


def mat(name: str, n: int = 9) -> tuple[Column, ...]:
    return tuple(F.col(name)[i] for i in range(n))


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def rotate(r: Sequence[Column], p: Vec) -> Vec:
    return tuple(dot(r[3 * i : 3 * i + 3], p) for i in range(3))


def transposed(r: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(r[3 * j + i] for i in range(3) for j in range(3))


def transform_points(r: Sequence[Column], t: Vec, p: Vec) -> Vec:
    """R p + t."""
    return tuple(x + y for x, y in zip(rotate(r, p), t, strict=True))


def invert_transform(r: Sequence[Column], t: Vec) -> tuple[tuple[Column, ...], Vec]:
    back = transposed(r)
    return back, tuple(-x for x in rotate(back, t))


def compose_transforms(r1: Sequence[Column], t1: Vec, r2: Sequence[Column], t2: Vec) -> tuple[tuple[Column, ...], Vec]:
    cols = [rotate(r1, (r2[j], r2[3 + j], r2[6 + j])) for j in range(3)]
    return tuple(cols[j][i] for i in range(3) for j in range(3)), transform_points(r1, t1, t2)


def make_transform(r: Sequence[Column], t: Vec) -> Column:
    """4x4 row-major array."""
    z, one = F.lit(0.0), F.lit(1.0)
    return F.array(*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], z, z, z, one)


def camera_center(transform: str) -> Vec:
    """Translation column of a 4x4 world-from-camera array."""
    return tuple(F.col(transform)[i] for i in (3, 7, 11))


def rotation_of(transform: str) -> tuple[Column, ...]:
    return tuple(F.col(transform)[4 * i + j] for i in range(3) for j in range(3))


def rotation_from_quaternion(q: Sequence[Column]) -> tuple[Column, ...]:
    """Rotation of a quaternion (x, y, z, w), normalised first."""
    n = norm(q)
    x, y, z, w = (safe_divide(c, n) for c in q)
    two = F.lit(2.0)
    return (
        1 - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w),
        two * (x * y + z * w), 1 - two * (x * x + z * z), two * (y * z - x * w),
        two * (x * z - y * w), two * (y * z + x * w), 1 - two * (x * x + y * y),
    )


def quaternion_from_rotation(r: Sequence[Column]) -> tuple[Column, ...]:
    """(x, y, z, w) with w >= 0, from the largest of the four squared components."""
    d = [r[0], r[4], r[8]]
    squared = [1 + d[0] - d[1] - d[2], 1 - d[0] + d[1] - d[2], 1 - d[0] - d[1] + d[2], 1 + d[0] + d[1] + d[2]]
    s = [2 * F.sqrt(F.greatest(x, F.lit(0.0))) for x in squared]
    mixed = {(0, 1): r[1] + r[3], (0, 2): r[2] + r[6], (1, 2): r[5] + r[7], (0, 3): r[7] - r[5], (1, 3): r[2] - r[6], (2, 3): r[3] - r[1]}

    def by(k: int) -> list[Column]:
        return [s[k] / 4 if i == k else safe_divide(mixed[min(i, k), max(i, k)], s[k]) for i in range(4)]

    options = [by(k) for k in range(4)]
    trace = d[0] + d[1] + d[2]
    out = []
    for i in range(4):
        pick = F.when(trace > 0, options[3][i]).when((d[0] > d[1]) & (d[0] > d[2]), options[0][i]).when(d[1] > d[2], options[1][i]).otherwise(options[2][i])
        out.append(pick)
    sign = F.when(out[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(x * sign for x in out)


def project_points(p: Vec, k: Sequence[Column]) -> tuple[Column, Column]:
    """Pixel (u, v) of a camera point with a full 3x3 K; null behind the camera."""
    z = F.when(p[2] > 0, p[2])
    x = rotate(k, p)
    return x[0] / z, x[1] / z


def unproject_pixels(u: Column, v: Column, depth: Column, k: Sequence[Column]) -> Vec:
    """Camera point K^-1 (u, v, 1) * depth, by the closed inverse; null for depth <= 0."""
    d = F.when(depth > 0, depth)
    rows = [tuple(k[3 * i : 3 * i + 3]) for i in range(3)]
    c = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    det = dot(rows[0], c[0])
    one = F.lit(1.0)
    return tuple(safe_divide(dot((c[0][i], c[1][i], c[2][i]), (u, v, one)), det) * d for i in range(3))


def scale_intrinsics(k: Sequence[Column], sx: Column, sy: Column) -> tuple[Column, ...]:
    return (*(x * sx for x in k[0:3]), *(x * sy for x in k[3:6]), *k[6:9])


def pixel_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Vec:
    return (u - cx) / fx, (v - cy) / fy, F.lit(1.0)


def intersect_box(origin: Vec, direction: Vec, low: Sequence[float], high: Sequence[float]) -> tuple[Column, Column]:
    """(enter, exit) of a ray and an axis-aligned box; (inf, -inf) for a miss, also of a ray
    that runs parallel to a slab and outside it."""
    inf = F.lit(float("inf"))
    near, far, missed = [], [], F.lit(False)
    for o, d, lo, hi in zip(origin, direction, low, high, strict=True):
        flat = F.abs(d) < 1e-12
        a, b = safe_divide(F.lit(float(lo)) - o, d), safe_divide(F.lit(float(hi)) - o, d)
        near.append(F.when(flat, -inf).otherwise(F.least(a, b)))
        far.append(F.when(flat, inf).otherwise(F.greatest(a, b)))
        missed = missed | (flat & ((o < lo) | (o > hi)))
    enter, leave = F.greatest(*near), F.least(*far)
    hit = ~missed & (enter <= leave)
    return F.when(hit, enter).otherwise(inf), F.when(hit, leave).otherwise(-inf)


def distance_to_box_surface(p: Vec, low: Sequence[float], high: Sequence[float]) -> Column:
    """Unsigned distance to the surface of a box, from inside or outside."""
    zero = F.lit(0.0)
    out = [F.greatest(F.lit(float(lo)) - x, zero, x - F.lit(float(hi))) for x, lo, hi in zip(p, low, high, strict=True)]
    inside = [F.least(x - F.lit(float(lo)), F.lit(float(hi)) - x) for x, lo, hi in zip(p, low, high, strict=True)]
    gap = norm(out)
    return F.when(gap > 0, gap).otherwise(F.least(*inside))


def inside_box(p: Vec, low: Sequence[float], high: Sequence[float], tolerance: float = 0.0) -> Column:
    return reduce(lambda a, b: a & b, [x.between(float(lo) - tolerance, float(hi) + tolerance) for x, lo, hi in zip(p, low, high, strict=True)])


def grid_shape(low: Sequence[float], high: Sequence[float], voxel: float) -> tuple[int, int, int]:
    import math

    return tuple(math.ceil((h - lo) / voxel - 1e-9) for lo, h in zip(low, high, strict=True))


def float32(x: Column) -> Column:
    """The value as stored in single precision."""
    return x.cast("float").cast("double")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
