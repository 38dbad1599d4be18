"""Constraint checks: named boolean Columns, run as one pass that yields violations.

A check that is null counts as violated. NaN is tested explicitly, because it sorts above all numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafuse.functions import geometry as G

# Names that stored records use.
DISTORTION_MODELS = ("none", "brown_conrady", "fisheye")
TRACKING_STATES = ("OK", "LOW_CONFIDENCE", "RELOCALIZING", "LOST", "NEW_SUBMAP")
SCALE_SOURCES = ("rgb_prior", "calibrated_rgb", "known_anchor", "external_pose")
SURFACE_SOURCES = (0, 1, 2, 3, 4)
TRUTH_FLAGS = ("low_fidelity_reference_only", "observed_surface_samples", "not_completed_surface", "not_accuracy_report")
ARRAY_KEYS = ("depth_m", "depth_sigma_m", "normal_camera", "point_world", "confidence", "static_mask")


class ConstraintError(ValueError):
    """Raised in strict mode, as "<field>: <message>"."""


def nonempty_str(c: str) -> Column:
    return F.length(c) > 0


def non_negative_int(c: str) -> Column:
    return F.col(c) >= 0


def positive_int(c: str) -> Column:
    return F.col(c) > 0


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_scalar(c: str) -> Column:
    return finite(F.col(c).cast("double"))


def non_negative_scalar(c: str) -> Column:
    return finite_scalar(c) & (F.col(c) >= 0)


def positive_scalar(c: str) -> Column:
    return finite_scalar(c) & (F.col(c) > 0)


def confidence(c: str) -> Column:
    return finite_scalar(c) & F.col(c).between(0, 1)


def choice(c: str, allowed: Sequence[str]) -> Column:
    return F.col(c).isin(*allowed)


def int_sequence(c: str, non_empty: bool = False) -> Column:
    ok = F.forall(c, lambda x: x >= 0)
    return ok & (F.size(c) > 0) if non_empty else ok


def finite_array(c: str) -> Column:
    return F.forall(c, lambda x: finite(x.cast("double")))


def vector(c: str, n: int) -> Column:
    return (F.size(c) == n) & finite_array(c)


def matrix_rows(c: str, width: int) -> Column:
    """An array of rows, each of ``width`` finite numbers."""
    return F.forall(c, lambda r: (F.size(r) == width) & F.forall(r, lambda x: finite(x.cast("double"))))


def confidence_array(c: str) -> Column:
    return F.forall(c, lambda x: finite(x.cast("double")) & x.between(0, 1))


def rotation(r: Sequence[Column], tolerance: float = 1e-4) -> Column:
    """R^T R = I and determinant 1 (within 1e-3)."""
    ok = F.lit(True)
    for i in range(3):
        for j in range(i, 3):
            ok = ok & (F.abs(G.dot((r[i], r[3 + i], r[6 + i]), (r[j], r[3 + j], r[6 + j])) - (1.0 if i == j else 0.0)) <= tolerance)
    det = G.dot(tuple(r[0:3]), G.cross(tuple(r[3:6]), tuple(r[6:9])))
    return ok & (F.abs(det - 1.0) <= 1e-3)


def transform(c: str) -> Column:
    """A rigid 4x4 row-major array."""
    bottom = (F.col(c)[12] == 0) & (F.col(c)[13] == 0) & (F.col(c)[14] == 0) & (F.col(c)[15] == 1)
    return F.when(F.size(c) == 16, finite_array(c) & bottom & rotation(G.rotation_of(c)))


def intrinsics(c: str) -> Column:
    """Nine finite numbers with positive focal lengths; bottom row and skew are free."""
    return F.when(F.size(c) == 9, finite_array(c) & (F.col(c)[0] > 0) & (F.col(c)[4] > 0))


def unit_quaternion(c: str, tolerance: float = 1e-3) -> Column:
    return F.when(F.size(c) == 4, F.abs(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)) - 1.0) <= tolerance)


def covariance_symmetric(c: str, n: int = 6, tolerance: float = 1e-6) -> Column:
    ok = F.lit(True)
    for i in range(n):
        for j in range(i):
            ok = ok & (F.abs(F.col(c)[i * n + j] - F.col(c)[j * n + i]) <= tolerance)
    return F.when(F.size(c) == n * n, finite_array(c) & ok)


@F.pandas_udf(T.BooleanType())
def covariance_psd(c: pd.Series) -> pd.Series:
    """Smallest eigenvalue of a 6x6 covariance at least -1e-6; null and malformed arrays fail."""
    good = c.map(lambda x: x is not None and len(x) == 36 and bool(np.isfinite(np.asarray(x, float)).all())).astype(bool)
    out = pd.Series(False, index=c.index)
    if good.any():
        m = np.stack([np.asarray(x, float) for x in c[good]]).reshape(-1, 6, 6)
        out[good] = np.linalg.eigvalsh((m + m.transpose(0, 2, 1)) / 2).min(1) >= -1e-6
    return out


def same_keys(found: Column, required: Sequence[str]) -> Column:
    """An array of names equals the required set."""
    want = F.array(*map(F.lit, required))
    return (F.size(F.array_except(want, found)) == 0) & (F.size(F.array_except(found, want)) == 0)


def truth_boundary(shape_only: str, others: Sequence[str]) -> Column:
    """All flags are set; shape_only excludes the others."""
    none = F.lit(True)
    known = F.col(shape_only).isNotNull()
    for o in others:
        none, known = none & ~F.col(o), known & F.col(o).isNotNull()
    return known & (~F.col(shape_only) | none)


def mesh_truth_flags(flags: str) -> Column:
    """All required flags are there and completed surfaces are not claimed."""
    return (F.size(F.array_except(F.array(*map(F.lit, TRUTH_FLAGS)), F.col(flags))) == 0) & ~F.array_contains(flags, "completed_surface")


def has_json_key(text: str, key: str) -> Column:
    """Whether a JSON object has a key at all; a null value counts as present."""
    return F.array_contains(F.json_object_keys(text), key)


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, check) for every failed check, in one scan."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    # a column of its own: inside the explode all checks would be interpreted, not compiled
    return df.select(F.col(key), failed.alias("_failed")).select(F.col(key), F.explode(F.array_compact("_failed")).alias("check"))


def require(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """df itself, or ConstraintError for the first violation."""
    bad = violations(df, key, checks).take(1)
    if bad:
        raise ConstraintError(f"{bad[0][1]}: violated by {key} {bad[0][0]}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def face_violations(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(face_id, vertex_id) of faces that name no existing vertex."""
    ends = faces.select("face_id", F.explode(F.array("a", "b", "c")).alias("vertex_id"))
    return ends.join(vertices.select("vertex_id"), "vertex_id", "left_anti")
