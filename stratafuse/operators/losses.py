"""Error forms of depth maps, point maps and matches: scale-aware logs, aligned inverse depth, points in the world and against their
rays, epipolar distances. Groups are aggregates of a few sums; what is aligned first gets its numbers from one row a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators.trajectories import ALIGNMENT, alignments


def charbonnier(x: Column, epsilon: float = 1e-3) -> Column:
    """sqrt(x^2 + epsilon^2): an absolute value without a corner."""
    return F.sqrt(x * x + F.lit(epsilon * epsilon))


def silog(px: DataFrame, predicted: str, target: str, by: Sequence[str] = (), share: float = 0.85) -> DataFrame:
    """(by, n, silog): mean(e^2) - share * mean(e)^2 of e = log predicted - log target, over pixels where both are positive and finite."""
    p, t = F.col(predicted).cast("double"), F.col(target).cast("double")
    e = F.log(p) - F.log(t)
    fine = px.where((p > 0) & (t > 0) & (p < float("inf")) & (t < float("inf")))
    return fine.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(e * e) - F.lit(share) * F.avg(e) * F.avg(e)).alias("silog"))


def aligned_inverse_depth(px: DataFrame, predicted: str, target: str, by: str, epsilon: float = 1e-3) -> DataFrame:
    """(by, n, a, b, loss): the scale and shift of least squares from predicted to target inverse depth of a group, and the mean Charbonnier
    distance that they leave. A group of one inverse depth has scale 0."""
    p, t = F.col(predicted).cast("double"), F.col(target).cast("double")
    fine = px.where((p > 0) & (t > 0) & (p < float("inf")) & (t < float("inf"))).select(F.col(by), (F.lit(1.0) / F.nullif(p, F.lit(0.0))).alias("_p"), (F.lit(1.0) / F.nullif(t, F.lit(0.0))).alias("_t"))
    moments = fine.groupBy(F.col(by).alias("_g")).agg(F.covar_pop("_p", "_t").alias("c"), F.var_pop("_p").alias("v"), F.avg("_p").alias("mp"), F.avg("_t").alias("mt"))
    a = F.when(F.col("v") > 0, F.col("c") / F.nullif(F.col("v"), F.lit(0.0))).otherwise(0.0)
    line = moments.select("_g", a.alias("a"), (F.col("mt") - a * F.col("mp")).alias("b"))
    rows = fine.join(line, F.col(by).eqNullSafe(F.col("_g")))
    return rows.groupBy(by, "a", "b").agg(F.count("*").alias("n"), F.avg(charbonnier(F.col("a") * F.col("_p") + F.col("b") - F.col("_t"), epsilon)).alias("loss")).select(by, "n", "a", "b", "loss")


def pointmap_errors(points: DataFrame, by: str, align: bool = False, epsilon: float = 1e-3) -> DataFrame:
    """(by, n, loss) of predicted points (ex, ey, ez) and true ones (px, py, pz): the mean Charbonnier distance, with ``align`` after the Sim(3) that
    fits a group best. Points with a null or infinite coordinate don't count."""
    fine = points.where(" and ".join(f"abs({s}{c}) < double('inf')" for s in "ep" for c in "xyz"))
    e = [F.col(f"e{c}").cast("double") for c in "xyz"]
    if align:
        found = alignments(fine.withColumnRenamed(by, "track")).withColumnRenamed("track", "_track").select("_track", *ALIGNMENT)
        fine = fine.join(found, F.col(by).eqNullSafe(F.col("_track")))
        e = [F.col("scale") * x + F.col(f"t{c}") for x, c in zip(G.rotate([F.col(f"r{i}") for i in range(9)], tuple(e)), "xyz", strict=True)]
    d = G.norm([a - F.col(f"p{c}").cast("double") for a, c in zip(e, "xyz", strict=True)])
    return fine.groupBy(by).agg(F.count("*").alias("n"), F.avg(charbonnier(d, epsilon)).alias("loss"))


def pointmap_consistency(px: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, depth_error_m, ray_error) of pixels with a world point (x, y, z), u, v, depth_m, K and T_world_camera: how far the point's depth in its
    camera is from the pixel's depth, and the tangent of the angle between the point and the pixel's ray; points behind the camera don't count."""
    r, t = G.invert_transform(list(G.rotation_of("T_world_camera")), G.camera_center("T_world_camera"))
    q = px.withColumns({f"_q{c}": x for c, x in zip("xyz", G.transform_points(r, t, (F.col("x"), F.col("y"), F.col("z"))), strict=True)}).where("_qz > 0 and depth_m > 0")
    k = G.mat("K")
    ray = G.unproject_pixels(F.col("u").cast("double"), F.col("v").cast("double"), F.lit(1.0), k)
    p = tuple(F.col(f"_q{c}") for c in "xyz")
    across, along = G.norm(G.cross(p, ray)), G.dot(p, ray)
    return q.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("_qz") - F.col("depth_m").cast("double"))).alias("depth_error_m"), F.avg(G.safe_divide(across, along)).alias("ray_error"))


def fundamental(r: Sequence[Column], t: G.Vec, ki: Sequence[Column], kj: Sequence[Column]) -> tuple[Column, ...]:
    """F (9, row-major) with x_j' F x_i = 0 for matches of camera i and camera j, where p_j = R p_i + t; pinhole K without skew."""
    cross_t = ((F.lit(0.0), -t[2], t[1]), (t[2], F.lit(0.0), -t[0]), (-t[1], t[0], F.lit(0.0)))
    e = [[cross_t[i][0] * r[j] + cross_t[i][1] * r[3 + j] + cross_t[i][2] * r[6 + j] for j in range(3)] for i in range(3)]

    def inverse(k: Sequence[Column]) -> list[list[Column]]:
        zero, one = F.lit(0.0), F.lit(1.0)
        return [[one / k[0], zero, -k[2] / k[0]], [zero, one / k[4], -k[5] / k[4]], [zero, zero, one]]

    a, b = inverse(kj), inverse(ki)
    half = [[a[0][i] * e[0][j] + a[1][i] * e[1][j] + a[2][i] * e[2][j] for j in range(3)] for i in range(3)]
    return tuple(half[i][0] * b[0][j] + half[i][1] * b[1][j] + half[i][2] * b[2][j] for i in range(3) for j in range(3))


def epipolar_errors(f: Sequence[Column], ui: Column, vi: Column, uj: Column, vj: Column) -> tuple[Column, Column]:
    """(|x_j' F x_i|, squared Sampson distance in pixels) of a match; the distance is null where no line is defined."""
    line = tuple(f[3 * i] * ui + f[3 * i + 1] * vi + f[3 * i + 2] for i in range(3))
    back = tuple(f[i] * uj + f[3 + i] * vj + f[6 + i] for i in range(2))
    value = uj * line[0] + vj * line[1] + line[2]
    return F.abs(value), G.safe_divide(value * value, line[0] * line[0] + line[1] * line[1] + back[0] * back[0] + back[1] * back[1])
