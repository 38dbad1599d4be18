"""Depth fusion into a truncated signed distance volume, and surface extraction.

Each frame row looks voxels up in its own image array, so observations meet voxels without a
join: the only exchange is the partial/final aggregate on the voxel, whose size is the
grid's, not the data's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators.scenes import ROOM, Scene, intrinsics
from stratafuse.operators.summaries import large_summary


@dataclass(frozen=True)
class Grid:
    low: tuple[float, ...] = ROOM.room[0]
    high: tuple[float, ...] = ROOM.room[1]
    voxel: float = 0.1
    truncation_voxels: float = 3.0

    @property
    def shape(self) -> tuple[int, int, int]:
        return G.grid_shape(self.low, self.high, self.voxel)

    @property
    def truncation(self) -> float:
        return self.voxel * self.truncation_voxels


GRID = Grid()


def voxel_center(grid: Grid, names: tuple[str, ...] = ("ix", "iy", "iz")) -> G.Vec:
    return tuple(F.lit(float(lo)) + (F.col(n) + 0.5) * F.lit(grid.voxel) for lo, n in zip(grid.low, names, strict=True))


def voxel_grid(spark, grid: Grid = GRID) -> DataFrame:
    """ix, iy, iz of all voxels, z fastest."""
    nx, ny, nz = grid.shape
    i = F.col("id")
    return spark.range(nx * ny * nz).select(F.expr(f"id div {ny * nz}").cast("int").alias("ix"), (F.expr(f"id div {nz}") % ny).cast("int").alias("iy"), (i % nz).cast("int").alias("iz"))


def voxel_samples(frames: DataFrame, grid: Grid = GRID, scene: Scene = ROOM) -> DataFrame:
    """frame_id, ix, iy, iz, s, w: the clipped signed distance and weight of every voxel that a frame sees.

    frames: frame_id, ox, oy, oz and depth (row-major array); if they have sigma and confidence
    (such arrays too) each pixel has its own weight, else the scene's; K (9 numbers) replaces the
    scene's camera, T_world_camera (16) replaces ox, oy, oz. Layers of voxels behind the camera
    are never generated.
    """
    if "T_world_camera" in frames.columns:
        return _posed_samples(frames, grid, scene)
    nx, ny, nz = grid.shape
    images = [c for c in ("depth", "sigma", "confidence") if c in frames.columns]
    k = intrinsics(frames, scene)
    lens = {n: k[i].alias(n) for n, i in (("fx", 0), ("cx", 2), ("fy", 4), ("cy", 5))} if "K" in frames.columns else {}
    keep = ["frame_id", *images, *lens]
    o = [G.float32(F.col(c)) for c in ("ox", "oy", "oz")]
    first = F.greatest(F.floor((o[2] - F.lit(float(grid.low[2]))) / F.lit(grid.voxel)) - 1, F.lit(0)).cast("int")
    layer = frames.where(first < nz).select("frame_id", *images, *lens.values(), *[x.alias(n) for x, n in zip(o, ("fox", "foy", "foz"), strict=True)], F.explode(F.sequence(first, F.lit(nz - 1))).alias("iz"))
    q_z = F.lit(float(grid.low[2])) + (F.col("iz") + 0.5) * F.lit(grid.voxel) - F.col("foz")
    layer = layer.withColumn("qz", q_z).where("qz > 0")
    sx, sy, cx, cy = (F.col(n) if lens else k[i] for n, i in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5)))

    def along(n: int, low: float, o: str, f, c, size: int):
        """Indices of one axis whose pixel lies in the image, with that pixel."""
        each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.rint(f * (F.lit(float(low)) + (i + 0.5) * F.lit(grid.voxel) - F.col(o)) / F.nullif(F.col("qz"), F.lit(0.0)) + c).alias("p")))
        return F.filter(each, lambda x: (x["p"] >= 0) & (x["p"] < size))

    seen = layer.withColumns({"xs": along(nx, grid.low[0], "fox", sx, cx, scene.width), "ys": along(ny, grid.low[1], "foy", sy, cy, scene.height)})
    seen = seen.select(*keep, "iz", "qz", "ys", F.explode("xs").alias("x")).select(*keep, "iz", "qz", "x", F.explode("ys").alias("y"))
    at = (F.col("y.p") * scene.width + F.col("x.p")).cast("int") + 1
    d = F.element_at("depth", at).cast("double")
    out = seen.select("frame_id", F.col("x.i").cast("int").alias("ix"), F.col("y.i").cast("int").alias("iy"), F.col("iz").cast("int").alias("iz"), (d - F.col("qz")).alias("sd"), _weight(images, at, grid, scene).alias("w"))
    band = F.lit(grid.truncation)
    return out.where(F.abs("sd") <= band).select("frame_id", "ix", "iy", "iz", G.clip(F.col("sd") / band, -1, 1).alias("s"), "w").where("w > 0")


def _weight(images: list[str], at, grid: Grid, scene: Scene):
    """Weight of the pixel at a (one-based) place of the images: confidence / (1 + sigma / voxel)."""
    confidence, sigma = (G.float32(F.element_at(c, at) if c in images else F.lit(x)) for c, x in (("confidence", scene.confidence), ("sigma", scene.sigma)))
    return confidence / (F.lit(1.0) + sigma / F.lit(grid.voxel))


def _posed_samples(frames: DataFrame, grid: Grid, scene: Scene) -> DataFrame:
    """:func:`voxel_samples` of frames with a pose: columns of voxels along z are projected and looked
    up as arrays, and only what a frame sees becomes rows."""
    nx, ny, nz = grid.shape
    images = [c for c in ("depth", "sigma", "confidence") if c in frames.columns]
    k = intrinsics(frames, scene)
    r, t = ([G.float32(x) for x in xs] for xs in (G.rotation_of("T_world_camera"), G.camera_center("T_world_camera")))
    back, shift = G.invert_transform(r, t)
    camera = {"fx": k[0], "cx": k[2], "fy": k[4], "cy": k[5], **{f"r{i}": x for i, x in enumerate(back)}, **{f"t{i}": x for i, x in enumerate(shift)}}
    rows = frames.select("frame_id", *images, *[x.alias(n) for n, x in camera.items()], F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("iy"))
    x, y = (F.lit(float(grid.low[a])) + (F.col(n) + 0.5) * F.lit(grid.voxel) for a, n in enumerate(("ix", "iy")))

    def voxel(i):
        z = F.lit(float(grid.low[2])) + (i + 0.5) * F.lit(grid.voxel)
        q = G.transform_points([F.col(f"r{j}") for j in range(9)], tuple(F.col(f"t{j}") for j in range(3)), (x, y, z))
        return F.struct(i.alias("iz"), *[a.alias(n) for a, n in zip(q, ("qx", "qy", "qz"), strict=True)])

    def pixel(c):
        u, v = (F.rint(F.col(f) * c[q] / c["qz"] + F.col(m)) for f, q, m in (("fx", "qx", "cx"), ("fy", "qy", "cy")))
        return F.struct(c["iz"].alias("iz"), c["qz"].alias("qz"), u.alias("u"), v.alias("v"))

    def sample(c):
        at = (c["v"] * scene.width + c["u"]).cast("int") + 1
        sd = F.element_at("depth", at).cast("double") - c["qz"]
        return F.struct(c["iz"].alias("iz"), sd.alias("sd"), _weight(images, at, grid, scene).alias("w"))

    band = F.lit(grid.truncation)
    cells = F.filter(F.transform(F.sequence(F.lit(0), F.lit(nz - 1)), voxel), lambda c: c["qz"] > 0)
    cells = F.filter(F.transform(cells, pixel), lambda c: (c["u"] >= 0) & (c["u"] < scene.width) & (c["v"] >= 0) & (c["v"] < scene.height))
    cells = F.filter(F.transform(cells, sample), lambda c: (F.abs(c["sd"]) <= band) & (c["w"] > 0))
    out = rows.select("frame_id", "ix", "iy", F.explode(cells).alias("c"))
    return out.select("frame_id", "ix", "iy", F.col("c.iz").alias("iz"), G.clip(F.col("c.sd") / band, -1, 1).alias("s"), F.col("c.w").alias("w"))


def integrate(samples: DataFrame) -> DataFrame:
    """ix, iy, iz, tsdf, weight: weighted means over all samples of a voxel. Sums are of integers
    (1e-9 units), so they don't depend on the order in which executors deliver them; results
    have single precision, on which the surface threshold depends. Voxels of less than 1e-3 in
    all, too little for such units, have sums of doubles."""
    unit = F.lit(1e9)
    s, w = F.col("s") * F.col("w"), F.col("w")
    return fused(samples.groupBy("ix", "iy", "iz").agg(F.sum(F.round(s * unit).cast("long")).alias("_sw"), F.sum(F.round(w * unit).cast("long")).alias("_w"), F.sum(s).alias("_fsw"), F.sum(w).alias("_fw")))


def fused(sums: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The volume (with columns to keep) of each voxel's sums of s * w and w, in units (_sw, _w) and as doubles (_fsw, _fw)."""
    much = F.col("_w") >= 1_000_000
    tsdf = F.when(much, F.col("_sw").cast("double") / F.nullif(F.col("_w").cast("double"), F.lit(0.0))).otherwise(F.col("_fsw") / F.col("_fw"))
    return sums.select(*(keep or []), "ix", "iy", "iz", G.float32(tsdf).alias("tsdf"), G.float32(F.when(much, F.col("_w").cast("double") / F.lit(1e9)).otherwise(F.col("_fw"))).alias("weight"))


def dense(volume: DataFrame, spark, grid: Grid = GRID) -> DataFrame:
    """All voxels; those never seen have tsdf 1 and weight 0."""
    return voxel_grid(spark, grid).join(volume, ["ix", "iy", "iz"], "left").fillna({"tsdf": 1.0, "weight": 0.0})


def extract_surface(volume: DataFrame, n_frames: int, grid: Grid = GRID, band: float = 1.0 / 3.0) -> DataFrame:
    """ix, iy, iz, x, y, z, tsdf, confidence, uncertainty_m of the voxels near the zero level."""
    x, y, z = voxel_center(grid)
    near = volume.where((F.col("weight") > 0) & (F.abs("tsdf") <= F.lit(band)))
    return near.select(
        "ix", "iy", "iz", x.alias("x"), y.alias("y"), z.alias("z"), "tsdf",
        G.clip(F.col("weight") / F.lit(float(max(n_frames, 1))), 0, 1).alias("confidence"),
        (F.lit(grid.voxel) / F.sqrt(F.greatest(F.col("weight"), F.lit(1.0))) + F.abs("tsdf") * F.lit(grid.truncation)).alias("uncertainty_m"),
    )


def surface_against_scene(surface: DataFrame, grid: Grid = GRID, scene: Scene = ROOM) -> DataFrame:
    """One row of metrics: distance of surface points to the nearer of room and box, and how many
    are nearer to each (room on ties). surface is evaluated more than once: it should be stored."""
    p = (F.col("x"), F.col("y"), F.col("z"))
    rows = surface.select(*"xyz", *[G.distance_to_box_surface(p, *b).alias(n) for n, b in (("room", scene.room), ("box", scene.box))], G.inside_box(p, *scene.room, tolerance=grid.voxel).alias("inside"))
    rows = rows.withColumn("d", F.least("room", "box"))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    more = {
        "n_room": F.count_if(F.col("room") <= F.col("box")), "n_box": F.count_if(F.col("box") < F.col("room")),
        "inside_ratio": share(F.col("inside")), "within_voxel_ratio": share(F.col("d") <= grid.voxel + 1e-6),
        **{f"{n}_{c}": f(c) for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))},
    }
    out = large_summary(rows, "d", points=(0.95,), more=more)
    return out.select(F.col("n").alias("n_points"), "n_room", "n_box", "inside_ratio", "within_voxel_ratio", F.col("mean").alias("mean_distance_m"), F.col("p95").alias("p95_distance_m"), F.col("max").alias("max_distance_m"), *[f"{n}_{c}" for c in "xyz" for n in ("min", "max")])


def observation_bounds(points: DataFrame, voxel: float, truncation: float) -> DataFrame:
    """Grid bounds of valid points (x, y, z): padded by truncation and voxel, snapped to the grid,
    at least two voxels wide."""
    return padded_bounds(points.agg(*point_ranges()), voxel, truncation)


def point_ranges() -> list[Column]:
    """lo_x, hi_x, ...: the aggregates that :func:`padded_bounds` needs."""
    return [f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]


def padded_bounds(out: DataFrame, voxel: float, truncation: float, *keep: str) -> DataFrame:
    """The grid bounds of each row of ranges, with columns to keep."""
    pad = truncation + voxel
    lo = {c: F.floor((F.col(f"lo_{c}") - pad) / voxel) * F.lit(voxel) for c in "xyz"}
    hi = {c: F.ceil((F.col(f"hi_{c}") + pad) / voxel) * F.lit(voxel) for c in "xyz"}
    return out.select(*keep, *[lo[c].alias(f"min_{c}") for c in "xyz"], *[F.greatest(hi[c], lo[c] + 2 * voxel).alias(f"max_{c}") for c in "xyz"])


def compare_volumes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Voxels observed in both volumes: count and mean absolute difference (null if none)."""
    both = left.where("weight > 0").alias("l").join(right.where("weight > 0").alias("r"), ["ix", "iy", "iz"])
    return both.agg(F.count("*").alias("n_common"), F.avg(F.abs(F.col("l.tsdf") - F.col("r.tsdf"))).alias("mean_abs_delta"))


def compare_halves(samples: DataFrame, right: Column) -> DataFrame:
    """:func:`compare_volumes` of the volumes that samples give where ``right`` is false and where it
    is true: both are fused by one aggregate, whose size is the grid's."""
    unit, s, w = F.lit(1e9), F.col("s") * F.col("w"), F.col("w")
    sums = [F.sum(F.when(side, F.round(x * unit).cast("long"))).alias(f"_{n}{x_name}") for n, side in (("l", ~right), ("r", right)) for x_name, x in (("s", s), ("w", w))]
    both = samples.groupBy("ix", "iy", "iz").agg(*sums).where("_lw > 0 and _rw > 0")
    tsdf = [G.float32(F.col(f"_{n}s").cast("double") / F.col(f"_{n}w").cast("double")) for n in "lr"]
    return both.agg(F.count("*").alias("n_common"), F.avg(F.abs(tsdf[0] - tsdf[1])).alias("mean_abs_delta"))


def triangle_markers(surface: DataFrame, voxel: float) -> DataFrame:
    """sample_id, corner, vertex_id, x, y, z: a small triangle around each sample (needs sample_id)."""
    r = 0.16 * voxel
    offsets = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for k, (a, b) in enumerate(((-r, -r), (r, -r), (-r, r)))])
    rows = surface.select("sample_id", "x", "y", "z", F.explode(offsets).alias("o"))
    return rows.select("sample_id", F.col("o.corner").alias("corner"), (F.col("sample_id") * 3 + F.col("o.corner")).alias("vertex_id"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "z")
