"""Analytic room scenes: one row a frame, rendered by array operations.

A frame row carries its camera, pose and image arrays; pixel tables are explosions of it, so
a frame never has to be shuffled to be rendered or fused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, StructField, StructType

from stratafuse.functions import geometry as G
from stratafuse.operators.rooms import slab


@dataclass(frozen=True)
class Scene:
    """A room with one box in it, seen by equal cameras of identity rotation."""

    width: int = 32
    height: int = 24
    fx: float = 30.0
    fy: float = 30.0
    cx: float = 15.5
    cy: float = 11.5
    room: tuple[tuple[float, ...], tuple[float, ...]] = ((-1.5, -1.0, 0.0), (1.5, 1.0, 4.0))
    box: tuple[tuple[float, ...], tuple[float, ...]] = ((-0.35, -0.25, 1.85), (0.35, 0.45, 2.55))
    sigma: float = 0.002
    confidence: float = 1.0


ROOM = Scene()
#: Camera centres of the three-frame reference scene.
CENTERS = ((-0.25, 0.0, 0.4), (0.25, 0.0, 0.4), (0.0, -0.1, 0.55))


def fixed_frames(spark: SparkSession, centers=CENTERS) -> DataFrame:
    """frame_id, timestamp_ns, ox, oy, oz of the given camera centres."""
    return spark.createDataFrame([(i, i * 33_333_333, *map(float, c)) for i, c in enumerate(centers)], "frame_id long, timestamp_ns long, ox double, oy double, oz double")


def supplier_frames(supplier: DataFrame) -> DataFrame:
    """A frame for each supplier: a deterministic walk of camera centres that grows with the data."""
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("frame_id"),
        (k * 33_333_333).alias("timestamp_ns"),
        (F.lit(-0.4) + F.lit(0.05) * (k % 17)).alias("ox"),
        (F.lit(-0.3) + F.lit(0.05) * (k % 13)).alias("oy"),
        (F.lit(0.25) + F.lit(0.03) * (k % 11)).alias("oz"),
    )


def pixel_grid(frames: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """frames x (v, u), row-major; integer coordinates are pixel centres."""
    p = F.explode(F.sequence(F.lit(0), F.lit(scene.width * scene.height - 1))).alias("_p")
    grid = frames.select("*", p)
    return grid.withColumns({"v": F.expr(f"_p div {scene.width}").cast("int"), "u": (F.col("_p") % scene.width).cast("int")}).drop("_p")


def hit(u: Column, v: Column, scene: Scene = ROOM) -> tuple[Column, Column]:
    """(depth in single precision, whether the box is hit) of a pixel of the frame's row."""
    d = G.pixel_ray(u.cast("double"), v.cast("double"), F.lit(scene.fx), F.lit(scene.fy), F.lit(scene.cx), F.lit(scene.cy))
    o = (F.col("ox"), F.col("oy"), F.col("oz"))
    _, leave = G.intersect_box(o, d, *scene.room)
    enter, _ = G.intersect_box(o, d, *scene.box)
    box = (enter < F.lit(float("inf"))) & (enter > 1e-9) & (enter < leave)
    return F.when(box, enter).otherwise(leave).cast("float"), box


#: Frames that are rendered at once.
RENDERED = 128


def _images(frames: DataFrame, scene: Scene, *names: str) -> DataFrame:
    """Frame rows with an image for each name (depth, object_mask), row-major arrays. The arithmetic is that of :func:`hit`, over the arrays of an
    Arrow batch; frames without a centre see nothing (NaN)."""
    v, u = np.divmod(np.arange(scene.width * scene.height), scene.width)
    ray = [((u - scene.cx) / scene.fx)[None], ((v - scene.cy) / scene.fy)[None], np.ones((1, 1))]
    kinds = {"depth": FloatType(), "object_mask": BooleanType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), RENDERED):
                part = b.slice(at, RENDERED)
                o = [np.asarray(part.column(c).cast(pa.float64())).astype(float)[:, None] for c in ("ox", "oy", "oz")]
                _, leave = slab(o, ray, *map(list, scene.room))
                enter, _ = slab(o, ray, *map(list, scene.box))
                box, known = (enter < np.inf) & (enter > 1e-9) & (enter < leave), np.isfinite(o[0] + o[1] + o[2])
                out = {"depth": np.where(known, np.where(box, enter, leave), np.nan).astype(np.float32), "object_mask": box & known}
                ends = pa.array(np.arange(len(part) + 1) * len(v), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.ListArray.from_arrays(ends, pa.array(out[n].ravel())) for n in names]], [*part.schema.names, *names])

    frames = frames.drop(*names)
    return frames.mapInArrow(run, StructType([*frames.schema, *[StructField(n, ArrayType(kinds[n])) for n in names]]))


def render_pixels(frames: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """Pixel long form: frame_id, v, u, depth_m, depth_sigma_m, confidence, object_mask, object_id."""
    rows, own = _images(frames, scene, "depth", "object_mask"), [c for c in frames.columns if c not in ("depth", "object_mask")]
    out = rows.select(*own, F.posexplode(F.arrays_zip("depth", "object_mask")).alias("_p", "_px"))
    out = out.select(*own, F.expr(f"_p div {scene.width}").cast("int").alias("v"), (F.col("_p") % scene.width).cast("int").alias("u"), F.col("_px.depth").alias("depth_m"), "_px.object_mask")
    return out.withColumns({"depth_sigma_m": F.lit(scene.sigma).cast("float"), "confidence": F.lit(scene.confidence).cast("float"), "object_id": F.col("object_mask").cast("int")})


def render_frames(frames: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """Frame rows with their depth image as one array (row-major): no shuffle."""
    return _images(frames, scene, "depth")


def observations_from_pixels(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """Frame rows with depth, sigma and confidence images (row-major arrays) from a pixel table
    (frame_id, v, u, depth_m, depth_sigma_m, confidence): one groupBy on the frame."""
    rows = pixels.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("v", "u", "depth_m", "depth_sigma_m", "confidence"))).alias("_px"))
    images = rows.select("frame_id", *[F.col(f"_px.{c}").alias(n) for c, n in (("depth_m", "depth"), ("depth_sigma_m", "sigma"), ("confidence", "confidence"))])
    return frames.drop("depth", "sigma", "confidence").join(images, "frame_id")  # a pose's confidence is not a pixel's


def intrinsics(frames: DataFrame, scene: Scene = ROOM) -> tuple[Column, ...]:
    """The row-major 3x3 matrix of a frame's column K (single precision), the scene's camera without one."""
    if "K" in frames.columns:
        return tuple(G.float32(x) for x in G.mat("K"))
    return tuple(F.lit(float(x)) for x in (scene.fx, 0, scene.cx, 0, scene.fy, scene.cy, 0, 0, 1))


def observed_points(pixels: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """World points (x, y, z, single precision) of the pixels of positive depth and confidence, by
    their frames' K and T_world_camera (row-major; without one: ox, oy, oz and no rotation)."""
    p = G.unproject_pixels(F.col("u"), F.col("v"), F.col("depth_m").cast("double"), intrinsics(pixels, scene))
    if "T_world_camera" in pixels.columns:
        r, t = ([G.float32(x) for x in xs] for xs in (G.rotation_of("T_world_camera"), G.camera_center("T_world_camera")))
        p = G.transform_points(r, t, p)
    else:
        p = tuple(a + G.float32(F.col(o)) for a, o in zip(p, ("ox", "oy", "oz"), strict=True))
    points = pixels.where("depth_m > 0 and confidence > 0").select(*[G.float32(a).alias(n) for a, n in zip(p, "xyz", strict=True)])
    return points.where(" and ".join(f"abs({n}) < double('inf')" for n in "xyz"))


def world_points(pixels: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """Pixels with their world point (x, y, z): unprojection plus camera centre."""
    d = F.col("depth_m").cast("double")
    p = ((F.col("u") - F.lit(scene.cx)) * d / F.lit(scene.fx), (F.col("v") - F.lit(scene.cy)) * d / F.lit(scene.fy), d)
    return pixels.withColumns({n: a + G.float32(F.col(o)) for n, a, o in zip("xyz", p, ("ox", "oy", "oz"), strict=True)})


def with_cameras(frames: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """Frames (frame_id, timestamp_ns, ox, oy, oz) with all fields of their camera and of the pose of a camera that isn't turned."""
    center = F.array(*[G.float32(F.col(c)) for c in ("ox", "oy", "oz")])
    pose = G.make_transform([F.lit(float(i % 4 == 0)) for i in range(9)], tuple(center[i] for i in range(3)))
    square = lambda n, x: F.array(*[F.lit(x if i % (n + 1) == 0 else 0.0) for i in range(n * n)])
    own = {
        "T_world_camera": pose, "q_world_camera_xyzw": F.array(*[F.lit(float(i == 3)) for i in range(4)]), "camera_center_world_m": center, "covariance_6x6": square(6, 1e-6), "confidence": F.lit(1.0), "tracking_state": F.lit("OK"), "scale_source": F.lit("known_anchor"), "diagnostics": F.lit('{"synthetic":true}'),
        "width": F.lit(scene.width).cast("long"), "height": F.lit(scene.height).cast("long"), "K": F.array(*[F.lit(float(x)) for x in (scene.fx, 0, scene.cx, 0, scene.fy, scene.cy, 0, 0, 1)]), "distortion_model": F.lit("none"), "distortion_params": F.lit(None).cast("array<double>"),
        "rolling_shutter_row_time_s": F.lit(None).cast("double"), "camera_confidence": F.lit(1.0), "source": F.lit("synthetic_fixture"),
    }
    return frames.withColumns({k: v for k, v in own.items() if k not in frames.columns})


def box_object(frames: DataFrame, scene: Scene = ROOM, object_id: int = 1, label: str = "synthetic_cube", chunk_id: str = "cube_room_ground_truth") -> DataFrame:
    """The object record of the scene's box, seen from the first to the last frame."""
    low, high = scene.box
    numbers = lambda xs: F.array(*[G.float32(F.lit(float(x))) for x in xs])
    center = [(a + b) * 0.5 for a, b in zip(low, high, strict=True)]
    pose = [float(i % 5 == 0) for i in range(16)]
    pose[3], pose[7], pose[11] = center
    seen = frames.agg(F.min("frame_id").alias("first_seen_frame_id"), F.max("frame_id").alias("last_seen_frame_id"))
    return seen.select(
        F.lit(object_id).cast("long").alias("object_id"), F.array(F.struct(F.lit(label).alias("label"), F.lit(1.0).alias("confidence"))).alias("label_candidates"), numbers(pose).alias("T_world_object"), numbers(center).alias("oriented_bbox_center_m"),
        numbers([float(i % 4 == 0) for i in range(9)]).alias("oriented_bbox_axes"), numbers([b - a for a, b in zip(low, high, strict=True)]).alias("oriented_bbox_extents_m"), F.array(F.lit(chunk_id)).alias("mesh_chunk_ids"), F.lit(False).alias("is_dynamic"),
        *[F.lit(x).alias(n) for n, x in (("observed_coverage_ratio", 1.0), ("confidence", 1.0), ("uncertainty_m", 0.0))], "first_seen_frame_id", "last_seen_frame_id", F.to_json(F.struct(F.array(*map(F.lit, low)).alias("bounds_min_m"), F.array(*map(F.lit, high)).alias("bounds_max_m"), F.lit("OBSERVED_SURFACE").alias("surface_source"))).alias("metadata"),
    )


def mesh_chunk(vertices: DataFrame, faces: DataFrame, frames: DataFrame, chunk_id: str = "cube_room_ground_truth", version: int = 1, voxel: float = 0.05) -> DataFrame:
    """One mesh record of a small mesh: vertices and faces in order, each face with its object and as observed."""
    v = vertices.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))), lambda r: F.array(*[G.float32(r[c]) for c in "xyz"]))).alias("vertices_m"))
    f = faces.agg(F.array_sort(F.collect_list(F.struct("face_id", "a", "b", "c", "object_id"))).alias("f"))
    ids = frames.agg(F.array_sort(F.collect_list("frame_id")).alias("source_frame_ids"))
    none = lambda kind: F.lit(None).cast(kind)
    return v.crossJoin(f).crossJoin(ids).select(
        F.lit(chunk_id).alias("chunk_id"), F.lit(version).cast("long").alias("version"), F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]).alias("T_world_chunk"), "vertices_m", F.flatten(F.transform("f", lambda r: F.array(r["a"], r["b"], r["c"]))).cast("array<long>").alias("faces"),
        none("array<double>").alias("normals"), none("array<long>").alias("colors"), none("array<double>").alias("uvs"), F.col("f.object_id").cast("array<long>").alias("object_id_per_face"), F.transform("f", lambda r: F.lit(0).cast("long")).alias("surface_source_per_face"),
        F.lit(voxel).alias("voxel_size_m"), F.lit(0.0).alias("mean_uncertainty_m"), F.lit(0.0).alias("p95_uncertainty_m"), "source_frame_ids", F.lit("known_anchor").alias("scale_source"), F.array(F.lit("synthetic_ground_truth")).alias("flags"),
    )


def box_mesh(low: tuple[float, ...], high: tuple[float, ...]) -> tuple[list[tuple[float, ...]], list[tuple[int, int, int]]]:
    """8 corners (x fastest) and 12 triangles of a box."""
    corners = [(x, y, z) for z in (low[2], high[2]) for y in (low[1], high[1]) for x in (low[0], high[0])]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return corners, [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]


def scene_mesh(spark: SparkSession, scene: Scene = ROOM) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of room and box as one chunk; faces carry their object (0: none, 1: the box)."""
    vertices, faces = [], []
    for obj, bounds in enumerate((scene.room, scene.box)):
        v, f = box_mesh(*bounds)
        faces += [(len(faces) + i, *(len(vertices) + k for k in t), obj) for i, t in enumerate(f)]
        vertices += v
    rows = [(i, *map(float, v)) for i, v in enumerate(vertices)]
    return spark.createDataFrame(rows, "vertex_id int, x double, y double, z double"), spark.createDataFrame(faces, "face_id int, a int, b int, c int, object_id int")
