"""Seeded random rooms with one to three boxes, ray-traced in Arrow batches.

A room is a row: its parameters are drawn by NumPy's PCG64 in executors (the only way to the
same draws), and its pixels are made where it stands: all rooms of one size in a batch are traced by array operations.
Cameras have identity rotation and look along z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from stratafuse.functions import geometry as G

# The room's bounds but for its far wall, sigma of its depth, and the colours of boxes.
LOW, HIGH = (-1.8, -1.2, 0.0), (1.8, 1.2)
SIGMA = 0.002
PALETTE = ((198, 62, 57), (44, 143, 109), (67, 100, 190), (218, 165, 48))

ROOMS = "sample_id long, width int, height int, far double, ox double, oy double, oz double, boxes array<struct<low:array<double>,high:array<double>,color:array<int>>>, color_a array<int>, color_b array<int>"


def sample_seeds(seed: int, first: int, last: int) -> np.ndarray:
    """The seeds of the samples first..last: the stream of the seed, in blocks."""
    rng, at, out = np.random.default_rng(seed), 0, []
    while at < last:
        n = min(1 << 20, last - at)
        block = rng.integers(0, np.iinfo(np.int32).max, size=n)
        out.append(block[max(0, first - at) :])
        at += n
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _uniform(rng: np.random.Generator, *bounds: tuple[float, float]) -> np.ndarray:
    return np.array([rng.uniform(lo, hi) for lo, hi in bounds])


def draw_room(sample_seed: int) -> dict:
    """The parameters of one sample, in the order in which the stream gives them."""
    # The ranges of all draws.
    rng = np.random.default_rng(sample_seed)
    far = float(rng.uniform(3.5, 4.2))
    center = _uniform(rng, (-0.35, 0.35), (-0.22, 0.22), (0.25, 0.6))
    floor, ceiling = np.array(LOW) + (0.08, 0.08, 0.7), np.array([*HIGH, far]) - 0.08
    boxes = []
    for i in range(int(rng.integers(1, 4))):
        xy = _uniform(rng, *(((-0.8, 0.8), (-0.45, 0.45)) if i else ((-0.35, 0.35), (-0.2, 0.2))))
        half = _uniform(rng, (0.28, 0.62), (0.25, 0.58), (0.35, 0.9)) * 0.5
        mid = np.append(xy, rng.uniform(1.15, min(3.0, far - 0.5)))
        color = PALETTE[(i + int(rng.integers(0, 4))) % len(PALETTE)]
        boxes.append({"low": np.maximum(mid - half, floor).tolist(), "high": np.minimum(mid + half, ceiling).tolist(), "color": list(color)})
    walls = [rng.integers(lo, hi, size=3, dtype=np.uint8).astype(int).tolist() for lo, hi in ((92, 150), (145, 215))]
    return {"far": far, "ox": center[0], "oy": center[1], "oz": center[2], "boxes": boxes, "color_a": walls[0], "color_b": walls[1]}


def random_rooms(spark: SparkSession, count: int, width: int = 64, height: int = 48, seed: int = 0) -> DataFrame:
    """``count`` rooms; equal arguments give equal rooms, however they are partitioned."""
    for name, value in (("count", count), ("width", width), ("height", height)):
        if not isinstance(value, int) or value <= 0:
            raise ValueError(f"{name}: must be a positive integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            if len(ids):
                seeds = sample_seeds(seed, int(ids.min()), int(ids.max()) + 1)
                rows = [{"sample_id": i, "width": width, "height": height, **draw_room(int(seeds[i - ids.min()]))} for i in ids.tolist()]
                yield pd.DataFrame(rows)

    return spark.range(count).mapInPandas(run, ROOMS)


def camera(rooms: DataFrame) -> DataFrame:
    """rooms with K (9 numbers, single precision) and T_world_camera (16)."""
    focal = G.float32(F.greatest("width", "height").cast("double") * 0.9)
    zero, one = F.lit(0.0), F.lit(1.0)
    k = F.array(focal, zero, G.float32((F.col("width") - 1.0) * 0.5), zero, focal, G.float32((F.col("height") - 1.0) * 0.5), zero, zero, one)
    pose = G.make_transform([F.lit(float(i % 4 == 0)) for i in range(9)], tuple(G.float32(F.col(c)) for c in ("ox", "oy", "oz")))
    return rooms.withColumns({"K": k, "T_world_camera": pose})


#: Pixels that are traced at once.
TRACED = 1 << 14


def slab(origin: list[np.ndarray], ray: list[np.ndarray], low: list, high: list) -> tuple[np.ndarray, np.ndarray]:
    """(enter, exit) of rays and boxes; (inf, -inf) for a miss."""
    enter, leave, missed = -np.inf, np.inf, False
    for o, d, lo, hi in zip(origin, ray, low, high, strict=True):
        flat = np.abs(d) < 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (lo - o) / d, (hi - o) / d
        enter = np.maximum(enter, np.where(flat, -np.inf, np.minimum(a, b)))
        leave = np.minimum(leave, np.where(flat, np.inf, np.maximum(a, b)))
        missed = missed | (flat & ((o < lo) | (o > hi)))
    hit = ~missed & (enter <= leave)
    return np.where(hit, enter, np.inf), np.where(hit, leave, -np.inf)


def _byte(x: np.ndarray) -> np.ndarray:
    """Clipped to 0..255 and cut to an integer."""
    return np.clip(x, 0, 255).astype(np.int32)


def _traced(rooms: dict[str, np.ndarray], width: int, height: int, most_boxes: int) -> dict[str, np.ndarray]:
    """depth, hit, r, g, b of rooms of one size, (rooms, pixels) each. low, high, color: (rooms, boxes, 3), absent boxes NaN."""
    single = lambda x: float(np.float32(x))
    focal = single(max(width, height) * 0.9)
    v, u = np.divmod(np.arange(width * height), width)
    ray = [((u - single((width - 1.0) * 0.5)) / focal)[None], ((v - single((height - 1.0) * 0.5)) / focal)[None], np.ones((1, 1))]
    origin, far = [rooms[c][:, None] for c in ("ox", "oy", "oz")], rooms["far"][:, None]
    enter, leave = slab(origin, ray, list(LOW), [HIGH[0], HIGH[1], far])
    depth = np.where(enter > 1e-9, enter, leave)  # from outside the room its near side is seen
    hit = np.full(depth.shape, -1, np.int32)
    for i in range(most_boxes):
        corners = [[rooms[n][:, i, k, None] for k in range(3)] for n in ("low", "high")]
        near, out = slab(origin, ray, *corners)
        closer = (out > 1e-9) & (near > 1e-9) & (near < depth)
        depth, hit = np.where(closer, near, depth), np.where(closer, np.int32(i), hit)
    p = [o + d * depth for o, d in zip(origin, ray, strict=True)]
    # Checkers of a quarter metre and stripes across a box's diagonal, with their gradients.
    odd = (np.floor(p[0] * 4.0) + np.floor(p[1] * 4.0)).astype(np.int64) & 1 == 1
    z, x = (p[2] - LOW[2]) / np.maximum(far - LOW[2], 1e-6), (p[0] - LOW[0]) / max(HIGH[0] - LOW[0], 1e-6)
    cue = (40.0 * z, 35.0 * x, 30.0 * (1.0 - z))
    room, at = np.arange(len(depth))[:, None], np.maximum(hit, 0)
    low, high = ([rooms[n][room, at, k] for k in range(3)] for n in ("low", "high"))
    own = [(a - lo) / np.maximum(hi - lo, 1e-6) for a, lo, hi in zip(p, low, high, strict=True)]
    with np.errstate(invalid="ignore"):
        stripe = 0.75 + 0.25 * (np.floor(np.nan_to_num((own[0] + own[1] + own[2]) * 6.0)).astype(np.int64) & 1)
    out = {"depth": depth, "hit": hit}
    for i, (c, slope) in enumerate(zip("rgb", (28.0, 24.0, 30.0), strict=True)):
        wall = _byte(np.where(odd, rooms["color_b"][:, i, None], rooms["color_a"][:, i, None]) * 0.82 + cue[i])
        box = _byte(np.nan_to_num(rooms["color"][room, at, i] * stripe + slope * own[i]))
        out[c] = np.where(hit < 0, wall, box)
    return out


def _each(rooms: DataFrame, keep: list[str], most_boxes: int, made: Callable[[pa.RecordBatch, dict[str, np.ndarray], int, int], pa.RecordBatch], schema: StructType) -> DataFrame:
    """What ``made`` gives for the rooms (their columns to keep) and traced pixels of each part of a batch, all of one size (width, height)."""
    flat = lambda c: F.flatten(F.transform("boxes", lambda x: F.transform(x[c], lambda y: y.cast("double"))))
    numbers = {"_low": flat("low"), "_high": flat("high"), "_color": flat("color"), **{f"_{c}": F.transform(c, lambda y: y.cast("double")) for c in ("color_a", "color_b")}, **{f"_{c}": F.col(c).cast("double") for c in ("ox", "oy", "oz", "far")}}
    own = ["_low", "_high", "_color", "_color_a", "_color_b", "_ox", "_oy", "_oz", "_far", "_w", "_h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("_w", "_h")], 1)
            for width, height in np.unique(sizes, axis=0).tolist():
                same, step = np.flatnonzero((sizes == (width, height)).all(1)), max(1, TRACED // max(1, width * height))
                for at in range(0, len(same), step):
                    part = b.take(pa.array(same[at : at + step]))
                    n = len(part)
                    given = {c: np.asarray(part.column(f"_{c}")) for c in ("ox", "oy", "oz", "far")} | {c: np.asarray(part.column(f"_{c}").flatten()).reshape(n, 3) for c in ("color_a", "color_b")}
                    count = np.asarray(part.column("_low").value_lengths()) // 3
                    if (count > most_boxes).any():
                        raise ValueError(f"boxes: more than {most_boxes}")
                    row, box = np.repeat(np.arange(n), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    for c in ("low", "high", "color"):
                        given[c] = np.full((n, max(1, most_boxes), 3), np.nan)
                        given[c][row, box] = np.asarray(part.column(f"_{c}").flatten()).reshape(-1, 3)
                    yield made(part.select(keep), _traced(given, width, height, most_boxes), width, height)

    rows = rooms.withColumns(numbers | {"_w": F.col("width").cast("long"), "_h": F.col("height").cast("long")}).select(*keep, *own)
    return rows.mapInArrow(run, schema)


def trace(rooms: DataFrame, most_boxes: int = 3) -> DataFrame:
    """The pixels of each room: its columns but the boxes, v, u, depth (double), hit (number of the
    box, -1: the room), r, g, b. The nearest box wins, the first one on ties; the room is what
    stands behind. Rooms with more than ``most_boxes`` boxes raise an error."""
    keep = [c for c in rooms.columns if c not in ("boxes", "color_a", "color_b")]

    def pixels(part: pa.RecordBatch, px: dict[str, np.ndarray], width: int, height: int) -> pa.RecordBatch:
        n = len(part)
        rest = part.take(pa.array(np.repeat(np.arange(n), width * height)))
        v, u = np.divmod(np.arange(width * height), width)
        columns = [pa.array(np.tile(x, n).astype(np.int32)) for x in (v, u)] + [pa.array(px[c].ravel()) for c in ("depth", "hit", "r", "g", "b")]
        return pa.RecordBatch.from_arrays([*rest.columns, *columns], [*keep, "v", "u", "depth", "hit", "r", "g", "b"])

    schema = rooms.select(*keep).schema
    for name in ("v", "u", "depth", "hit", "r", "g", "b"):
        schema = schema.add(name, DoubleType() if name == "depth" else IntegerType())
    return _each(rooms, keep, most_boxes, pixels, schema)


TOTALS = ["n_pixels", "box_pixels", "hits", "depth_micro", "r", "g", "b"]


def room_totals(rooms: DataFrame, most_boxes: int = 3) -> DataFrame:
    """sample_id and sums over the pixels of :func:`trace`: n_pixels, box_pixels (that see a box), hits, depth_micro (each depth in whole
    micrometres), r, g, b. Rooms are summed where they are traced, so no row for each pixel leaves a task."""

    def sums(part: pa.RecordBatch, px: dict[str, np.ndarray], width: int, height: int) -> pa.RecordBatch:
        if not np.isfinite(px["depth"]).all():
            raise ValueError("depth: a pixel sees neither the room nor a box")
        x = px["depth"] * 1e6
        each = [np.full(len(part), width * height), (px["hit"] >= 0).sum(1), px["hit"].sum(1), np.copysign(np.floor(np.abs(x) + 0.5), x).astype(np.int64).sum(1), *[px[c].sum(1) for c in "rgb"]]
        return pa.RecordBatch.from_arrays([part.column("sample_id"), *[pa.array(y.astype(np.int64)) for y in each]], ["sample_id", *TOTALS])

    schema = rooms.select("sample_id").schema
    for name in TOTALS:
        schema = schema.add(name, LongType())
    return _each(rooms, ["sample_id"], most_boxes, sums, schema).groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in TOTALS])


def room_observations(rooms: DataFrame) -> DataFrame:
    """Frame rows for fusion, one a room: frame_id, K, T_world_camera, images depth, sigma, confidence, object_id (1: a
    box, -1: none) and rgb (3 values a pixel), row-major. One groupBy on the room."""
    px = trace(camera(rooms))
    cell = F.struct("v", "u", F.col("depth").cast("float").alias("d"), (F.col("hit") >= 0).alias("o"), F.array("r", "g", "b").alias("c"))
    rows = px.groupBy(F.col("sample_id").alias("frame_id")).agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("K").alias("K"), F.first("T_world_camera").alias("T_world_camera"), F.array_sort(F.collect_list(cell)).alias("_px"))
    n = F.size("_px")
    return rows.select(
        "frame_id", "width", "height", "K", "T_world_camera", F.col("_px.d").alias("depth"), F.array_repeat(F.lit(SIGMA).cast("float"), n).alias("sigma"), F.array_repeat(F.lit(1.0).cast("float"), n).alias("confidence"),
        F.transform("_px.o", lambda x: F.when(x, 1).otherwise(-1)).alias("object_id"), F.flatten("_px.c").alias("rgb"),
    )


def room_clips(rooms: DataFrame) -> DataFrame:
    """Clips of one frame, one a room: frame_ids, images (3 x height x width in 0..1, flat), height, width, K, T_prior, coordinate_frame, metadata."""
    o = room_observations(rooms)
    plane = lambda c: F.transform(F.filter("rgb", lambda x, i: i % 3 == c), lambda x: (x.cast("float") / F.lit(255.0).cast("float")).cast("float"))
    return o.select(F.array("frame_id").alias("frame_ids"), F.concat(plane(0), plane(1), plane(2)).alias("images"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), "K", F.col("T_world_camera").alias("T_prior"), F.lit("x_right_y_down_z_forward").alias("coordinate_frame"), F.to_json(F.struct(F.lit("random_room").alias("source"), F.col("frame_id").alias("sample_id"))).alias("metadata"))
