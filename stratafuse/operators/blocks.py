"""Block-sparse depth fusion: only the blocks of voxels that a frame's depth can reach are integrated.

Each pixel stands for a piece of a pyramid: from its depth less the truncation band to its depth and the band, as wide as the
pixel. The blocks that hold voxels of its bounding box are the frame's; all other voxels of the grid are never
looked at, so the work follows the seen surface and not the grid. Frames go through numpy by Arrow batches and stay in their task; what
leaves it are the sums of each voxel, once for many frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators.fusion import GRID, Grid, fused
from stratafuse.operators.scenes import ROOM, Scene, intrinsics

#: Voxels of a block's side, and blocks whose sums a task holds before it passes them on (16 KB each).
SIDE, HELD = 8, 2048
SUMS = "ix int, iy int, iz int, _sw long, _w long, _fsw double, _fw double"
_CAMERA = ["fx", "cx", "fy", "cy", *[f"r{i}" for i in range(9)], *[f"t{i}" for i in range(3)]]


def camera_rows(frames: DataFrame, scene: Scene = ROOM, more: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Frame rows with their images (and ``more`` of them), the columns to keep and the numbers of their camera: lens, and the turn and shift from the world to it."""
    images = [c for c in ("depth", "sigma", "confidence") if c in frames.columns]
    k = intrinsics(frames, scene)
    if "T_world_camera" in frames.columns:
        r, t = ([G.float32(x) for x in xs] for xs in (G.rotation_of("T_world_camera"), G.camera_center("T_world_camera")))
        back, shift = G.invert_transform(r, t)
    else:
        back, shift = [F.lit(float(i % 4 == 0)) for i in range(9)], [-G.float32(F.col(c)) for c in ("ox", "oy", "oz")]
    numbers = [k[0], k[2], k[4], k[5], *back, *shift]
    return frames.select(*(keep or []), "frame_id", *[F.col(c).cast("array<float>").alias(c) for c in images], *[F.col(c).cast("array<double>").alias(c) for c in more or []], *[x.cast("double").alias(n) for x, n in zip(numbers, _CAMERA, strict=True)])


def touched_blocks(depth: np.ndarray, camera: np.ndarray, width: int, low: np.ndarray, voxel: float, band: float, shape: np.ndarray) -> np.ndarray:
    """The blocks (rows of bx, by, bz) that hold every voxel which may lie within the band of a pixel's depth."""
    fx, cx, fy, cy = camera[:4]
    turn, shift = camera[4:13].reshape(3, 3), camera[13:16]
    d = depth.astype(np.float64)
    near, far = np.maximum(d - band, 0.0), d + band
    pixel = np.flatnonzero(np.isfinite(d) & (far > 0))
    near, far = near[pixel], far[pixel]
    v, u = np.divmod(pixel, width)
    lo, hi = np.full((len(pixel), 3), np.inf), np.full((len(pixel), 3), -np.inf)
    for z in (near, far):
        for du in (-0.5, 0.5):
            for dv in (-0.5, 0.5):
                q = np.stack([(u + du - cx) / fx * z, (v + dv - cy) / fy * z, z], 1)
                p = (q - shift) @ turn  # the turn's inverse is its transpose
                np.minimum(lo, p, out=lo)
                np.maximum(hi, p, out=hi)
    slack = 1e-6 * (1 + np.abs(hi).max(initial=0.0) + np.abs(lo).max(initial=0.0))
    first = np.ceil((lo - slack - low) / voxel - 0.5)
    last = np.floor((hi + slack - low) / voxel - 0.5)
    first, last = np.clip(first, 0, shape).astype(np.int64), np.clip(last, -1, shape - 1).astype(np.int64)
    some = (first <= last).all(1)
    first, last = first[some] // SIDE, last[some] // SIDE
    ranges = np.unique(np.concatenate([first, last], 1), axis=0)
    size = ranges[:, 3:] - ranges[:, :3] + 1
    count = size.prod(1)
    row = np.repeat(np.arange(len(ranges)), count)
    n = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    blocks = np.stack([n // (size[row, 1] * size[row, 2]), n // size[row, 2] % size[row, 1], n % size[row, 2]], 1) + ranges[row, :3]
    return np.unique(blocks, axis=0)


class Sums:
    """Sums of blocks of voxels, in the order in which blocks came."""

    def __init__(self):
        self.row: dict[tuple[int, int, int], int] = {}
        self.sums = np.zeros((64, SIDE**3, 4))

    def rows(self, blocks: np.ndarray) -> np.ndarray:
        out = np.array([self.row.setdefault(b, len(self.row)) for b in map(tuple, blocks.tolist())], np.int64)
        if len(self.row) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.row), 2 * len(self.sums)) - len(self.sums), SIDE**3, 4))])
        return out

    def batch(self) -> pa.RecordBatch:
        block = np.array(list(self.row), np.int64).reshape(-1, 3)
        sums = self.sums[: len(block)].reshape(-1, 4)
        at = np.flatnonzero(sums[:, 3] > 0)
        inside = np.stack(np.unravel_index(at % SIDE**3, (SIDE,) * 3), 1) + SIDE * block[at // SIDE**3]
        columns = [pa.array(inside[:, k], pa.int32()) for k in range(3)] + [pa.array(np.rint(sums[at, k]), pa.int64()) if k < 2 else pa.array(sums[at, k]) for k in (0, 1, 2, 3)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SUMS.split(", ")])


class Integrator:
    """Looks the voxels of one frame's blocks up in its images."""

    def __init__(self, grid: Grid, scene: Scene):
        self.low, self.shape, self.voxel, self.band = np.array(grid.low, float), np.array(grid.shape), grid.voxel, grid.truncation
        self.width, self.height = scene.width, scene.height
        self.inside = np.stack(np.unravel_index(np.arange(SIDE**3), (SIDE,) * 3), 1)
        self.plain = {"sigma": float(np.float32(scene.sigma)), "confidence": float(np.float32(scene.confidence))}

    def rows(self, b: pa.RecordBatch, images: dict[str, int]) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
        """(row, its images, its camera) of a batch; ``images``: numbers that an image has for each pixel, where it is present."""
        camera = np.stack([np.asarray(b.column(n)) for n in [*_CAMERA, *(c for c in ("_ox", "_oy", "_oz") if c in b.schema.names)]], 1)
        flat = {n: np.asarray(b.column(n).flatten()) for n in images if n in b.schema.names}
        size = {n: np.asarray(b.column(n).value_lengths().fill_null(0)) for n in flat}
        start = {n: np.concatenate([[0], np.cumsum(k)]) for n, k in size.items()}
        for i in range(len(b)):
            for n, k in size.items():
                if k[i] != self.width * self.height * images[n]:
                    raise ValueError(f"{n}: frame {b.column('frame_id')[i].as_py()} has {k[i]} numbers, expected {self.width * self.height * images[n]}")
            yield i, {n: x[start[n][i] : start[n][i + 1]] for n, x in flat.items()}, camera[i]

    def samples(self, own: dict[str, np.ndarray], camera: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The frame's blocks, and of each voxel that it sees within the band: its place (block's row * SIDE^3 + place in it), its pixel, its clipped
        distance and its weight."""
        blocks = touched_blocks(own["depth"], camera, self.width, self.low, self.voxel, self.band, self.shape)
        index = (blocks[:, None, :] * SIDE + self.inside).reshape(-1, 3)
        fx, cx, fy, cy = camera[:4]
        turn, shift = camera[4:13], camera[13:16]
        p = [self.low[k] + (index[:, k] + 0.5) * self.voxel for k in range(3)]
        q = [turn[3 * k] * p[0] + turn[3 * k + 1] * p[1] + turn[3 * k + 2] * p[2] + shift[k] for k in range(3)]
        seen = np.flatnonzero((q[2] > 0) & (index < self.shape).all(1))
        qz = q[2][seen]
        u, v = np.rint(fx * q[0][seen] / qz + cx), np.rint(fy * q[1][seen] / qz + cy)
        on = (u >= 0) & (u < self.width) & (v >= 0) & (v < self.height)
        seen, qz, pixel = seen[on], qz[on], (v[on] * self.width + u[on]).astype(np.int64)
        sd = own["depth"][pixel].astype(np.float64) - qz
        confidence, sigma = (own[n][pixel].astype(np.float64) if n in own else self.plain[n] for n in ("confidence", "sigma"))
        w = np.broadcast_to(confidence / (1.0 + sigma / self.voxel), sd.shape)
        on = (np.abs(sd) <= self.band) & (w > 0)
        return blocks, seen[on], pixel[on], np.clip(sd[on] / self.band, -1, 1), w[on]


def whole(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


IMAGES = {"depth": 1, "sigma": 1, "confidence": 1}


def _integrated(grid: Grid, scene: Scene):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, held = Integrator(grid, scene), Sums()
        for b in batches:
            for _, own, camera in look.rows(b, IMAGES):
                blocks, at, _, s, w = look.samples(own, camera)
                if len(at):
                    rows = held.rows(blocks)
                    # a voxel is met once a frame
                    held.sums[rows[at // SIDE**3], at % SIDE**3] += np.stack([whole(s * w * 1e9), whole(w * 1e9), s * w, w], 1)
                if len(held.row) >= HELD:
                    yield held.batch()
                    held = Sums()
        if held.row:
            yield held.batch()

    return run


def fuse(frames: DataFrame, grid: Grid = GRID, scene: Scene = ROOM) -> DataFrame:
    """ix, iy, iz, tsdf, weight of the voxels that the frames see: the volume of ``integrate(voxel_samples(frames))``.

    frames: frame_id and depth (row-major, NaN: nothing), if present sigma and confidence, K, and T_world_camera or ox, oy,
    oz. Images of another size than the scene's raise ValueError. Without frames there are no voxels."""
    sums = camera_rows(frames, scene).mapInArrow(_integrated(grid, scene), SUMS)
    return fused(sums.groupBy("ix", "iy", "iz").agg(*[F.sum(c).alias(c) for c in ("_sw", "_w", "_fsw", "_fw")]))


def _counted(grid: Grid, scene: Scene):
    low, shape = np.array(grid.low, float), np.array(grid.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            camera = np.stack([np.asarray(b.column(n)) for n in _CAMERA], 1)
            n = [len(touched_blocks(np.array(d, np.float32), camera[i], scene.width, low, grid.voxel, grid.truncation, shape)) for i, d in enumerate(b.column("depth").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), pa.array(n, pa.int64())], ["frame_id", "n_blocks"])

    return run


def frame_blocks(frames: DataFrame, grid: Grid = GRID, scene: Scene = ROOM) -> DataFrame:
    """frame_id, n_blocks: how many blocks of the grid each frame integrates."""
    rows = camera_rows(frames, scene)
    kind = dict(rows.dtypes)["frame_id"]
    return rows.select("frame_id", "depth", *_CAMERA).mapInArrow(_counted(grid, scene), f"frame_id {kind}, n_blocks long")


def _points(scene: Scene):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Integrator(GRID, scene)
        v, u = np.divmod(np.arange(scene.width * scene.height), scene.width)
        for b in batches:
            for _, own, camera in look.rows(b, IMAGES):
                d, (fx, cx, fy, cy) = own["depth"].astype(np.float64), camera[:4]
                on = (d > 0) & (own["confidence"] > 0) if "confidence" in own else d > 0
                d = d[on]
                q = [(u[on] * fy - cx * fy) / (fx * fy) * d, (v[on] * fx - cy * fx) / (fx * fy) * d, d]
                turn, center = camera[4:13].reshape(3, 3), camera[16:19]
                p = [turn[0, k] * q[0] + turn[1, k] * q[1] + turn[2, k] * q[2] + center[k] for k in range(3)]
                p = np.stack(p, 1).astype(np.float32).astype(np.float64)
                p = p[np.isfinite(p).all(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(3)], list("xyz"))

    return run


def frame_points(frames: DataFrame, scene: Scene = ROOM) -> DataFrame:
    """x, y, z (single precision) of all pixels of positive depth and confidence of frame rows: the points of
    ``observed_points``, without a row for each pixel on the way."""
    centers = [G.float32(x).cast("double") for x in (G.camera_center("T_world_camera") if "T_world_camera" in frames.columns else tuple(F.col(c) for c in ("ox", "oy", "oz")))]
    named = {f"_o{c}": x for c, x in zip("xyz", centers, strict=True)}
    rows = camera_rows(frames.withColumns(named), scene, keep=list(named))
    return rows.mapInArrow(_points(scene), "x double, y double, z double")


# ---------------------------------------------------------------- colours, normals, objects

MORE = {"color": 3, "normal": 3, "object": 1}
ATTRIBUTES = "ix int, iy int, iz int, label long, _w long, _cr long, _cg long, _cb long, _nx long, _ny long, _nz long"
#: Samples whose sums a task forms at once.
GATHER = 1 << 18


def _attributed(grid: Grid, scene: Scene):
    names = [x.split()[0] for x in ATTRIBUTES.split(", ")]

    def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        voxel, label, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((label, voxel[:, 2], voxel[:, 1], voxel[:, 0]))
        voxel, label, values = voxel[order], label[order], values[order]
        new = np.flatnonzero(np.concatenate([[True], (voxel[1:] != voxel[:-1]).any(1) | (label[1:] != label[:-1])]))
        total = np.add.reduceat(values, new, axis=0)
        columns = [pa.array(voxel[new, k], pa.int32()) for k in range(3)] + [pa.array(label[new], pa.int64(), mask=label[new] < 0)] + [pa.array(total[:, k]) for k in range(7)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, parts, held = Integrator(grid, scene), [], 0
        for b in batches:
            for _, own, camera in look.rows(b, IMAGES | MORE):
                blocks, at, pixel, _, w = look.samples(own, camera)
                if not len(at):
                    continue
                voxel = blocks[at // SIDE**3] * SIDE + look.inside[at % SIDE**3]
                color, normal = (own[n].reshape(-1, 3)[pixel].astype(np.float64) if n in own else np.zeros((len(at), 3)) for n in ("color", "normal"))
                label = own["object"][pixel].astype(np.float64) if "object" in own else np.full(len(at), np.nan)
                label = np.where(np.isfinite(label) & (label >= 0), label, -1).astype(np.int64)
                values = np.concatenate([whole(w * 1e6)[:, None], whole(w[:, None] * color * 1e6), whole(w[:, None] * normal * 1e6)], 1)
                parts.append((voxel, label, values.astype(np.int64)))
                held += len(at)
                if held >= GATHER:
                    yield summed(parts)
                    parts, held = [], 0
        if parts:
            yield summed(parts)

    return run


def fuse_attributes(frames: DataFrame, grid: Grid = GRID, scene: Scene = ROOM) -> DataFrame:
    """ix, iy, iz, weight, red, green, blue (weighted means), nx, ny, nz (weighted mean of unit length; 0 where normals cancel out), and the object
    of each voxel that the frames see: object_id (highest weight, the smallest of several, null where none is known), object_share (of
    the weight with a known object) and n_objects.

    frames as for :func:`fuse`, with the images color and normal (three numbers a pixel, normals in the world) and object
    (null or negative: none), each where it is present. All sums are of integers and merge in any order."""
    more = [c for c in MORE if c in frames.columns]
    named = camera_rows(frames, scene, more).mapInArrow(_attributed(grid, scene), ATTRIBUTES)
    sums = ["_w", "_cr", "_cg", "_cb", "_nx", "_ny", "_nz"]
    by_label = named.groupBy("ix", "iy", "iz", "label").agg(*[F.sum(c).alias(c) for c in sums])
    known = F.when(F.col("label").isNotNull(), F.col("_w"))
    every = by_label.groupBy("ix", "iy", "iz").agg(*[F.sum(c).alias(c) for c in sums], F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("_w")).alias("k"), "label"))).alias("_top"), F.sum(known).alias("_known"), F.count("label").alias("n_objects"))
    w = F.col("_w").cast("double")
    size = F.sqrt(sum((F.col(c).cast("double") * F.col(c).cast("double") for c in sums[4:]), F.lit(0.0)))
    mean = {n: F.col(c) / F.nullif(w, F.lit(0.0)) for n, c in zip(("red", "green", "blue"), sums[1:4], strict=True)}
    unit = {n: F.when(size > 0, F.col(c) / F.nullif(size, F.lit(0.0))).otherwise(0.0) for n, c in zip(("nx", "ny", "nz"), sums[4:], strict=True)}
    top = {"object_id": F.col("_top.label"), "object_share": -F.col("_top.k") / F.nullif(F.col("_known").cast("double"), F.lit(0.0))}
    return every.select("ix", "iy", "iz", (w / 1e6).alias("weight"), *[x.alias(n) for n, x in (mean | unit | top).items()], "n_objects")
