"""Live maps: poses and depth images arrive in streams of their own, in any order and more than once; blocks of voxels are kept as
state and go out with a version whenever they change.

* Either stream drops what repeats within the watermark; both meet by map and frame id within a bounded time.
* A frame's sums are formed block by block before anything is keyed, so a map is spread over all its blocks: no task
  holds a map, and the state of a key is one block.
* A block that a micro-batch touches goes out once with its new version and its sums so far. Readers take the highest version of
  each block; a batch that is run again after a failure writes the same versions again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratafuse.operators.blocks import _CAMERA, IMAGES, SIDE, Integrator, camera_rows, whole
from stratafuse.operators.fusion import GRID, Grid, fused
from stratafuse.operators.scenes import ROOM, Scene

PARTS = "map_id string, frame_id long, bx int, by int, bz int, sums binary"
BLOCKS = "map_id string, bx int, by int, bz int, version long, n_frames long, sums binary"


def _block_sums(grid: Grid, scene: Scene):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Integrator(grid, scene)
        for b in batches:
            maps, frames = b.column("map_id").to_pylist(), b.column("frame_id").to_pylist()
            for i, own, camera in look.rows(b, IMAGES):
                blocks, at, _, s, w = look.samples(own, camera)
                sums = np.zeros((len(blocks), SIDE**3, 4))
                sums[at // SIDE**3, at % SIDE**3] = np.stack([whole(s * w * 1e9), whole(w * 1e9), s * w, w], 1)
                some = np.flatnonzero((sums[..., 3] > 0).any(1))
                n = len(some)
                columns = [pa.array([maps[i]] * n, pa.string()), pa.array([frames[i]] * n, pa.int64()), *[pa.array(blocks[some, k], pa.int32()) for k in range(3)], pa.array([x.tobytes() for x in sums[some]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PARTS.split(", ")])

    return run


class _Block(StatefulProcessor):
    """The sums, version and number of frames of one block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "version long, n_frames long, sums binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, n, sums = self.block.get() if self.block.exists() else (0, 0, None)
        total = np.zeros(SIDE**3 * 4) if sums is None else np.frombuffer(sums).copy()
        for part in rows:
            for x in part["sums"]:
                total += np.frombuffer(x)
                n += 1
        self.block.update((version + 1, n, total.tobytes()))
        yield pd.DataFrame([(*key, version + 1, n, total.tobytes())], columns=[x.split()[0] for x in BLOCKS.split(", ")])

    def close(self) -> None:
        pass


def dirty_blocks(poses: DataFrame, depths: DataFrame, grid: Grid = GRID, scene: Scene = ROOM, delay: str = "30 seconds", apart: str = "10 seconds") -> DataFrame:
    """The stream of changed blocks: map_id, bx, by, bz, version (from 1 on), n_frames, sums.

    poses: map_id, frame_id, time, T_world_camera or ox, oy, oz, and K if known; depths: map_id, frame_id, time, depth, and
    sigma and confidence if known. Rows that come more than ``delay`` after the latest time seen are late and may be dropped; a pose and a depth image
    of a frame meet if their times lie within ``apart``. The session needs the RocksDB state store."""
    sides = []
    for name, df in (("p", poses), ("d", depths)):
        seen = df.where("map_id is not null and frame_id is not null").withWatermark("time", delay).dropDuplicatesWithinWatermark(["map_id", "frame_id"])
        sides.append(seen.alias(name))
    near = F.expr(f"p.map_id = d.map_id and p.frame_id = d.frame_id and d.time between p.time - interval {apart} and p.time + interval {apart}")
    both = sides[0].join(sides[1], near)
    more = [c for c in ("depth", "sigma", "confidence") if c in depths.columns]
    posed = [c for c in ("T_world_camera", "ox", "oy", "oz", "K") if c in poses.columns]
    frames = both.select(F.col("d.map_id").alias("map_id"), F.col("d.frame_id").alias("frame_id"), *[F.col(f"d.{c}").alias(c) for c in more], *[F.col(f"p.{c}").alias(c) for c in posed])
    rows = camera_rows(frames, scene, keep=["map_id"])
    parts = rows.select("map_id", F.col("frame_id").cast("long").alias("frame_id"), *more, *_CAMERA).mapInArrow(_block_sums(grid, scene), PARTS)
    return parts.groupBy("map_id", "bx", "by", "bz").transformWithStateInPandas(_Block(), BLOCKS, "Append", "None")


def write_blocks(blocks: DataFrame, folder: str, checkpoint: str):
    """Start a query that writes the stream of changed blocks below ``folder``, a batch a folder of its number, and stops when its inputs are read."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["map_id", "ix", "iy", "iz", "_sw", "_w", "_fsw", "_fw"]
    inside = np.stack(np.unravel_index(np.arange(SIDE**3), (SIDE,) * 3), 1)
    for b in batches:
        for m, x, y, z, sums in zip(*(b.column(c).to_pylist() for c in ("map_id", "bx", "by", "bz", "sums")), strict=True):
            t = np.frombuffer(sums).reshape(-1, 4)
            at = np.flatnonzero(t[:, 3] > 0)
            voxel = inside[at] + SIDE * np.array([x, y, z])
            columns = [pa.array([m] * len(at), pa.string()), *[pa.array(voxel[:, k], pa.int32()) for k in range(3)], *[pa.array(np.rint(t[at, k]), pa.int64()) for k in (0, 1)], *[pa.array(t[at, k]) for k in (2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, names)


def live_volume(spark: SparkSession, folder: str) -> DataFrame:
    """map_id, ix, iy, iz, tsdf, weight as of the highest version of each block."""
    rows = spark.read.schema(BLOCKS).parquet(folder)
    newest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("map_id", "bx", "by", "bz").orderBy(F.desc("version")))).where("_r = 1")
    voxels = newest.select("map_id", "bx", "by", "bz", "sums").mapInArrow(_voxels, "map_id string, ix int, iy int, iz int, _sw long, _w long, _fsw double, _fw double")
    return fused(voxels, ["map_id"])


def changed_since(spark: SparkSession, folder: str, batch: int = -1) -> DataFrame:
    """map_id, bx, by, bz, version of the blocks that changed after a batch: what a reader of the map has to fetch or mesh again."""
    rows = spark.read.schema(BLOCKS + ", batch long").parquet(folder).where(F.col("batch") > batch)
    return rows.groupBy("map_id", "bx", "by", "bz").agg(F.max("version").alias("version"))
