"""Image and array files: binary PPM and NPZ decoders over ``binaryFile``, JSON lines, depth folders."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.operators.windows import global_rank

PIXELS = "path string, frame int, v int, u int, r short, g short, b short"


def parse_ppm(data: bytes) -> np.ndarray:
    """(height, width, 3) of a binary 8-bit PPM; comments are allowed in the header."""
    fields, at = [], 0
    while len(fields) < 4:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)").match(data, at)
        if not m:
            raise ValueError("ppm: header ends early")
        fields.append(m[1])
        at = m.end()
    if fields[0] != b"P6" or fields[3] != b"255":
        raise ValueError("ppm: only 8-bit P6 is supported")
    w, h = int(fields[1]), int(fields[2])
    raster = data[at + 1 :]
    if min(w, h) <= 0 or len(raster) != w * h * 3:
        raise ValueError("ppm: raster has the wrong length")
    return np.frombuffer(raster, np.uint8).reshape(h, w, 3)


def _long(path: str, frame: int, image: np.ndarray) -> pd.DataFrame:
    h, w, _ = image.shape
    v, u = np.divmod(np.arange(h * w), w)
    flat = image.reshape(-1, 3).astype(np.int16)
    return pd.DataFrame({"path": path, "frame": np.int32(frame), "v": v.astype(np.int32), "u": u.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})


def read_ppm_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of all *.ppm files; frame is the rank of the file's name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                yield _long(p, 0, parse_ppm(bytes(c)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ppm").load(folder)
    ranks = global_rank(files.select("path"), "path")  # a name a frame
    return files.select("path", "content").mapInPandas(run, PIXELS).join(ranks, "path").withColumn("frame", F.col("rank").cast("int")).drop("rank")


def read_npz_clip(spark: SparkSession, path: str, frame_id_start: int = 0) -> DataFrame:
    """Pixels of the clip rgb_u8 (frames, height, width, 3) of NPZ files (no pickled objects)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(bytes(c)), allow_pickle=False) as z:
                    clip = z["rgb_u8"]
                if clip.ndim != 4 or clip.shape[3] != 3 or clip.dtype != np.uint8:
                    raise ValueError("rgb_u8: must be uint8 frames x height x width x 3")
                for t, image in enumerate(clip):
                    yield _long(p, frame_id_start + t, image)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PIXELS)


def clip_intrinsics(k: np.ndarray, frames: int) -> np.ndarray:
    """(frames, 3, 3): one 3x3 matrix for all frames, or one a frame."""
    k = np.asarray(k, np.float64)
    if k.shape == (3, 3):
        k = np.broadcast_to(k, (frames, 3, 3))
    if k.shape != (frames, 3, 3) or not np.isfinite(k).all() or (k[:, 0, 0] <= 0).any() or (k[:, 1, 1] <= 0).any():
        raise ValueError("K: must be 3x3 or frames x 3x3 with positive focal lengths")
    return k


def read_depth_folder(spark: SparkSession, folder: str) -> DataFrame:
    """frame_id, name, v, u, value of every two-dimensional array in frame_<id>.npz files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                m = re.search(r"/frame_(\d+)\.npz$", p)
                if not m:
                    raise ValueError(f"{p}: not a frame_<id>.npz name")
                with np.load(io.BytesIO(bytes(c)), allow_pickle=False) as z:
                    for name in sorted(z.files):
                        a = z[name]
                        if a.ndim == 2:
                            v, u = np.divmod(np.arange(a.size), a.shape[1])
                            yield pd.DataFrame({"frame_id": np.int64(m[1]), "name": name, "v": v.astype(np.int32), "u": u.astype(np.int32), "value": a.ravel().astype(np.float64)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    return files.select("path", "content").mapInPandas(run, "frame_id long, name string, v int, u int, value double")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def safe_payload_path(root: str, relative: str, below: str = "arrays") -> str:
    """The path of a payload: relative, without "..", under ``below``."""
    parts = relative.split("/")
    if relative.startswith("/") or "\\" in relative or ".." in parts or parts[0] != below:
        raise ValueError(f"arrays_path: {relative} must be a path under {below}/")
    return f"{root.rstrip('/')}/{relative}"


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, by default the storage of every table; partitioned for lookups of one frame."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with columns in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
