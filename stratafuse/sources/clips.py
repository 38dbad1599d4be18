"""RGB clips as frame packets: readers for NPZ clips and PPM folders, a data source, and batches.

A packet is a row: frame_id, timestamp_ns, width, height, rgb (bytes, row-major, three a pixel),
K_original and K_model (9 numbers), resize (the 3x3 identity), source_format and metadata. The
model image (planes in 0..1) is a projection of it.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratafuse.operators import checks as K
from stratafuse.operators import records as R
from stratafuse.sources.arrays import clip_intrinsics, parse_ppm

PACKET = "frame_id long, timestamp_ns long, width int, height int, rgb binary, K_original array<double>, K_model array<double>, resize array<double>, source_format string, metadata map<string,string>"
#: Names of the files beside the frames: the clip of the smoke fixture, and the intrinsics of a PPM folder.
SMOKE_CLIP, SIDECAR = "frame_source_smoke.npz", "intrinsics.npz"
_IDENTITY = [float(i % 4 == 0) for i in range(9)]


def read_sidecar(data: bytes, path: str) -> np.ndarray:
    """K of an intrinsics file."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        if "K" not in z.files:
            raise ValueError(f"{path}: has no array K")
        return np.asarray(z["K"])


def _packet(frame_id: int, image: np.ndarray, k: np.ndarray, kind: str, path: str, index: int, file: str | None = None) -> tuple:
    single = np.asarray(k, np.float32).astype(float).ravel().tolist()
    meta = {"source_format": kind, "source_path": path, "frame_index": str(index), "timestamp_placeholder": "true"} | ({"source_file": file} if file else {})
    return frame_id, 0, image.shape[1], image.shape[0], image.tobytes(), single, single, _IDENTITY, kind, list(meta.items())


def _clip_packets(data: bytes, path: str, start: int) -> Iterator[tuple]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        lacking = {"rgb_u8", "K"} - set(z.files)
        if lacking:
            raise ValueError(f"{path}: has no array {', '.join(sorted(lacking))}")
        clip, k = z["rgb_u8"], z["K"]
    if clip.dtype != np.uint8 or clip.ndim != 4 or clip.shape[3] != 3 or 0 in clip.shape:
        raise ValueError("rgb_u8: must be uint8 frames x height x width x 3, none of them empty")
    for t, (image, own) in enumerate(zip(clip, clip_intrinsics(k, len(clip)), strict=True)):
        yield _packet(start + t, image, own, "npz_clip", path, t)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.float64())] * 3, pa.string(), pa.map_(pa.string(), pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.split()[0] for f in PACKET.split(", ")])


def npz_packets(spark: SparkSession, path: str, frame_id_start: int = 0) -> DataFrame:
    """Packets of the clips (rgb_u8 and K) in NPZ files; frame_id counts from ``frame_id_start`` in each file."""
    if frame_id_start < 0:
        raise ValueError("frame_id_start: must not be negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for row in _clip_packets(c, p, frame_id_start):
                    yield _batch([row])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PACKET)


def ppm_packets(spark: SparkSession, folder: str, k: Sequence[Sequence[float]] | None = None, sidecar: str | None = None, frame_id_start: int = 0) -> DataFrame:
    """Packets of a folder's *.ppm files in order of their names. ``k`` (3x3, or one a frame) wins over the
    sidecar (by default ``folder``/intrinsics.npz). Frames of different sizes are refused.

    Ranks and sizes are rows of a frame each; pixels stay where they are read."""
    if frame_id_start < 0:
        raise ValueError("frame_id_start: must not be negative")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ppm").load(folder).select("path", "content")
    heads = files.mapInArrow(_heads, "path string, width int, height int")
    names = heads.select("path", "width", "height").orderBy("path").collect()  # a name and a size a frame
    if not names:
        raise ValueError(f"{folder}: has no *.ppm file")
    sizes = {(r["width"], r["height"]) for r in names}
    if len(sizes) > 1:
        raise ValueError(f"{folder}: frames differ in size: {', '.join(f'{w}x{h}' for w, h in sorted(sizes))}")
    if k is None:
        path = sidecar or f"{folder.rstrip('/')}/{SIDECAR}"
        try:
            found = spark.read.format("binaryFile").load(path).select("content").collect()
        except Exception as e:  # Spark's own exception names the path as well, but not what it is for
            raise ValueError(f"{path}: no intrinsics beside the frames") from e
        k = read_sidecar(bytes(found[0][0]), path)
    each = clip_intrinsics(np.asarray(k), len(names))
    table = {r["path"]: (i, each[i]) for i, r in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                i, own = table[p]
                yield _batch([_packet(frame_id_start + i, parse_ppm(c), own, "ppm_sequence", folder, i, p)])

    return files.mapInArrow(run, PACKET)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shapes = [parse_ppm(c).shape for c in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([s[1] for s in shapes], pa.int32()), pa.array([s[0] for s in shapes], pa.int32())], ["path", "width", "height"])


class _File(InputPartition):
    def __init__(self, path: str, rank: int):
        self.path, self.rank = path, rank


class _ClipReader(DataSourceReader):
    def __init__(self, path: str, start: int):
        self.path, self.start = path, start

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        found = [path] if fs.get_file_info(path).is_file else sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.path.endswith(".npz"))
        if not found:
            raise ValueError(f"{self.path}: has no NPZ clip")
        return [_File(p, i) for i, p in enumerate(found)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        with fs.open_input_file(partition.path) as f:
            for row in _clip_packets(f.read(), partition.path, self.start):
                yield _batch([row])


class ClipSource(DataSource):
    """``spark.read.format("clip_npz").load(path)``: packets of an NPZ clip or of a folder of them, a partition a file.
    Option frameIdStart: the first frame_id of each file."""

    @classmethod
    def name(cls) -> str:
        return "clip_npz"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema) -> DataSourceReader:
        return _ClipReader(self.options["path"], int(self.options.get("frameIdStart", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSource)


def write_smoke_clip(path: str) -> None:
    """The two-frame clip of the smoke fixture."""
    rgb = np.array([[[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 255]]], [[[0, 0, 0], [20, 40, 60]], [[80, 100, 120], [140, 160, 180]]]], np.uint8)
    np.savez(path, rgb_u8=rgb, K=np.array([[32, 0, 0.5], [0, 32, 0.5], [0, 0, 1]], np.float32))


def model_image(rgb: str, width: str, height: str) -> Column:
    """Planes (red, green, blue; row-major; single precision in 0..1) of a column of bytes."""
    at = F.sequence(F.lit(0), F.col(width) * F.col(height) - 1)
    def plane(i: int):
        byte = lambda p: F.conv(F.hex(F.substring(rgb, p * 3 + (i + 1), F.lit(1))), 16, 10)
        return lambda p: (byte(p).cast("float") / F.lit(255.0).cast("float")).cast("float")

    return F.concat(*[F.transform(at, plane(i)) for i in range(3)])


def packet_checks() -> dict[str, Column]:
    """Checks of packets for :func:`stratafuse.operators.checks.violations`."""
    return {
        "frame_id": K.non_negative_int("frame_id"), "timestamp_ns": K.non_negative_int("timestamp_ns"), "rgb": F.octet_length("rgb") == F.col("width") * F.col("height") * 3,
        "K_original": F.col("K_original").isNull() | F.coalesce(K.intrinsics("K_original"), F.lit(False)), "K_model": K.intrinsics("K_model"), "resize": K.vector("resize", 9), "metadata": F.col("metadata").isNotNull(),
    }


def _one_batch(packets: DataFrame, batch_id: str) -> None:
    if not batch_id:
        raise ValueError("batch_id: must be a non-empty string")
    if packets.isEmpty():
        raise ValueError("frames: must hold at least one packet")
    twice = K.duplicates(packets, "frame_id").limit(1).collect()
    if twice:
        raise ValueError(f"frame_id: {twice[0]['frame_id']} comes more than once")


def student_clip(packets: DataFrame, batch_id: str = "frame-packet-clip", position: str = "frame_id") -> DataFrame:
    """One clip of all packets, in the order of ``position``: frame_ids, images (frames x 3 x height x width, flat), height,
    width, K (9 numbers a frame), T_prior (null), coordinate_frame, metadata (JSON). Packets must agree in size."""
    _one_batch(packets, batch_id)
    odd = R.shared_shape(packets.withColumn("_all", F.lit(0)), "_all", "width", "height")
    if not odd.isEmpty():
        raise ValueError("rgb_model: frames differ in size")
    rows = packets.select(F.struct(F.col(position).alias("at"), "frame_id", model_image("rgb", "width", "height").alias("image"), F.col("K_model").alias("K"), "source_format").alias("p"), "width", "height")
    clip = rows.agg(F.array_sort(F.collect_list("p")).alias("p"), F.first("width").alias("w"), F.first("height").alias("h"))
    meta = F.struct(F.lit(batch_id).alias("batch_id"), F.lit("frame_packets").alias("source"), F.size("p").alias("frame_count"), F.lit("B,T,3,H,W").alias("image_layout"), F.lit(True).alias("input_order_preserved"), F.lit(R.CAMERA_FRAME).alias("coordinate_frame"), F.array_distinct(F.array_compact("p.source_format")).alias("source_formats"))
    return clip.select(F.col("p.frame_id").alias("frame_ids"), F.flatten("p.image").alias("images"), F.col("h").cast("long").alias("height"), F.col("w").cast("long").alias("width"), F.flatten("p.K").alias("K"), F.lit(None).cast("array<double>").alias("T_prior"), F.lit(R.CAMERA_FRAME).alias("coordinate_frame"), F.to_json(meta).alias("metadata"))


def teacher_batch(packets: DataFrame, batch_id: str = "frame-packet-teacher-batch", metadata: dict[str, str] | None = None, source: str = "frame_packets", position: str = "frame_id") -> tuple[DataFrame, dict]:
    """(packets with their place in the batch, the batch's header). ``metadata`` may not use the reserved keys."""
    _one_batch(packets, batch_id)
    for key in metadata or {}:
        if key in R.RESERVED_BATCH_KEYS:
            raise ValueError(f"metadata.{key}: is a reserved field")
    ranked = packets.select(F.struct(F.col(position).alias("at"), "frame_id", "source_format").alias("p")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    head = ranked.select("p.frame_id", F.array_distinct(F.array_compact("p.source_format")).alias("f")).first()  # an id a frame
    header = {"source": source, "frame_count": len(head["frame_id"]), "frame_ids": list(head["frame_id"]), "input_order_preserved": True, "coordinate_frame": R.CAMERA_FRAME} | ({"source_formats": list(head["f"])} if head["f"] else {}) | (metadata or {})
    places = packets.sparkSession.createDataFrame([(f, i) for i, f in enumerate(head["frame_id"])], "frame_id long, place int")
    return packets.join(F.broadcast(places), "frame_id"), {"batch_id": batch_id, "metadata": json.loads(json.dumps(header))}
