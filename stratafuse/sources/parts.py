"""A sink for files that other tools read as one: tasks write parts, a commit makes them known, and one task puts each file together.

Rows of (file, part, data) go through the data source ``file_parts``. Each task attempt writes its rows to files of its own in a hidden
folder beside the target; a job that fails, and attempts that do, leave nothing but that folder, which is deleted. The commit
step gets names and sizes only. Files are then joined part by part, in pieces of bounded size, under a name of their own, and appear by a rename.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from stratafuse.sources.texts import open_fs

#: Bytes that are copied at once, and of the lines of one part.
PIECE, LINES = 4 << 20, 4 << 20
SCHEMA = "file string, part long, data binary"


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, int, str, int]]  # file, part, name, bytes


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, hidden: str):
        self.folder, self.hidden = folder, hidden

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = open_fs(f"{self.folder}/{self.hidden}")
        fs.create_dir(at, recursive=True)
        attempt, done = TaskContext.get().taskAttemptId(), []
        for b in iterator:
            for file, part, data in zip(*(b.column(c) for c in ("file", "part", "data")), strict=True):
                name = f"{uuid.uuid4().hex}-{attempt}"
                with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
                    out.write(data.as_buffer())
                done.append((file.as_py(), part.as_py(), name, len(data.as_buffer())))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted(p for m in messages if m for p in m.parts)
        fs, at = open_fs(f"{self.folder}/{self.hidden}")
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/committed", compression=None) as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list[Written | None]) -> None:
        discard_parts(self.folder, self.hidden)


class FileParts(DataSource):
    """``file_parts``: options folder and hidden (the name of the folder of parts in it)."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["folder"], self.options["hidden"])


def discard_parts(folder: str, hidden: str) -> None:
    fs, at = open_fs(f"{folder}/{hidden}")
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)


def _copied(fs: pafs.FileSystem, names: list[str], out) -> None:
    for name in names:
        with fs.open_input_stream(name, compression=None) as part:
            while data := part.read(PIECE):
                out.write(data)


def _npy_head(kind: str, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_2_0(out, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": shape})
    return out.getvalue()


def write_parts(rows: DataFrame, folder: str) -> str:
    """Write rows (file, part, data) as parts below ``folder``; the name of the hidden folder that holds them."""
    spark, hidden = rows.sparkSession, f"_parts-{uuid.uuid4().hex}"
    spark.dataSource.register(FileParts)
    try:
        rows.select("file", "part", "data").write.format("file_parts").option("folder", folder).option("hidden", hidden).mode("append").save()
    except Exception:
        discard_parts(folder, hidden)
        raise
    return hidden


def join_parts(spark: SparkSession, folder: str, hidden: str, arrays: dict[str, list[tuple[str, str, tuple[int, ...]]]] | None = None) -> list[str]:
    """Put the files of committed parts together, a task a file, and delete the parts: their names. ``arrays``: NPZ files, with (name, type, shape) of
    their arrays, whose parts belong to the file <file>/<name>; other files are their parts one after the other."""
    fs, at = open_fs(f"{folder}/{hidden}")
    with fs.open_input_stream(f"{at}/committed", compression=None) as f:
        parts = json.loads(f.read())
    by_file: dict[str, list] = {}
    for file, part, name, size in parts:
        by_file.setdefault(file, []).append((part, name, size))
    arrays = arrays or {}
    members = {f"{file}/{name}" for file, known in arrays.items() for name, *_ in known}
    targets = sorted({*(x for x in by_file if x not in members), *arrays})
    plan = {t: {m: by_file.get(m, []) for m in ([f"{t}/{n}" for n, *_ in arrays[t]] if t in arrays else [t])} for t in targets}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                target = targets[i]
                fs, top = open_fs(folder)
                work = f"{top}/{hidden}/joined-{uuid.uuid4().hex}"
                with fs.open_output_stream(work, compression=None) as out:
                    own = {m: [f"{top}/{hidden}/{name}" for _, name, _ in sorted(p)] for m, p in plan[target].items()}
                    if target in arrays:
                        with zipfile.ZipFile(out, "w") as archive:  # a stream: sizes follow the data
                            for name, kind, shape in arrays[target]:
                                size = sum(s for *_, s in plan[target][f"{target}/{name}"])
                                if size != np.dtype(kind).itemsize * int(np.prod(shape, dtype=np.int64)):
                                    raise ValueError(f"{target}: {name} has {size} bytes, its shape {shape} asks for others")
                                with archive.open(zipfile.ZipInfo(f"{name}.npy"), "w", force_zip64=True) as member:
                                    member.write(_npy_head(kind, tuple(shape)))
                                    _copied(fs, own[f"{target}/{name}"], member)
                    else:
                        _copied(fs, own[target], out)
                fs.create_dir(f"{top}/{target}".rpartition("/")[0], recursive=True)
                fs.move(work, f"{top}/{target}")
                yield pa.RecordBatch.from_arrays([pa.array([target])], ["file"])

    try:
        done = [r[0] for r in spark.range(len(targets)).repartition(max(1, len(targets)), "id").mapInArrow(run, "file string").collect()] if targets else []
    finally:
        discard_parts(folder, hidden)
    return sorted(done)


def _slabs(shape: tuple[int, int, int], fills: dict[str, float], file: str):
    """Each layer of voxels (ix) of a dense grid as a part of each array; voxels without a row have the array's fill."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = tuple(np.asarray(rows.column(c).drop_null()) for c in ("iy", "iz"))
        data = []
        for name, fill in fills.items():
            layer = np.full(shape[1:], fill, np.float32)
            layer[at] = np.asarray(rows.column(name).drop_null())
            data.append(layer.tobytes())
        n = len(fills)
        return pa.table({"file": [f"{file}/{x}" for x in fills], "part": pa.array([key[0].as_py()] * n, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def grid_parts(voxels: DataFrame, shape: tuple[int, int, int], fills: dict[str, float], file: str) -> DataFrame:
    """Parts of the dense arrays ``fills`` (name: value of voxels without a row) of voxels (ix, iy, iz, ...): a layer a group."""
    layers = voxels.sparkSession.range(shape[0]).select(F.col("id").cast("int").alias("_x"))
    rows = layers.join(voxels.select("ix", "iy", "iz", *fills), F.col("_x") == F.col("ix"), "left")
    return rows.groupBy("_x").applyInArrow(_slabs(shape, fills, file), SCHEMA)


def row_parts(rows: DataFrame, order: str, arrays: dict[str, tuple[str, list[str]]], file: str) -> DataFrame:
    """Parts of arrays (name: (type, columns)) with a row for each row, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            data = [np.stack([np.asarray(b.column(c)) for c in columns], 1).astype(kind).tobytes() for kind, columns in arrays.values()]
            yield pa.RecordBatch.from_arrays([pa.array([f"{file}/{x}" for x in arrays]), pa.array([at + k] * len(arrays), pa.int64()), pa.array(data, pa.binary())], ["file", "part", "data"])

    columns = sorted({c for _, cs in arrays.values() for c in cs})
    return rows.select(F.col(order).alias("_order"), *columns).repartitionByRange("_order").sortWithinPartitions("_order").mapInArrow(run, SCHEMA)


def constant_parts(spark: SparkSession, values: dict[str, np.ndarray], file: str) -> DataFrame:
    return spark.createDataFrame([(f"{file}/{n}", 0, bytearray(v.tobytes())) for n, v in values.items()], SCHEMA)


def _lines_of(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, part = TaskContext.get().partitionId() << 32, [], 0, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at + part], pa.int64()), pa.array(["\n".join([*held, ""]).encode()], pa.binary())], ["file", "part", "data"])

        for b in batches:
            for line in b.column("text").to_pylist():
                held.append(line)
                size += len(line)
                if size >= LINES:
                    yield batch()
                    held, size, part = [], 0, part + 1
        if held:
            yield batch()

    return run


def write_lines(rows: DataFrame, order: str, text: str, folder: str, file: str) -> None:
    """The column ``text`` of rows in ``order`` as one file of lines. Rows never leave the executors; a failure leaves no file."""
    spark = rows.sparkSession
    ordered = rows.select(F.col(order).alias("_order"), F.col(text).alias("text")).repartitionByRange("_order").sortWithinPartitions("_order").select("text")
    hidden = write_parts(ordered.mapInArrow(_lines_of(file), SCHEMA), folder)
    if file not in join_parts(spark, folder, hidden):
        from stratafuse.sources.texts import write_text

        write_text(f"{folder}/{file}", "")  # no rows: an empty file
