"""Exchange layouts: sessions, prediction caches and fusion outputs as JSON, JSON lines and NPZ files.

Parquet is the storage of this package; these readers and writers take and give the plain files
that other tools use. Arrays of a frame are written and read by executors, a file a frame; records
are checked by their contracts as they are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import checks as K
from stratafuse.operators import records as R
from stratafuse.operators import windows as W
from stratafuse.sources import parts as P
from stratafuse.sources import texts as X
from stratafuse.session import discard, stored

#: Arrays of a frame's depth file.
DEPTH_KEYS = ("depth_m", "depth_sigma_m", "confidence", "object_mask", "object_id")
PIXELS = "frame_id long, v int, u int, depth_m float, depth_sigma_m float, confidence float, object_mask boolean, object_id int"
CONVENTION = {"units": "meters", "camera_frame": R.CAMERA_FRAME, "transform": "T_world_camera maps camera points into world"}


def is_exchange(folder: str) -> bool:
    """Whether a folder has its metadata in one JSON file."""
    fs, at = X.open_fs(f"{folder}/metadata.json")
    return fs.get_file_info(at).type == pafs.FileType.File


def _lines(spark: SparkSession, path: str, record: R.Record, key: str) -> DataFrame:
    """The records of a file of JSON lines, checked; blank lines are left out."""
    X.read_bytes(path) if not X.open_fs(path)[0].get_file_info(X.open_fs(path)[1]).is_file else None
    rows = spark.read.text(path).where(F.trim("value") != "")
    found = R.decode(rows, "value", record)
    try:
        K.require(found.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("null"))), "_key", record.checks())
    except K.ConstraintError as e:
        raise ValueError(f"{path}: {e}") from e
    return found.drop("missing", "ragged", "unread")


def _write_lines(df: DataFrame, record: R.Record, order: str, path: str) -> None:
    """One file in order, put together from parts that tasks write."""
    folder, _, name = path.rpartition("/")
    P.write_lines(df.select(order, R.encode(record).alias("_line")), order, "_line", folder, name)


# ---------------------------------------------------------------- sessions


def write_session(spark: SparkSession, session: dict, folder: str) -> None:
    """Write a session's tables (as :func:`stratafuse.plans.artifacts.load_session` gives them) in the exchange layout."""
    meta = dict(session["metadata"])
    out = {k: meta.get(k) for k in ("session_type", "unit_scale", "scale_source", "camera_metadata_source", "voxel_size_m", "accuracy_report_path", "warnings")}
    out |= {"model_checkpoint_hash": None, "frame_count": meta["n_frames"], "object_count": meta["n_objects"], "mesh_chunk_count": meta["n_chunks"], "coordinate_convention": {"camera_frame": {"x": "right", "y": "down", "z": "forward"}, "world_units": "meters", "transform_rule": "T_A_B maps homogeneous points from frame B into frame A"}}
    frames = session["frames"]
    _write_lines(frames, R.POSE, "frame_id", f"{folder}/poses.jsonl")
    _write_lines(frames.withColumn("confidence", F.col("camera_confidence")), R.CAMERA, "frame_id", f"{folder}/cameras.jsonl")
    _write_lines(session["objects"], R.OBJECT, "object_id", f"{folder}/objects.jsonl")
    chunks = session["mesh_chunks"].select("chunk_id", "version", F.format_string("chunk_%s_v%d.json", "chunk_id", "version").alias("metadata_path"), R.encode(R.MESH).alias("text"))
    P.join_parts(spark, folder, P.write_parts(chunks.mapInArrow(_chunk_files, P.SCHEMA), folder))
    index = [r.asDict() for r in chunks.select("chunk_id", "version", "metadata_path").orderBy("chunk_id").toLocalIterator()]  # a name a chunk
    X.write_json(f"{folder}/mesh_chunks/index.json", {"mesh_chunks": index})
    n = session["depth"].groupBy("frame_id").applyInPandas(_depth_writer(folder), "frame_id long").count()
    X.write_json(f"{folder}/logs/runtime_profile.json", {"scene": out["session_type"], "runtime_capture": False, "neural_models": False, "frame_count": n})
    X.write_json(f"{folder}/metadata.json", out)


def _chunk_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The file of each mesh chunk: one deterministic JSON object."""
    for b in batches:
        names = [f"mesh_chunks/{n}" for n in b.column("metadata_path").to_pylist()]
        data = [(json.dumps(json.loads(t), indent=2, sort_keys=True) + "\n").encode() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array(data, pa.binary())], ["file", "part", "data"])


def _image(px: pd.DataFrame, column: str, dtype: str) -> np.ndarray:
    """A column of one frame's pixels as an image."""
    shape = int(px["v"].max()) + 1, int(px["u"].max()) + 1
    out = np.zeros(shape, dtype)
    out[px["v"], px["u"]] = px[column]
    return out


def _depth_writer(folder: str):
    kinds = dict(zip(DEPTH_KEYS, ("float32", "float32", "float32", "bool", "int32"), strict=True))

    def run(px: pd.DataFrame) -> pd.DataFrame:
        frame = int(px["frame_id"].iloc[0])
        X.write_npz(f"{folder}/depth/frame_{frame:06d}.npz", **{k: _image(px, k, d) for k, d in kinds.items()})
        return pd.DataFrame({"frame_id": [frame]})

    return run


def read_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of all frame_<id>.npz files, which need the arrays DEPTH_KEYS of one shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = p.rpartition("/")[2]
                if not (name.startswith("frame_") and name[6:-4].isdigit()):
                    raise ValueError(f"{p}: not a frame_<id>.npz name")
                z = X.read_npz(c, p)
                lacking = [k for k in DEPTH_KEYS if k not in z]
                if lacking:
                    raise ValueError(f"{p}: has no array {', '.join(lacking)}")
                if len({z[k].shape for k in DEPTH_KEYS}) > 1 or z["depth_m"].ndim != 2:
                    raise ValueError(f"{p}: arrays must be images of one shape")
                v, u = np.divmod(np.arange(z["depth_m"].size), z["depth_m"].shape[1])
                cols = [np.full(v.size, int(name[6:-4])), v.astype(np.int32), u.astype(np.int32), *[z[k].ravel().astype(d) for k, d in zip(DEPTH_KEYS, ("f4", "f4", "f4", "?", "i4"), strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [f.split()[0] for f in PIXELS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "frame_*.npz").load(folder).select("path", "content").mapInArrow(run, PIXELS)


def read_session(spark: SparkSession, folder: str) -> dict:
    """Tables of a session in the exchange layout, as those of a Parquet session; every record is checked."""
    meta = X.read_json(f"{folder}/metadata.json")
    poses = _lines(spark, f"{folder}/poses.jsonl", R.POSE, "frame_id")
    cameras = _lines(spark, f"{folder}/cameras.jsonl", R.CAMERA, "frame_id").withColumnRenamed("confidence", "camera_confidence").drop("timestamp_ns")
    if poses.count() != cameras.count():
        raise ValueError(f"{folder}: poses.jsonl and cameras.jsonl differ in length")
    frames = poses.join(cameras, "frame_id").withColumns({c: F.col("camera_center_world_m")[i] for i, c in enumerate(("ox", "oy", "oz"))})
    objects = _lines(spark, f"{folder}/objects.jsonl", R.OBJECT, "object_id")
    index = X.read_json(f"{folder}/mesh_chunks/index.json").get("mesh_chunks")
    if not isinstance(index, list) or any(not isinstance(i, dict) or not i.get("metadata_path") for i in index):
        raise ValueError(f"{folder}/mesh_chunks/index.json: mesh_chunks must be a list of objects with metadata_path")
    chunks = spark.createDataFrame([(json.dumps(X.read_json(f"{folder}/mesh_chunks/{i['metadata_path']}")), i.get("chunk_id"), i.get("version")) for i in index], "text string, want_id string, want_version long")
    found = R.decode(chunks, "text", R.MESH, "want_id", "want_version")
    same = {"chunk_id_of_index": F.coalesce(F.col("want_id"), F.col("chunk_id")) == F.col("chunk_id"), "version_of_index": F.coalesce(F.col("want_version"), F.col("version")) == F.col("version")}
    K.require(found.withColumn("_key", F.coalesce("chunk_id", F.lit("null"))), "_key", R.MESH.checks() | same)
    found = found.drop("missing", "ragged", "unread", "want_id", "want_version")
    depth = read_depth(spark, f"{folder}/depth")
    size = frames.select("width", "height").first()
    counts = {a: meta[b] for a, b in (("n_frames", "frame_count"), ("n_objects", "object_count"), ("n_chunks", "mesh_chunk_count")) if b in meta}
    header = meta | {"n_frames": frames.count(), "n_objects": objects.count(), "n_chunks": len(index)} | counts | {"coordinate_frame": "synthetic_world" if meta.get("session_type") == "synthetic_cube_room" else "world"} | ({"width": size["width"], "height": size["height"]} if size else {})
    return {"metadata": header, "frames": frames, "depth": depth, "objects": objects, "mesh_chunks": found, "mesh_vertices": mesh_vertices(found), "mesh_faces": mesh_faces(found)}


def mesh_vertices(chunks: DataFrame) -> DataFrame:
    """vertex_id, x, y, z of mesh records; ids count through the chunks in the order of their names."""
    rows = chunks.select("chunk_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("size(vertices_m) div 3") - 1), lambda i: F.slice("vertices_m", i * 3 + 1, 3))).alias("i", "p"))
    return rows.join(F.broadcast(_first_ids(chunks)), "chunk_id").select((F.col("first") + F.col("i")).cast("int").alias("vertex_id"), *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])


def mesh_faces(chunks: DataFrame) -> DataFrame:
    """face_id, a, b, c, object_id of mesh records, with the ids of :func:`mesh_vertices`."""
    rows = chunks.select("chunk_id", "object_id_per_face", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("size(faces) div 3") - 1), lambda i: F.slice("faces", i * 3 + 1, 3))).alias("i", "f"))
    rows = rows.join(F.broadcast(_first_ids(chunks)), "chunk_id")
    return rows.select((F.col("first_face") + F.col("i")).cast("int").alias("face_id"), *[(F.col("f")[i] + F.col("first")).cast("int").alias(c) for i, c in enumerate("abc")], F.get("object_id_per_face", F.col("i")).cast("int").alias("object_id"))


def _first_ids(chunks: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    sizes = chunks.select("chunk_id", F.expr("size(vertices_m) div 3").alias("n"), F.expr("size(faces) div 3").alias("m"))
    return sizes.select("chunk_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("first_face"))


# ---------------------------------------------------------------- prediction caches


def predictions(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels with what a cache stores of each: depth_m, depth_sigma_m, confidence, static_mask, world points (x, y, z),
    camera normals (nx, ny, nz) and, if there is an object_id, object_mask_logits (1 for objects)."""
    rows = frames.select("frame_id", "width", "height", "K", "T_world_camera")
    images = pixels.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("v", "u", "depth_m"))).alias("_px"))
    first = rows.first()
    k = first["K"] if first else [1.0] * 9
    if not rows.where(~(F.col("K") == F.array(*map(F.lit, k))) | (F.col("width") != first["width"])).isEmpty():
        raise ValueError("K: predictions are made for one camera at a time")
    normals = W.frame_normals(images.select("frame_id", F.col("_px.depth_m").alias("depth")), int(first["width"]), int(first["height"]), k[0], k[4], k[2], k[5])
    both = pixels.join(normals, ["frame_id", "v", "u"]).join(F.broadcast(rows), "frame_id")
    p = G.unproject_pixels(F.col("u").cast("double"), F.col("v").cast("double"), F.col("depth_m").cast("double"), G.mat("K"))
    world = G.transform_points(G.rotation_of("T_world_camera"), G.camera_center("T_world_camera"), p)
    both = both.withColumns({c: x.cast("float") for c, x in zip("xyz", world, strict=True)} | {"static_mask": F.lit(True)} | {f"n{c}": F.col(f"n{c}").cast("float") for c in "xyz"})
    if "object_id" in pixels.columns:
        both = both.withColumn("object_mask_logits", (F.col("object_id") > 0).cast("float"))
    return both.drop("width", "height", "K", "T_world_camera")


_FLAT = {"depth_m": "float32", "depth_sigma_m": "float32", "confidence": "float32", "static_mask": "bool"}
_DEEP = {"normal_camera": ("nx", "ny", "nz"), "point_world": ("x", "y", "z")}


def _payload(px: pd.DataFrame) -> dict[str, np.ndarray]:
    out = {k: _image(px, k, d) for k, d in _FLAT.items()}
    out |= {k: np.stack([_image(px, c, "float32") for c in names], -1) for k, names in _DEEP.items()}
    if "object_mask_logits" in px.columns:
        out["object_mask_logits"] = _image(px, "object_mask_logits", "float32")[..., None]
    for k, a in out.items():
        if a.dtype != bool and not np.isfinite(a).all():
            raise ValueError(f"{k}: values must be finite")
    if (out["depth_m"] < 0).any() or (out["depth_sigma_m"] < 0).any() or (out["confidence"] < 0).any() or (out["confidence"] > 1).any():
        raise ValueError("payload: depth and sigma must not be negative, confidence must be a share")
    return out


def _stats(a: np.ndarray) -> dict:
    x = a.astype(np.float64).ravel()
    some = {"min": float(x.min()), "mean": float(x.mean()), "p50": float(np.percentile(x, 50)), "p95": float(np.percentile(x, 95)), "max": float(x.max())} if x.size else dict.fromkeys(("min", "mean", "p50", "p95", "max"))
    return {"shape": list(a.shape), "dtype": str(a.dtype), "count": int(x.size), **some}


def _summary_writer(folder: str, arrays: bool):
    """Pixels of a frame, with its camera and pose as JSON, into one summary (and its arrays into a file)."""

    def run(px: pd.DataFrame) -> pd.DataFrame:
        frame = int(px["frame_id"].iloc[0])
        head, out = json.loads(px["head"].iloc[0]), _payload(px)
        path = f"arrays/frame_{frame:06d}.npz" if arrays else None
        if path:
            X.write_npz(f"{folder}/{path}", **out)
        shapes = {k: {"shape": list(out[k].shape), "dtype": str(out[k].dtype)} if k in out else None for k in (*K.ARRAY_KEYS, *R.OPTIONAL_ARRAYS)}
        record = head | {"confidence_summary": _stats(out["confidence"]), "uncertainty_summary": _stats(out["depth_sigma_m"]), "depth_summary": _stats(out["depth_m"]), "tensor_shapes": shapes, "dense_matches": None, "arrays_path": path}
        return pd.DataFrame({"frame_id": [frame], "text": [json.dumps(record, sort_keys=True, separators=(",", ":"))]})

    return run


def _head(coordinate_frame: str):
    """Camera and pose of a frame as the JSON of its summary."""
    nested = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(c, i * n + 1, n))
    camera = F.struct("width", "height", nested("K", 3).alias("K"), "distortion_model", "distortion_params", "rolling_shutter_row_time_s", F.col("camera_confidence").alias("confidence"), "source")
    std = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.sqrt(F.greatest(F.element_at("covariance_6x6", i * 7 + 1), F.lit(0.0))))
    spread = F.struct(F.col("covariance_6x6").isNotNull().alias("covariance_6x6_present"), F.slice(std, 1, 3).alias("translation_std_m"), F.slice(std, 4, 3).alias("rotation_std"), F.array_max(std).alias("max_std"))
    pose = F.struct(nested("T_world_camera", 4).alias("T_world_camera"), "q_world_camera_xyzw", "camera_center_world_m", nested("covariance_6x6", 6).alias("covariance_6x6"), "tracking_state", "confidence", "scale_source", F.col("covariance_6x6").isNotNull().alias("has_covariance_6x6"), spread.alias("uncertainty"), F.parse_json("diagnostics").alias("diagnostics"))
    return F.to_json(F.struct("frame_id", "timestamp_ns", F.lit(coordinate_frame).alias("coordinate_frame"), "scale_source", camera.alias("camera"), pose.alias("pose")), {"ignoreNullFields": "false"})


def write_cache(spark: SparkSession, frames: DataFrame, pixels: DataFrame, folder: str, adapter: dict, prediction: dict, arrays: bool = True) -> None:
    """A prediction cache in the exchange layout: frames with all camera and pose fields, pixels (frame_id, v, u, depth_m,
    depth_sigma_m, confidence, and object_id if known), the adapter's status record and the prediction's metadata."""
    where = str(prediction.get("coordinate_frame", "world"))
    heads = frames.select("frame_id", _head(where).alias("head"))
    rows = predictions(frames, pixels).join(F.broadcast(heads), "frame_id").groupBy("frame_id").applyInPandas(_summary_writer(folder, arrays), "frame_id long, text string")
    rows = stored(rows)
    P.write_lines(rows, "frame_id", "text", folder, "frame_summaries.jsonl")
    ids = [r[0] for r in rows.select("frame_id").orderBy("frame_id").toLocalIterator()]  # the header names every id
    discard(rows)
    scales = sorted(r[0] for r in frames.select("scale_source").distinct().collect())
    keys = [*K.ARRAY_KEYS, *R.OPTIONAL_ARRAYS]
    X.write_json(f"{folder}/metadata.json", {"format_name": "teacher_prediction_cache", "format_version": 1, "adapter": adapter, "prediction_metadata": prediction, "coordinate_frame": where, "coordinate_convention": CONVENTION, "frame_count": len(ids), "frame_ids": ids, "scale_sources": scales, "frame_summaries_path": "frame_summaries.jsonl", "arrays": {"stored": arrays, "directory": "arrays" if arrays else None, "optional_npz_keys": keys}})
    read_cache(spark, folder)


def read_cache(spark: SparkSession, folder: str) -> dict:
    """metadata, frames, frame_summaries and, if stored, arrays (pixels) of a cache in the exchange layout.

    Header and summaries are checked by their contracts, ids and coordinate frames against each
    other, and every payload against the shapes and types that its summary states."""
    path = f"{folder}/metadata.json"
    meta = X.read_json(path)
    if not str(meta.get("format_name", "")).endswith("teacher_prediction_cache") or meta.get("format_version") != 1:
        raise ValueError(f"{path}: format_name or format_version is not that of a prediction cache")
    header = spark.createDataFrame([(json.dumps(meta), json.dumps(meta.get("adapter")))], "text string, adapter string")
    for column, record in (("text", R.CACHE), ("adapter", R.ADAPTER)):
        K.require(R.decode(header, column, record).withColumn("_key", F.lit(path)), "_key", record.checks())
    summaries = _lines(spark, f"{folder}/{meta['frame_summaries_path']}", R.FRAME_SUMMARY, "frame_id")
    ids = [r[0] for r in summaries.select("frame_id").orderBy("frame_id").collect()]  # an id a frame
    if ids != meta["frame_ids"]:
        raise ValueError(f"{path}: frame_ids are not those of the summaries")
    stored = meta["arrays"]["stored"]
    odd = summaries.where((F.col("coordinate_frame") != meta["coordinate_frame"]) | (F.col("arrays_path").isNotNull() != F.lit(stored))).select("frame_id").take(1)
    if odd:
        raise ValueError(f"{path}: frame_id {odd[0][0]} has another coordinate_frame, or an arrays_path where arrays are {'' if stored else 'not '}stored")
    flat = lambda c: F.flatten(c)
    frames = summaries.select("frame_id", "timestamp_ns", "scale_source", F.col("camera.width").alias("width"), F.col("camera.height").alias("height"), flat("camera.K").alias("K"), flat("pose.T_world_camera").alias("T_world_camera"), F.col("pose.camera_center_world_m").alias("camera_center_world_m"))
    frames = frames.withColumns({c: F.col("T_world_camera")[4 * i + 3] for i, c in enumerate(("ox", "oy", "oz"))})
    size = frames.select("width", "height").distinct().limit(2).collect()
    out = {"metadata": {"n_frames": len(ids), "arrays_stored": stored, "scale_sources": meta["scale_sources"], "width": size[0]["width"], "height": size[0]["height"], "coordinate_frame": meta["coordinate_frame"], "adapter": meta["adapter"]["name"], **{k: meta.get("prediction_metadata", {}).get(k) for k in ("fixture", "fixture_session_type")}, "exchange": meta}, "frames": frames, "summaries": summaries}
    stats = lambda c: F.struct(F.col(f"{c}.count").alias("n"), *[F.col(f"{c}.{k}").alias(k) for k in ("min", "mean", "p50", "p95", "max")])
    out["frame_summaries"] = summaries.select("frame_id", stats("depth_summary").alias("depth_m"), stats("uncertainty_summary").alias("depth_sigma_m"), stats("confidence_summary").alias("confidence"))
    if stored:
        out["arrays"] = read_payloads(spark, folder, summaries)
    return out


PAYLOAD = "frame_id long, v int, u int, depth_m float, depth_sigma_m float, confidence float, static_mask float, x float, y float, z float, nx float, ny float, nz float"


def read_payloads(spark: SparkSession, folder: str, summaries: DataFrame) -> DataFrame:
    """Pixels of the payloads that summaries name; a file that lacks an array, has an unknown one, or
    another shape, type or range than its summary states fails the read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, path, shapes in zip(b["frame_id"], b["arrays_path"], b["shapes"], strict=True):
                at = f"{folder}/{path}"
                z = X.read_npz(X.read_bytes(at), at)
                want = {k: s for k, s in json.loads(shapes).items() if s is not None}
                unknown = set(z) - {*K.ARRAY_KEYS, *R.OPTIONAL_ARRAYS}
                if unknown or set(z) != set(want):
                    raise ValueError(f"{at}: arrays {', '.join(sorted(set(z) ^ set(want)))} are unknown, missing or not in the summary")
                for k, s in want.items():
                    if list(z[k].shape) != s["shape"] or str(z[k].dtype) != s["dtype"]:
                        raise ValueError(f"{at}: {k} is {z[k].shape} {z[k].dtype}, its summary says {s['shape']} {s['dtype']}")
                    if z[k].dtype == bool and k != "static_mask" or z[k].dtype != bool and not np.isfinite(z[k]).all():
                        raise ValueError(f"{at}: {k} must be finite numbers")
                bad = [k for k in ("depth_m", "depth_sigma_m", "confidence", "static_mask") if (z[k] < 0).any() or (k in ("confidence", "static_mask") and (z[k] > 1).any())]
                if bad:
                    raise ValueError(f"{at}: {', '.join(bad)} out of range")
                h, w = z["depth_m"].shape
                v, u = np.divmod(np.arange(h * w), w)
                cols = {"frame_id": np.full(h * w, frame), "v": v.astype(np.int32), "u": u.astype(np.int32), **{k: z[k].ravel().astype(np.float32) for k in _FLAT}}
                yield pd.DataFrame(cols | {c: z[k][..., i].ravel() for k, names in (("point_world", "xyz"), ("normal_camera", ("nx", "ny", "nz"))) for i, c in enumerate(names)})

    rows = summaries.select("frame_id", "arrays_path", F.to_json("tensor_shapes").alias("shapes"))
    return rows.repartition(max(1, min(rows.count(), 10_000)), "frame_id").mapInPandas(run, PAYLOAD)


# ---------------------------------------------------------------- fusion outputs


def write_fusion(spark: SparkSession, output: str, folder: str) -> list[str]:
    """A fusion output (Parquet, see :func:`stratafuse.plans.artifacts.replay_cache`) as tsdf_grid.npz, surface_points.npz,
    metadata.json, metrics.json and the sidecars that it has. Layers of the grid and ranges of the surface are written by tasks."""
    from stratafuse.plans import artifacts as A

    meta = A.read_record(spark, f"{output}/metadata", "fusion_output")
    low, high, voxel = meta["grid_min_corner_m"], meta["grid_max_corner_m"], meta["voxel_size_m"]
    shape = G.grid_shape(low, high, voxel)
    header = {"grid_min_corner_world_m": np.array(low, np.float32), "voxel_size_m": np.float32(voxel), "truncation_distance_m": np.float32(meta.get("truncation_m", 3 * voxel))}
    surface = spark.read.parquet(f"{output}/surface")
    n = surface.count()
    columns = {"points_world_m": ("<f4", ["x", "y", "z"]), "confidence": ("<f4", ["confidence"]), "uncertainty_m": ("<f4", ["uncertainty_m"]), "voxel_indices_xyz": ("<i4", ["ix", "iy", "iz"])}
    parts = P.constant_parts(spark, {k: np.asarray(v) for k, v in header.items()}, "tsdf_grid.npz").unionByName(P.grid_parts(spark.read.parquet(f"{output}/voxels"), shape, {"tsdf": 1.0, "weight": 0.0}, "tsdf_grid.npz"))
    parts = parts.unionByName(P.row_parts(surface, "sample_id", columns, "surface_points.npz"))
    arrays = {"tsdf_grid.npz": [*((k, "<f4", np.shape(v)) for k, v in header.items()), *((k, "<f4", tuple(shape)) for k in ("tsdf", "weight"))], "surface_points.npz": [(k, kind, (n, 3) if len(c) == 3 else (n,)) for k, (kind, c) in columns.items()]}
    P.join_parts(spark, folder, P.write_parts(parts, folder), arrays)
    X.write_json(f"{folder}/metadata.json", meta)
    X.write_json(f"{folder}/metrics.json", A.read_record(spark, f"{output}/metrics"))
    written = ["tsdf_grid.npz", "surface_points.npz", "metadata.json", "metrics.json"]
    for name, kind, file, key, record, rows in (("mesh/metadata", "mesh_sidecar", "mesh_chunk_sidecar.json", "mesh_chunk", R.MESH, A.mesh_chunk), ("world_map", "world_map", "world_map_sidecar.json", "world_map", R.WORLD_MAP, A.world_map)):
        if A.has_record(spark, f"{output}/{name}"):
            text = rows(spark, output).select(R.encode(record).alias("text"))
            K.require(R.decode(text, "text", record).withColumn("_key", F.lit(file)), "_key", record.checks())
            X.write_json(f"{folder}/{file}", {"format_name": kind, "format_version": 1, key: json.loads(text.first()[0]), "metadata": A.read_record(spark, f"{output}/{name}", kind)})
            written.append(file)
    return written


def read_sidecar(spark: SparkSession, path: str, key: str = "mesh_chunk") -> DataFrame:
    """The checked record of a sidecar file: ``key`` is mesh_chunk or world_map."""
    whole = X.read_json(path)
    if not str(whole.get("format_name", "")).endswith("sidecar") and whole.get("format_name") != key or whole.get("format_version") != 1 or not isinstance(whole.get(key), dict):
        raise ValueError(f"{path}: format_name, format_version or {key} is not that of a sidecar")
    record = {"mesh_chunk": R.MESH, "world_map": R.WORLD_MAP}[key]
    found = R.decode(spark.createDataFrame([(json.dumps(whole[key]),)], "text string"), "text", record)
    try:
        K.require(found.withColumn("_key", F.lit(path)), "_key", record.checks())
        if key == "mesh_chunk":
            K.require(found.withColumn("_key", F.lit(path)), "_key", {"flags": K.mesh_truth_flags("flags")})
    except K.ConstraintError as e:
        raise ValueError(f"{path}: {e}") from e
    return found.drop("missing", "ragged", "unread")


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, ix, iy, iz, x, y, z, confidence, uncertainty_m of a surface_points.npz."""
    z = X.read_npz(X.read_bytes(path), path)
    lacking = [k for k in ("points_world_m", "confidence", "uncertainty_m", "voxel_indices_xyz") if k not in z]
    if lacking:
        raise ValueError(f"{path}: has no array {', '.join(lacking)}")
    p, n = z["points_world_m"], len(z["confidence"])
    if p.shape != (n, 3) or z["voxel_indices_xyz"].shape != (n, 3) or z["uncertainty_m"].shape != (n,) or n == 0:
        raise ValueError(f"{path}: arrays must hold one row a sample, and one sample at least")
    if not all(np.isfinite(z[k]).all() for k in ("points_world_m", "confidence", "uncertainty_m")) or (z["uncertainty_m"] < 0).any() or (z["confidence"] < 0).any() or (z["confidence"] > 1).any():
        raise ValueError(f"{path}: values must be finite, confidence a share and uncertainty not negative")
    cols = {"sample_id": np.arange(n), **{c: z["voxel_indices_xyz"][:, i].astype(np.int32) for i, c in enumerate(("ix", "iy", "iz"))}, **{c: p[:, i].astype(float) for i, c in enumerate("xyz")}, "confidence": z["confidence"].astype(float), "uncertainty_m": z["uncertainty_m"].astype(float)}
    return spark.createDataFrame(pd.DataFrame(cols), "sample_id long, ix int, iy int, iz int, x double, y double, z double, confidence double, uncertainty_m double")


# ---------------------------------------------------------------- event logs


def write_events(log: DataFrame, path: str, bound: int, paths: dict[str, str] | None = None) -> None:
    """An event log (as :func:`stratafuse.operators.windows.record_events` makes it, with stage and frame_id) as JSON lines in order."""
    counters = F.struct(F.lit(bound).cast("long").alias("configured_frame_array_bound"), F.col("frames_in_memory").cast("long").alias("frame_arrays_in_memory"), F.col("peak_in_memory").cast("long").alias("peak_frame_arrays_in_memory"), (F.col("event_index") + 1).alias("processed_frame_count"), F.col("dropped_total").alias("dropped_frame_count"), F.lit(0).cast("long").alias("queued_frame_count"))
    named = F.create_map(*[F.lit(x) for kv in (paths or {}).items() for x in kv]) if paths else F.lit(None).cast("map<string,string>")
    rows = log.select("event_index", F.col("stage").alias("stage_name"), "frame_id", "timestamp_ns", F.lit(0).cast("long").alias("latency_ns"), F.lit(False).alias("dropped_frame"), counters.alias("memory_counters"), F.coalesce(named, F.create_map().cast("map<string,string>")).alias("paths"), F.lit("{}").alias("metadata"), F.lit("runtime_event").alias("format_name"), F.lit(1).cast("long").alias("format_version"))
    _write_lines(rows, R.EVENT, "event_index", path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log in JSON lines, checked; indices must be dense from 0."""
    out = _lines(spark, path, R.EVENT, "event_index")
    n, low, high, kinds = out.agg(F.count("*"), F.min("event_index"), F.max("event_index"), F.countDistinct("event_index")).first()
    if n and (low, high, kinds) != (0, n - 1, n):
        raise ValueError(f"{path}: event_index is not dense from 0")
    return out
