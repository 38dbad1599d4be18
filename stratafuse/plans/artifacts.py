"""Folders of a run: session, prediction cache, fusion outputs, sidecars, event log.

Every table is Parquet below its folder; headers are one JSON record written through Spark,
so any shared file system works. Loaders validate what they read.
"""

from __future__ import annotations

import json
from dataclasses import replace
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.operators import checks as K
from stratafuse.operators import fusion as U
from stratafuse.operators import records as R
from stratafuse.operators import scenes as S
from stratafuse.operators import summaries as M
from stratafuse.operators import windows as W
from stratafuse.sources import folders

VERSION = 1
SUMMARIES = ("depth_m", "depth_sigma_m", "confidence")
MAX_SAMPLES = 2048
#: What the metadata of a cache must say to prove that it is of the fixed room.
FIXTURE = {"adapter": "fixture-cube-room", "fixture": True, "fixture_session_type": "synthetic_cube_room", "coordinate_frame": "synthetic_world"}


#: What the metadata of a written session says besides its counts.
SESSION_NOTES = {"unit_scale": "meters", "camera_metadata_source": "synthetic_fixture", "voxel_size_m": 0.05, "accuracy_report_path": None, "warnings": ["Synthetic analytic ground truth only; no neural model or capture was run."]}


class ArtifactError(ValueError):
    """A folder that doesn't hold what it claims, as "<path>: <message>"."""


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A deterministic JSON object (sorted keys)."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str, kind: str | None = None) -> dict:
    rows = spark.read.text(path, wholetext=True).where("length(value) > 0").collect()
    try:
        record = json.loads(rows[0][0])
    except (IndexError, ValueError) as e:
        raise ArtifactError(f"{path}: not a JSON record") from e
    if kind and (record.get("format_name"), record.get("format_version")) != (kind, VERSION):
        raise ArtifactError(f"{path}: format_name or format_version is not {kind} {VERSION}")
    return record


def has_record(spark: SparkSession, path: str) -> bool:
    """Whether a record was written there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- sessions


def write_session(spark: SparkSession, folder: str, frames: DataFrame | None = None, scene: S.Scene = S.ROOM) -> None:
    """frames (camera and pose of each), depth (partitioned by frame), mesh_chunks, mesh_vertices, mesh_faces, objects and metadata."""
    frames = S.with_cameras(S.fixed_frames(spark) if frames is None else frames, scene)
    frames.write.mode("overwrite").parquet(f"{folder}/frames")
    frames = _load(spark, f"{folder}/frames")
    S.render_pixels(frames.select("frame_id", "ox", "oy", "oz"), scene).select("frame_id", "v", "u", "depth_m", "depth_sigma_m", "confidence", "object_mask", "object_id").write.mode("overwrite").partitionBy("frame_id").parquet(f"{folder}/depth")
    vertices, faces = S.scene_mesh(spark, scene)
    vertices.write.mode("overwrite").parquet(f"{folder}/mesh_vertices")
    faces.write.mode("overwrite").parquet(f"{folder}/mesh_faces")
    S.mesh_chunk(vertices, faces, frames).write.mode("overwrite").parquet(f"{folder}/mesh_chunks")
    S.box_object(frames, scene).write.mode("overwrite").parquet(f"{folder}/objects")
    counts = {"n_frames": frames.count(), "n_objects": 1, "n_chunks": 1, "n_vertices": vertices.count(), "n_faces": faces.count()}
    write_record(spark, f"{folder}/metadata", SESSION_NOTES | counts | {"format_name": "session", "format_version": VERSION, "width": scene.width, "height": scene.height, "scale_source": "known_anchor", "session_type": FIXTURE["fixture_session_type"] if scene == S.ROOM else "synthetic_scene", "coordinate_frame": FIXTURE["coordinate_frame"]})


def load_session(spark: SparkSession, folder: str) -> dict:
    """Tables of a session by name, with metadata; counts must equal those of the metadata. A folder in
    the exchange layout (:mod:`stratafuse.sources.folders`) is read as one."""
    if folders.is_exchange(folder):
        out = folders.read_session(spark, folder)
    else:
        out = {"metadata": read_record(spark, f"{folder}/metadata", "session")}
        for name in ("frames", "depth", "mesh_chunks", "mesh_vertices", "mesh_faces", "objects"):
            out[name] = _load(spark, f"{folder}/{name}")
    return check_session(out, folder)


def check_session(out: dict, folder: str) -> dict:
    """A session's counts, the frames of its depth and the vertices of its faces; ArtifactError or the session."""
    for name, field in (("frames", "n_frames"), ("objects", "n_objects"), ("mesh_chunks", "n_chunks"), ("mesh_vertices", "n_vertices"), ("mesh_faces", "n_faces")):
        if field in out["metadata"] and out[name].count() != out["metadata"][field]:
            raise ArtifactError(f"{folder}: {name} has not {out['metadata'][field]} rows")
    if out["frames"].isEmpty():
        raise ArtifactError(f"{folder}: has no frame")
    a, b = (out[n].select("frame_id").distinct().withColumn(n, F.lit(True)) for n in ("frames", "depth"))
    if not a.join(b, "frame_id", "full").where("frames is null or depth is null").isEmpty():
        raise ArtifactError(f"{folder}: depth and frames have different frame_ids")
    if not K.face_violations(out["mesh_faces"], out["mesh_vertices"]).isEmpty():
        raise ArtifactError(f"{folder}: a face names no vertex")
    return out


# ---------------------------------------------------------------- adapters and prediction caches

# Adapters by name, with their display names, the modules that they need (None: runs as it is) and what they predict.
ADAPTERS = {
    "fixture-cube-room": ("Synthetic Cube-Room Fixture Teacher", None, ("predicts_camera", "predicts_pose", "predicts_depth", "predicts_normals", "predicts_points", "predicts_objects", "supports_batch")),
    "vggt": ("VGGT", ("vggt",), ("predicts_camera", "predicts_pose", "predicts_depth", "predicts_points", "predicts_dense_matches", "supports_batch")),
    "depth-pro": ("Depth Pro", ("depth_pro",), ("predicts_camera", "predicts_depth", "supports_batch")),
}


def adapter_record(name: str) -> dict:
    """The status of an adapter: one that needs modules is unavailable without them, and a stub with them."""
    if name not in ADAPTERS:
        raise KeyError(f"name: {name} is not one of {', '.join(ADAPTERS)}")
    display, modules, can = ADAPTERS[name]
    lacking = [m for m in modules or () if find_spec(m) is None]
    state, reason = ("available", "Fixture adapter only; not a model.") if modules is None else ("unavailable", f"missing optional dependency: {', '.join(lacking)}") if lacking else ("stub-only", "dependency found; inference is not implemented")
    return {"name": name, "display_name": display, "availability": state, "capabilities": {c: c in can for c in R.CAPABILITIES} | {"notes": []}, "install_hint": None if modules is None else f"Install {display} beside this package; models are not part of it.", "reason": reason}


def list_adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, adapter_record(n)["availability"]) for n in ADAPTERS], "name string, availability string")


def adapter_status(name: str) -> str:
    return adapter_record(name)["availability"]


def run_adapter(spark: SparkSession, name: str, session: str, cache: str, store_arrays: bool = True, score=None, wanted: list[int] | None = None) -> None:
    """Predictions of an adapter for a session, as a cache. ``wanted``: the ids that the session's frames must have, in order. ``score`` (an iterator of pandas frames to
    the same, with the pixel columns) stands in for a model; the fixture adapter passes depth through."""
    status = adapter_record(name)
    s = load_session(spark, session)
    if status["availability"] != "available" and score is None:
        raise NotImplementedError(f"name: {name} is {status['availability']}: {status['reason']}")
    if score is None and s["metadata"].get("session_type") != FIXTURE["fixture_session_type"]:
        raise ArtifactError(f"{session}: {name} needs a session of type {FIXTURE['fixture_session_type']}")
    if wanted is not None and [r[0] for r in s["frames"].select("frame_id").orderBy("frame_id").collect()] != list(wanted):  # an id a frame
        raise ArtifactError(f"{session}: its frame_ids are not those that were asked for")
    odd = s["depth"].where("object_mask <> (object_id > 0)")
    if score is None and not odd.isEmpty():
        raise ArtifactError(f"{session}: object_mask and object_id disagree")
    px = s["depth"].select("frame_id", "v", "u", "depth_m", "depth_sigma_m", "confidence", "object_id")
    if score is not None:
        px = px.mapInPandas(score, px.schema)
    source = s["metadata"] | {"adapter": name, "fixture": name == FIXTURE["adapter"] and score is None, "fixture_session_type": s["metadata"].get("session_type")}
    write_cache(spark, s["frames"], px, cache, store_arrays, source)


def _value_checks() -> dict:
    return {"depth_m": K.non_negative_scalar("depth_m"), "depth_sigma_m": K.non_negative_scalar("depth_sigma_m"), "confidence": K.confidence("confidence")}


def frame_summaries(pixels: DataFrame) -> DataFrame:
    """One row a frame: n and min, mean, p50, p95, max of depth, sigma and confidence."""
    cols = []
    for c in SUMMARIES:
        v = F.col(c).cast("double")
        cols.append(F.struct(F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max")).alias(c))
    return pixels.groupBy("frame_id").agg(*cols)


def write_cache(spark: SparkSession, frames: DataFrame, pixels: DataFrame, folder: str, store_arrays: bool, source: dict) -> None:
    """A cache of ``pixels``; frames may carry K (9 numbers) and T_world_camera (16, row-major)."""
    frames.write.mode("overwrite").parquet(f"{folder}/frames")
    if store_arrays:
        K.require(pixels, "frame_id", _value_checks()).write.mode("overwrite").partitionBy("frame_id").parquet(f"{folder}/arrays")
    frame_summaries(pixels).write.mode("overwrite").parquet(f"{folder}/frame_summaries")
    write_record(spark, f"{folder}/metadata", {"format_name": "prediction_cache", "format_version": VERSION, "n_frames": frames.count(), "arrays_stored": store_arrays, "scale_sources": sorted({source["scale_source"]}), "width": source["width"], "height": source["height"], **{k: source.get(k) for k in FIXTURE}})
    load_cache(spark, folder)


def load_cache(spark: SparkSession, folder: str) -> dict:
    """Tables of a cache; summaries, frames and payloads must agree, and recomputed means must be close.
    A folder in the exchange layout is read as one."""
    if folders.is_exchange(folder):
        return _check_cache(folders.read_cache(spark, folder), folder)
    meta = read_record(spark, f"{folder}/metadata", "prediction_cache")
    out: dict = {"metadata": meta, "frames": _load(spark, f"{folder}/frames"), "frame_summaries": _load(spark, f"{folder}/frame_summaries")}
    if meta["arrays_stored"]:
        out["arrays"] = _load(spark, f"{folder}/arrays")
    return _check_cache(out, folder)


def _check_cache(out: dict, folder: str) -> dict:
    meta, ids = out["metadata"], out["frames"].select("frame_id")
    if ids.count() != meta["n_frames"] or not K.duplicates(ids, "frame_id").isEmpty():
        raise ArtifactError(f"{folder}: frame_ids are not {meta['n_frames']} distinct ones")
    for name in ("frame_summaries", *(["arrays"] if meta["arrays_stored"] else [])):
        a, b = (t.select("frame_id").distinct().withColumn(n, F.lit(True)) for n, t in (("frames", ids), ("other", out[name])))
        if not a.join(b, "frame_id", "full").where("frames is null or other is null").isEmpty():
            raise ArtifactError(f"{folder}: {name} and frames have different frame_ids")
    if meta["arrays_stored"]:
        both = frame_summaries(out["arrays"]).alias("a").join(out["frame_summaries"].alias("b"), "frame_id")
        off = F.lit(False)
        for c in SUMMARIES:
            off = off | ~M.is_close(F.col(f"a.{c}.mean"), F.col(f"b.{c}.mean")) | (F.col(f"a.{c}.n") != meta["width"] * meta["height"])
        if not both.where(off).isEmpty():
            raise ArtifactError(f"{folder}: a payload differs from its summary")
        K.require(out["arrays"], "frame_id", _value_checks())
    return out


def frame_payload(spark: SparkSession, folder: str, frame_id: int) -> DataFrame:
    """Pixels of one frame: a partition-pruned scan, or one file of an exchange folder."""
    if folders.is_exchange(folder):
        c = folders.read_cache(spark, folder)
        one = c["summaries"].where(F.col("frame_id") == frame_id)
        if one.isEmpty() or not c["metadata"]["arrays_stored"]:
            raise ArtifactError(f"{folder}: has no frame_id {frame_id}, or stores no arrays")
        return folders.read_payloads(spark, folder, one)
    out = _load(spark, f"{folder}/arrays").where(F.col("frame_id") == frame_id)
    if out.isEmpty():
        raise ArtifactError(f"{folder}: has no frame_id {frame_id}")
    return out


# ---------------------------------------------------------------- fusion outputs


def write_fused(spark: SparkSession, samples: DataFrame, folder: str, grid: U.Grid, n_frames: int, more: dict) -> dict:
    """Voxels, surface and metadata of fused samples; ``more`` holds flags and provenance. An empty surface is an error."""
    U.integrate(samples).write.mode("overwrite").parquet(f"{folder}/voxels")
    volume = _load(spark, f"{folder}/voxels")
    W.global_rank(U.extract_surface(volume, n_frames, grid), "ix", "iy", "iz").withColumnRenamed("rank", "sample_id").write.mode("overwrite").parquet(f"{folder}/surface")
    surface = _load(spark, f"{folder}/surface")
    total = surface.count()
    if not total:
        raise ArtifactError(f"{folder}: the surface is empty")
    seen = volume.where("weight > 0").count()
    voxels = grid.shape[0] * grid.shape[1] * grid.shape[2]
    meta = {"format_name": "fusion_output", "format_version": VERSION, "n_frames": n_frames, "n_surface": total, "n_observed": seen, "n_voxels": voxels, "observed_ratio": seen / max(voxels, 1), "surface_ratio": total / max(voxels, 1), "voxel_size_m": grid.voxel, "grid_min_corner_m": list(grid.low), "grid_max_corner_m": list(grid.high), "truncation_m": grid.truncation, **more}
    for name in ("confidence", "uncertainty_m"):
        meta[name] = M.large_summary(surface, name).first().asDict()
    write_record(spark, f"{folder}/metadata", meta)
    return meta


def replay_cache(spark: SparkSession, cache: str, folder: str, grid: U.Grid | None = None, mesh: bool = False, world_map: bool = False) -> dict:
    """Fuse a cache's frames and write voxels, surface, metadata, metrics and, if wanted, sidecars.

    Without a ``grid`` the fixture's cache has the room's; any other has the padded bounds of its
    observed points. Only the fixture's surface is evaluated.
    """
    c = load_cache(spark, cache)
    if "arrays" not in c:
        raise ArtifactError(f"{cache}: stores no arrays to replay")
    camera = _camera(c, cache)
    fixture = all(c["metadata"].get(k) == v for k, v in FIXTURE.items())
    grid = grid or (U.GRID if fixture else _observed_grid(c, camera, cache))
    images = S.observations_from_pixels(c["frames"], c["arrays"])
    ids = [r[0] for r in c["frames"].select("frame_id").orderBy("frame_id").collect()]  # an id a frame
    more = {"frame_ids": ids, "coordinate_frame": c["metadata"].get("coordinate_frame"), "scale_sources": c["metadata"]["scale_sources"], "source_cache": cache, "adapter": c["metadata"].get("adapter"), "flags": list(K.TRUTH_FLAGS)}
    meta = write_fused(spark, U.voxel_samples(images, grid, camera), folder, grid, c["metadata"]["n_frames"], more)
    surface = _load(spark, f"{folder}/surface")
    if fixture:
        metrics = U.surface_against_scene(surface, grid).first().asDict() | {"metric_family": "fixture_cube_room_reference"}
    else:
        metrics = {"metric_family": "not_evaluated", "reason": "The cache's metadata doesn't prove that it is of the fixture, so there is no ground truth."}
    write_record(spark, f"{folder}/metrics", metrics | {"source_cache": cache, "accuracy_report": False})
    if mesh or world_map:
        write_mesh_sidecar(spark, folder)
    if world_map:
        write_world_map(spark, folder)
    return meta


def _camera(c: dict, path: str) -> S.Scene:
    """The size of a cache's images, with the room's camera for frames without K."""
    width, height = c["metadata"]["width"], c["metadata"]["height"]
    if "K" not in c["frames"].columns and (width, height) != (S.ROOM.width, S.ROOM.height):
        raise ArtifactError(f"{path}: frames have no K for images of {width} x {height}")
    for name, n in (("K", 9), ("T_world_camera", 16)):
        if name in c["frames"].columns and not c["frames"].where(f"not coalesce(size({name}) = {n} and forall({name}, x -> abs(x) < double('inf')), false)").isEmpty():
            raise ArtifactError(f"{path}: {name} must be {n} finite numbers in each frame")
    return replace(S.ROOM, width=width, height=height)


def _observed_grid(c: dict, camera: S.Scene, path: str) -> U.Grid:
    size = U.Grid()
    points = S.observed_points(c["arrays"].join(F.broadcast(c["frames"].select("frame_id", *[x for x in ("ox", "oy", "oz", "K", "T_world_camera") if x in c["frames"].columns])), "frame_id"), camera)
    b = U.observation_bounds(points, size.voxel, size.truncation).first()
    if b["min_x"] is None:
        raise ArtifactError(f"{path}: has no point of positive depth and confidence to derive a grid from")
    return replace(size, low=tuple(b[f"min_{x}"] for x in "xyz"), high=tuple(b[f"max_{x}"] for x in "xyz"))


def write_mesh_sidecar(spark: SparkSession, folder: str, chunk_id: str = "surface_samples", most: int = MAX_SAMPLES) -> None:
    """Marker triangles of at most ``most`` evenly spaced surface samples."""
    meta = read_record(spark, f"{folder}/metadata", "fusion_output")
    picked = W.stratified_sample(_load(spark, f"{folder}/surface").drop("sample_id"), most, "ix", "iy", "iz")
    picked.write.mode("overwrite").parquet(f"{folder}/mesh/samples")
    picked = _load(spark, f"{folder}/mesh/samples")
    mean, p95 = M.recorded_or(meta.get("uncertainty_m") or {}, _load(spark, f"{folder}/surface"), "uncertainty_m")
    U.triangle_markers(picked, meta["voxel_size_m"]).write.mode("overwrite").parquet(f"{folder}/mesh/vertices")
    write_record(spark, f"{folder}/mesh/metadata", {"format_name": "mesh_sidecar", "format_version": VERSION, "chunk_id": chunk_id, "n_samples": picked.count(), "n_surface": meta["n_surface"], "n_frames": meta["n_frames"], "voxel_size_m": meta["voxel_size_m"], "flags": meta["flags"], "confidence": M.large_summary(picked, "confidence").first().asDict(), "mean_uncertainty_m": mean, "p95_uncertainty_m": p95})


def _scale_source(meta: dict, path: str) -> str:
    if len(meta["scale_sources"]) != 1:
        raise ArtifactError(f"{path}: scale_sources are mixed")
    return meta["scale_sources"][0]


def mesh_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """The mesh record (:data:`stratafuse.operators.records.MESH`) of a fusion output's marker triangles, which are at most a few thousand."""
    side, meta = read_record(spark, f"{folder}/mesh/metadata", "mesh_sidecar"), read_record(spark, f"{folder}/metadata", "fusion_output")
    n = side["n_samples"]
    corners = F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z")))
    rows = _load(spark, f"{folder}/mesh/vertices").agg(F.flatten(F.transform(corners, lambda r: F.array(*[r[c].cast("float").cast("double") for c in "xyz"]))).alias("vertices_m"))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        F.lit(side["chunk_id"]).alias("chunk_id"), F.lit(1).cast("long").alias("version"), F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]).alias("T_world_chunk"), "vertices_m", F.sequence(F.lit(0).cast("long"), F.lit(3 * n - 1).cast("long")).alias("faces"),
        none("array<double>").alias("normals"), none("array<long>").alias("colors"), none("array<double>").alias("uvs"), F.array_repeat(F.lit(-1).cast("long"), n).alias("object_id_per_face"), F.array_repeat(F.lit(0).cast("long"), n).alias("surface_source_per_face"),
        F.lit(float(side["voxel_size_m"])).alias("voxel_size_m"), F.lit(side["mean_uncertainty_m"]).alias("mean_uncertainty_m"), F.lit(side["p95_uncertainty_m"]).alias("p95_uncertainty_m"), F.array(*[F.lit(i).cast("long") for i in meta["frame_ids"]]).alias("source_frame_ids"),
        F.lit(_scale_source(meta, folder)).alias("scale_source"), F.array(*map(F.lit, side["flags"])).alias("flags"),
    )


def world_map(spark: SparkSession, folder: str, created_at_ns: int = 0) -> DataFrame:
    """The world map record (:data:`stratafuse.operators.records.WORLD_MAP`) of a fusion output: its one mesh, no objects, no keyframes."""
    world, meta = read_record(spark, f"{folder}/world_map", "world_map"), read_record(spark, f"{folder}/metadata", "fusion_output")
    chunk = mesh_chunk(spark, folder).select(F.concat(F.lit("{"), F.substring(F.to_json(F.array("chunk_id")), F.lit(2), F.length(F.to_json(F.array("chunk_id"))) - 2), F.lit(": "), R.encode(R.MESH), F.lit("}")).alias("mesh_chunks"))
    notes = {"mesh_chunk_ids": sorted(world["mesh_chunks"]), "object_meshes_invented": False, "flags": world["flags"], "n_frames": meta["n_frames"], "observed_coverage_estimate": meta["observed_ratio"], "surface_coverage_estimate": meta["surface_ratio"]}
    return chunk.select(F.lit(world["map_id"]).alias("map_id"), F.lit(meta.get("coordinate_frame") or "world").alias("world_frame_name"), F.lit(created_at_ns).cast("long").alias("created_at_ns"), "mesh_chunks", F.lit("{}").alias("objects"), F.lit("{}").alias("keyframes"), F.lit(_scale_source(meta, folder)).alias("scale_source"), F.lit(world["global_confidence"]).alias("global_confidence"), F.lit(json.dumps(notes, sort_keys=True)).alias("metadata"))


def write_world_map(spark: SparkSession, folder: str, map_id: str = "world_map") -> None:
    """A world map of the one mesh chunk; it has no objects and no keyframes."""
    mesh = read_record(spark, f"{folder}/mesh/metadata", "mesh_sidecar")
    _require_flags(mesh["flags"], f"{folder}/mesh")
    write_record(spark, f"{folder}/world_map", {"format_name": "world_map", "format_version": VERSION, "map_id": map_id, "mesh_chunks": {mesh["chunk_id"]: mesh}, "objects": {}, "keyframes": {}, "global_confidence": mesh["confidence"]["mean"], "flags": mesh["flags"]})


def _require_flags(flags: list[str], path: str) -> None:
    lacking = [f for f in K.TRUTH_FLAGS if f not in flags]
    if lacking or "completed_surface" in flags:
        raise ArtifactError(f"{path}: flags lack {', '.join(lacking) or 'nothing'} or claim completed surfaces")


def _close(a: float, b: float, path: str, field: str) -> None:
    if abs(a - b) > 1e-6 + 1e-6 * abs(b):
        raise ArtifactError(f"{path}: {field} is {a}, recomputed {b}")


MODES = ("surface", "mesh", "world-map", "complete")


def inspect_output(spark: SparkSession, folder: str, mesh: bool = False, world_map: bool = False, mode: str | None = None) -> dict:
    """Report of a fusion output; metadata must equal what the tables give, sidecars what they come from.

    mode says which sidecars must be there (surface: none; mesh; world-map and complete: both); those that
    are there are checked in any case. The output must state that it is observed, not completed, of low
    fidelity and no accuracy report."""
    mode = mode or ("world-map" if world_map else "mesh" if mesh else "surface")
    if mode not in MODES:
        raise ArtifactError(f"mode: {mode} is not one of {', '.join(MODES)}")
    meta, surface = read_record(spark, f"{folder}/metadata", "fusion_output"), _load(spark, f"{folder}/surface")
    n = surface.count()
    if n != meta["n_surface"]:
        raise ArtifactError(f"{folder}: the surface has not {meta['n_surface']} samples")
    again = {name: M.large_summary(surface, name).first().asDict() for name in ("confidence", "uncertainty_m")}
    for name, stats in again.items():
        for k in ("mean", "p95"):
            _close(meta[name][k], stats[k], folder, f"{name}.{k}")
    bounds = surface.agg(*[f(c).alias(f"{p}_{c}") for c in "xyz" for f, p in ((F.min, "min"), (F.max, "max"))]).first().asDict()
    metrics = read_record(spark, f"{folder}/metrics") if has_record(spark, f"{folder}/metrics") else {}
    if metrics.get("accuracy_report"):
        raise ArtifactError(f"{folder}/metrics: must not be an accuracy report")
    report = {"inspect_mode": mode, "surface": meta | {"bounds_min_m": [bounds[f"min_{c}"] for c in "xyz"], "bounds_max_m": [bounds[f"max_{c}"] for c in "xyz"], "confidence_summary": again["confidence"], "uncertainty_summary_m": again["uncertainty_m"]}, "metrics": metrics, "mesh": None, "world_map": None}
    for name, path, needed in (("mesh", "mesh/metadata", mode != "surface"), ("world_map", "world_map", mode in ("world-map", "complete"))):
        if has_record(spark, f"{folder}/{path}"):
            report[name] = _inspect_mesh(spark, folder, meta, surface) if name == "mesh" else _inspect_world_map(spark, folder, report["mesh"])
        elif needed:
            raise ArtifactError(f"{folder}/{path}: is missing, which mode {mode} needs")
    flags = list(dict.fromkeys([*meta["flags"], *(report["mesh"] or {}).get("flags", []), *(report["world_map"] or {}).get("flags", [])]))
    report["truth_boundary"] = truth_boundary(flags, metrics)
    lacking = [k for k, ok in report["truth_boundary"].items() if not ok]
    if lacking:
        raise ArtifactError(f"{folder}/metadata: does not state {', '.join(lacking)}")
    report["cross_checks"] = {"artifacts_checked": ["metadata", "surface", *[k for k in ("mesh", "world_map") if report[k]]], "flags": flags, "passed": True}
    return report


def truth_boundary(flags: list[str], metrics: dict) -> dict:
    """What an output's flags and metrics say of it."""
    return {
        "low_fidelity_reference_only": any("reference_only" in f for f in flags), "observed_only": bool({"observed_surface_samples", "observed_surface_points"} & set(flags)),
        "not_completed": "not_completed_surface" in flags or "completed_surface" not in flags, "not_accuracy_report": "not_accuracy_report" in flags or not metrics.get("accuracy_report"),
    }


def _inspect_mesh(spark: SparkSession, folder: str, meta: dict, surface: DataFrame) -> dict:
    side = read_record(spark, f"{folder}/mesh/metadata", "mesh_sidecar")
    _require_flags(side["flags"], f"{folder}/mesh")
    _close(side["voxel_size_m"], meta["voxel_size_m"], f"{folder}/mesh", "voxel_size_m")
    for k in ("mean", "p95"):
        _close(side[f"{k}_uncertainty_m"], meta["uncertainty_m"][k], f"{folder}/mesh", f"{k}_uncertainty_m")
    samples = _load(spark, f"{folder}/mesh/samples")
    n = meta["n_surface"]
    if side["n_surface"] != n or side["n_frames"] != meta["n_frames"] or side["n_samples"] != min(n, MAX_SAMPLES) or samples.count() != side["n_samples"] or _load(spark, f"{folder}/mesh/vertices").count() != 3 * side["n_samples"]:
        raise ArtifactError(f"{folder}/mesh: counts differ from the surface")
    # the samples are those of the surface: the same voxels, and the same summary
    if not samples.join(surface.select("ix", "iy", "iz", F.col("confidence").alias("own")), ["ix", "iy", "iz"], "left").where(~M.is_close(F.col("confidence"), F.coalesce("own", F.lit(-1.0)))).isEmpty():
        raise ArtifactError(f"{folder}/mesh: samples differ from the surface")
    found = M.large_summary(samples, "confidence").first().asDict()
    for k in ("mean", "p50", "p95", "max"):
        _close(side["confidence"][k], found[k], f"{folder}/mesh", f"confidence.{k}")
    return side


def _inspect_world_map(spark: SparkSession, folder: str, mesh: dict | None) -> dict:
    path = f"{folder}/world_map"
    world = read_record(spark, path, "world_map")
    _require_flags(world["flags"], path)
    if world["objects"] or world["keyframes"]:
        raise ArtifactError(f"{path}: must have neither objects nor keyframes")
    if any(k != c.get("chunk_id") for k, c in world["mesh_chunks"].items()) or (mesh and world["mesh_chunks"] != {mesh["chunk_id"]: mesh}):
        raise ArtifactError(f"{path}: differs from its mesh")
    for c in world["mesh_chunks"].values():
        _require_flags(c["flags"], path)
        _close(world["global_confidence"], c["confidence"]["mean"], path, "global_confidence")
    if not 0 <= world["global_confidence"] <= 1:
        raise ArtifactError(f"{path}: global_confidence is no share")
    return world


def world_map_report(spark: SparkSession, folder: str) -> dict:
    """What a world map holds, checked on its own."""
    world = _inspect_world_map(spark, folder, None)
    chunks = world["mesh_chunks"]
    return {"map_id": world["map_id"], "mesh_chunk_ids": sorted(chunks), "object_count": len(world["objects"]), "keyframe_count": len(world["keyframes"]), "global_confidence": world["global_confidence"], "flags": world["flags"], "accuracy_report": False, **{k: next(iter(chunks.values()), {}).get(k) for k in ("voxel_size_m", "n_frames", "mean_uncertainty_m", "p95_uncertainty_m")}}


def inspect_cache(spark: SparkSession, folder: str) -> dict:
    """Report of a cache that passes its checks: header, and confidence and uncertainty of each frame."""
    c = load_cache(spark, folder)
    each = {n: [{"frame_id": r["frame_id"], "summary": r["s"].asDict()} for r in c["frame_summaries"].select("frame_id", F.col(n).alias("s")).orderBy("frame_id").collect()] for n in ("confidence", "depth_sigma_m")}  # a summary a frame
    return {"metadata": {k: v for k, v in c["metadata"].items() if k != "exchange"}, "accuracy_report": False, "frame_ids": [r["frame_id"] for r in each["confidence"]], "confidence_summaries": each["confidence"], "uncertainty_summaries": each["depth_sigma_m"], "depth_m": M.numeric_summary(c["frame_summaries"].select(F.col("depth_m.mean").alias("m")), "m").first().asDict()}


# ---------------------------------------------------------------- runs


def run_fixture(spark: SparkSession, folder: str, bound: int = 3) -> dict:
    """Session, cache and fusion of the fixed scene with an event log and a summary."""
    write_session(spark, f"{folder}/session")
    run_adapter(spark, "fixture-cube-room", f"{folder}/session", f"{folder}/cache")
    replay_cache(spark, f"{folder}/cache", f"{folder}/fusion", mesh=True, world_map=True)
    frames = _load(spark, f"{folder}/session/frames")
    layout = W.expected_layout(frames).withColumns({"run": F.lit(0), "frames_in_memory": F.when(F.col("frame_id").isNull(), 0).otherwise(1)})
    log = W.record_events(layout.withColumnRenamed("event_index", "position"), "run", "position", "frames_in_memory", F.lit(False), float(bound))
    log.drop("run", "position").write.mode("overwrite").parquet(f"{folder}/events")
    summary = {"format_name": "run", "format_version": VERSION, "n_frames": frames.count(), "bound": bound, "artifacts": sorted(RUN_ARTIFACTS), **_log_totals(_load(spark, f"{folder}/events"))}
    write_record(spark, f"{folder}/summary", summary)
    return summary


#: What a run consists of, besides its summary.
RUN_ARTIFACTS = ("session", "cache", "fusion", "events")


def _log_totals(log: DataFrame) -> dict:
    return log.agg(F.count("*").alias("n_events"), F.max("peak_in_memory").alias("peak"), F.max("dropped_total").alias("dropped"), F.every("within_bound").alias("bounded")).first().asDict()


def inspect_run(spark: SparkSession, folder: str) -> dict:
    """The whole run: stage order, counters and summary reconciled, outputs inspected."""
    summary, log = read_record(spark, f"{folder}/summary", "run"), _load(spark, f"{folder}/events")
    want = W.expected_layout(_load(spark, f"{folder}/session/frames"))
    both = want.join(log.withColumnRenamed("stage", "got").withColumnRenamed("frame_id", "got_frame"), "event_index", "full")
    if not both.where(~F.col("stage").eqNullSafe(F.col("got")) | ~F.col("frame_id").eqNullSafe(F.col("got_frame"))).isEmpty():
        raise ArtifactError(f"{folder}/events: stages are not in the expected order")
    if not W.order_violations(log.withColumn("run", F.lit(0)), "run", "event_index", "event_index", "peak_in_memory").isEmpty():
        raise ArtifactError(f"{folder}/events: indices or counters are out of order")
    off = [k for k, v in _log_totals(log).items() if summary.get(k) != v]
    if off or not summary["bounded"]:
        raise ArtifactError(f"{folder}/summary: {', '.join(off) or 'bounded'} differs from the event log")
    lacking = sorted(a for a in RUN_ARTIFACTS if a not in summary["artifacts"] or not has_record(spark, f"{folder}/{a}"))
    if lacking:
        raise ArtifactError(f"{folder}/summary: lacks {', '.join(lacking)}")
    session, cache = load_session(spark, f"{folder}/session"), load_cache(spark, f"{folder}/cache")
    if session["frames"].count() != summary["n_frames"] or not K.missing_keys(session["frames"], cache["frames"], "frame_id").isEmpty() or not K.missing_keys(cache["frames"], session["frames"], "frame_id").isEmpty():
        raise ArtifactError(f"{folder}: session, cache and summary have different frames")
    return {"summary": summary, "cache": inspect_cache(spark, f"{folder}/cache"), "fusion": inspect_output(spark, f"{folder}/fusion", True, True)}
