"""Contracts of stored records: one table of fields a record, from which its JSON schema, its
decoder, its encoder and its checks follow.

A record is a JSON text in a column. Decoding gives typed columns (matrices as flat row-major
arrays) and ``missing``, the fields that the text lacks; checks are named boolean Columns
for :func:`stratafuse.operators.checks.violations`. Whatever doesn't parse as its type is
null, and a null fails its check unless the field is optional. An optional field may be
null but must be there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import checks as K

# Names that stored records use.
AVAILABILITY = ("available", "unavailable", "stub-only")
CAMERA_FRAME = "x_right_y_down_z_forward"
CAPABILITIES = ("predicts_camera", "predicts_pose", "predicts_depth", "predicts_normals", "predicts_points", "predicts_dense_matches", "predicts_objects", "supports_batch", "supports_streaming")
OPTIONAL_ARRAYS = ("object_embeddings", "object_mask_logits")
STUDENT_FLAGS = ("shape_only", "learned_inference", "usable_for_mapping", "accuracy_report", "performance_report")
TRAINING_FLAGS = {"training_mvp": True, "synthetic_only": True, "real_capture_model": False, "usable_for_realtime_mapping": False, "usable_for_mapping": False, "accuracy_report": False, "performance_report": False, "learned_inference": True, "generalizes_to_real_world": False}
COUNTERS = ("frame_arrays_in_memory", "peak_frame_arrays_in_memory", "processed_frame_count", "dropped_frame_count", "queued_frame_count")
RESERVED_BATCH_KEYS = ("source", "frame_count", "frame_ids", "input_order_preserved", "coordinate_frame", "truth_boundary_note", "source_formats")


def mapping(c: str) -> Column:
    """The text of a JSON object."""
    return F.json_object_keys(c).isNotNull()


def texts(c: str) -> Column:
    """An array of strings, none of them null."""
    return F.forall(c, lambda x: x.isNotNull())


def counted(c: str, *shape: Column | int) -> Column:
    """A flat array has as many values as the shape asks for."""
    return F.size(c) == reduce(lambda a, b: a * b, [F.lit(x) if isinstance(x, int) else x for x in shape])


def image(c: str, height: str, width: str) -> Column:
    """A flat image has height x width finite values."""
    return counted(c, F.col(height), F.col(width)) & K.finite_array(c)


def _matrix(c: str, rows: int, width: int) -> Column:
    return (F.size(c) == rows) & F.forall(c, lambda r: F.size(r) == width)


@dataclass(frozen=True)
class Kind:
    """Type in JSON, check of the decoded column, and rows and width of a matrix (0 rows: any number)."""

    ddl: str
    check: Callable[[str], Column]
    shape: tuple[int, int] | None = None
    read: Callable[[Column], Column] | None = None
    write: Callable[[Column], Column] | None = None


def _choice(*allowed: str) -> Kind:
    return Kind("string", lambda c: K.choice(c, allowed))


def _labels(pairs: Column) -> Column:
    """[label, confidence] pairs as structs; a pair of another length is null."""
    return F.transform(pairs, lambda p: F.when(F.size(p) == 2, F.struct(F.get(p, F.lit(0)).alias("label"), F.get(p, F.lit(1)).try_cast("double").alias("confidence"))))


def _pairs(labels: Column) -> Column:
    text = lambda x: F.to_json(F.array(x["label"]))
    one = lambda x: F.concat(F.substring(text(x), F.lit(1), F.length(text(x)) - 1), F.lit(", "), x["confidence"].cast("string"), F.lit("]"))
    return F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(labels, one), ", "), F.lit("]")))


KINDS: dict[str, Kind] = {
    "id": Kind("long", K.non_negative_int),
    "count": Kind("long", K.positive_int),
    "text": Kind("string", K.nonempty_str),
    "flag": Kind("boolean", lambda c: F.col(c).isNotNull()),
    "scalar": Kind("double", K.finite_scalar),
    "metres": Kind("double", K.non_negative_scalar),
    "size": Kind("double", K.positive_scalar),
    "share": Kind("double", K.confidence),
    "object": Kind("string", mapping),
    "texts": Kind("array<string>", texts),
    "ids": Kind("array<long>", lambda c: K.int_sequence(c, True)),
    "shape": Kind("array<long>", lambda c: K.int_sequence(c)),
    "numbers": Kind("array<double>", K.finite_array),
    "vector3": Kind("array<double>", lambda c: K.vector(c, 3)),
    "quaternion": Kind("array<double>", K.unit_quaternion),
    "extents": Kind("array<double>", lambda c: K.vector(c, 3) & F.forall(c, lambda x: x > 0)),
    "intrinsics": Kind("array<array<double>>", K.intrinsics, (3, 3)),
    "transform": Kind("array<array<double>>", K.transform, (4, 4)),
    "rotation": Kind("array<array<double>>", lambda c: F.when(F.size(c) == 9, K.finite_array(c) & K.rotation(G.mat(c))), (3, 3)),
    "covariance": Kind("array<array<double>>", lambda c: K.covariance_symmetric(c) & K.covariance_psd(c), (6, 6)),
    "points": Kind("array<array<double>>", K.finite_array, (0, 3)),
    "pixels": Kind("array<array<double>>", K.finite_array, (0, 2)),
    "triangles": Kind("array<array<long>>", lambda c: F.forall(c, lambda x: x >= 0), (0, 3)),
    "distortion": _choice(*K.DISTORTION_MODELS),
    "tracking": _choice(*K.TRACKING_STATES),
    "scale": _choice(*K.SCALE_SOURCES),
    "availability": _choice(*AVAILABILITY),
    "labels": Kind("array<array<string>>", lambda c: F.forall(c, lambda x: (F.length(x["label"]) > 0) & K.finite(x["confidence"]) & x["confidence"].between(0, 1)), read=_labels, write=_pairs),
    "sources": Kind("array<long>", lambda c: F.size(F.array_except(F.array_distinct(c), F.array(*[F.lit(x).cast("long") for x in K.SURFACE_SOURCES]))) == 0),
    "integers": Kind("array<long>", texts),
    "colors": Kind("array<array<long>>", lambda c: F.forall(c, lambda x: x.between(0, 255)), (0, 0)),
}


@dataclass(frozen=True)
class Record:
    """Fields (name -> kind, "?" for optional ones) and checks across fields."""

    fields: dict[str, str]
    across: Callable[[], dict[str, Column]] = field(default=lambda: {})

    def kind(self, name: str) -> Kind:
        return KINDS[self.fields[name].rstrip("?")]

    def optional(self, name: str) -> bool:
        return self.fields[name].endswith("?")

    def schema(self) -> str:
        return ", ".join(f"{n} {self.kind(n).ddl}" for n in self.fields)

    def checks(self) -> dict[str, Column]:
        """Checks of decoded columns, by field or by the name of a check across fields."""
        out = {"missing": F.size("missing") == 0, "ragged": F.size("ragged") == 0}
        for n in self.fields:
            ok = self.kind(n).check(n)
            out[n] = (F.col(n).isNull() & ~F.array_contains("unread", n)) | F.coalesce(ok, F.lit(False)) if self.optional(n) else ok
        return out | self.across()


def decode(df: DataFrame, text: str, record: Record, *keep: str) -> DataFrame:
    """The columns ``keep`` and those of the record in ``text``, with arrays of field names: ``missing``
    ones, ``ragged`` matrices, and optional ones that are ``unread``, neither null nor of their type."""
    names = list(record.fields)
    # every value as text, in one reading for all fields
    df = df.select(*keep, F.from_json(text, record.schema()).alias("_r"), F.from_json(text, "map<string,string>").alias("_raw"))
    keys = F.coalesce(F.map_keys("_raw"), F.array().cast("array<string>"))
    cols, ragged, unread = [], [], []
    for n in names:
        kind, c = record.kind(n), F.col(f"_r.{n}")
        if kind.shape:
            rows, width = kind.shape
            ok = F.forall(c, _of_width(width)) & ((F.size(c) == rows) if rows else F.lit(True))
            ragged.append(F.when(c.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(n)))
            c = F.flatten(c)
        if record.optional(n):
            unread.append(F.when(F.col(f"_r.{n}").isNull() & F.col("_raw")[n].isNotNull(), F.lit(n)))
        cols.append((kind.read(c) if kind.read else c).alias(n))
    none = F.array().cast("array<string>")
    pack = lambda xs: F.array_compact(F.array(*xs)) if xs else none
    return df.select(*keep, *cols, F.array_except(F.array(*map(F.lit, names)), keys).alias("missing"), pack(ragged).alias("ragged"), pack(unread).alias("unread"))


def _of_width(width: int) -> Callable[[Column], Column]:
    return lambda r: F.size(r) == width if width else r.isNotNull()


def _row_of(name: str, width: Column) -> Callable[[Column], Column]:
    return lambda i: F.slice(F.col(name), i * width + 1, width)


def encode(record: Record, without: Column | None = None) -> Column:
    """The JSON text of a row's columns: fields in name order, nulls written. without: the name of a field to leave out."""
    cols = []
    for n in sorted(record.fields):
        kind, c = record.kind(n), F.col(n)
        if kind.write:
            c = kind.write(c)
        elif kind.shape:
            # colours have three or four values a vertex
            w = F.lit(kind.shape[1]) if kind.shape[1] else F.greatest(F.expr(f"size({n}) div greatest(size(vertices_m) div 3, 1)"), F.lit(1))
            rows = F.transform(F.sequence(F.lit(0), F.greatest((F.size(n) / w).cast("int"), F.lit(1)) - 1), _row_of(n, w))
            c = F.when(F.size(n) > 0, rows).when(F.size(n) == 0, F.array().cast(kind.ddl)).otherwise(F.lit(None).cast(kind.ddl))
        elif kind.ddl == "string" and kind.check is mapping:
            c = F.parse_json(F.col(n))
        cols.append(c.alias(n))
    keep = {"ignoreNullFields": "false"}
    if without is None:
        return F.to_json(F.struct(*cols), keep)
    out = F.to_json(F.struct(*cols), keep)
    for i, n in enumerate(sorted(record.fields)):
        out = F.when(without == n, F.to_json(F.struct(*cols[:i], *cols[i + 1 :]), keep)).otherwise(out)
    return out


def violations(df: DataFrame, text: str, record: Record, key: str) -> DataFrame:
    """(key, check) for every failed check of the records in ``text``, in one scan."""
    return K.violations(decode(df, text, record, key), key, record.checks())


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance + 1e-5 * F.abs(b)


def _pose() -> dict[str, Column]:
    t, c = G.camera_center("T_world_camera"), G.vec("camera_center_world_m")
    return {"center": reduce(lambda a, b: a & b, [_close(x, y, 1e-4) for x, y in zip(c, t, strict=True)])}


def _mesh() -> dict[str, Column]:
    n, m = F.expr("size(vertices_m) div 3"), F.expr("size(faces) div 3")
    per_face = {f"{c}_length": F.col(c).isNull() | (F.size(c) == m) for c in ("object_id_per_face", "surface_source_per_face")}
    per_vertex = {"normals_length": F.col("normals").isNull() | (F.size("normals") == F.size("vertices_m")), "uvs_length": F.col("uvs").isNull() | (F.size("uvs") == 2 * n), "colors_length": F.col("colors").isNull() | F.size("colors").isin(3, 4) | (F.size("colors") == 3 * n) | (F.size("colors") == 4 * n)}
    return {"face_index": F.forall("faces", lambda x: x < n), **per_face, **per_vertex}


def summary_ok(c: str, low: float = 0.0, high: float = float("inf")) -> Column:
    """A struct of shape, dtype, count, min, mean, p50, p95, max: finite values within bounds, null only when count is 0."""
    n = F.col(f"{c}.count")
    ok = (n >= 0) & (F.length(f"{c}.dtype") > 0) & F.forall(f"{c}.shape", lambda x: x >= 0)
    for s in ("min", "mean", "p50", "p95", "max"):
        x = F.col(f"{c}.{s}")
        ok = ok & ((x.isNull() & (n == 0)) | F.coalesce(K.finite(x) & (x >= low) & (x <= high), F.lit(False)))
    return ok


SUMMARY = "struct<shape:array<long>,dtype:string,count:long,min:double,mean:double,p50:double,p95:double,max:double>"
SHAPE = "struct<shape:array<long>,dtype:string>"
KINDS |= {
    "depth_stats": Kind(SUMMARY, summary_ok),
    "share_stats": Kind(SUMMARY, lambda c: summary_ok(c, 0.0, 1.0)),
    "tensors": Kind("struct<" + ",".join(f"{k}:{SHAPE}" for k in (*K.ARRAY_KEYS, *OPTIONAL_ARRAYS)) + ">", lambda c: tensors_ok(c)),
    "camera": Kind("struct<width:long,height:long,K:array<array<double>>,distortion_model:string,distortion_params:array<double>,rolling_shutter_row_time_s:double,confidence:double,source:string>", lambda c: camera_ok(c)),
    "pose": Kind("struct<T_world_camera:array<array<double>>,q_world_camera_xyzw:array<double>,camera_center_world_m:array<double>,covariance_6x6:array<array<double>>,tracking_state:string,confidence:double,scale_source:string,has_covariance_6x6:boolean,uncertainty:struct<covariance_6x6_present:boolean,translation_std_m:array<double>,rotation_std:array<double>,max_std:double>,diagnostics:string>", lambda c: pose_ok(c)),
    "matches": Kind(f"struct<source_frame_id:long,target_frame_id:long,match_count:long,confidence_summary:{SUMMARY}>", lambda c: (F.col(f"{c}.match_count") >= 0) & summary_ok(f"{c}.confidence_summary", 0.0, 1.0)),
    "counters": Kind("struct<" + ",".join(f"{k}:long" for k in ("configured_frame_array_bound", *COUNTERS)) + ">", lambda c: counters_ok(c)),
    "paths": Kind("map<string,string>", lambda c: F.forall(F.map_values(c), relative_path)),
    "arrays": Kind("struct<stored:boolean,directory:string,optional_npz_keys:array<string>>", lambda c: arrays_ok(c)),
    "capabilities": Kind("struct<" + ",".join(f"{k}:boolean" for k in CAPABILITIES) + ",notes:array<string>>", lambda c: reduce(lambda a, b: a & b, [F.col(f"{c}.{k}").isNotNull() for k in CAPABILITIES]) & F.forall(f"{c}.notes", lambda x: F.length(x) > 0)),
}


def tensors_ok(c: str) -> Column:
    """Shape and dtype of each required array; optional ones may be null."""
    each = []
    for k in (*K.ARRAY_KEYS, *OPTIONAL_ARRAYS):
        ok = F.coalesce((F.length(f"{c}.{k}.dtype") > 0) & F.forall(f"{c}.{k}.shape", lambda x: x >= 0), F.lit(False))
        each.append(ok if k in K.ARRAY_KEYS else ok | F.col(f"{c}.{k}").isNull())
    return reduce(lambda a, b: a & b, each)


def camera_ok(c: str) -> Column:
    return (F.col(f"{c}.width") > 0) & (F.col(f"{c}.height") > 0) & _matrix(f"{c}.K", 3, 3) & (F.col(f"{c}.K")[0][0] > 0) & (F.col(f"{c}.K")[1][1] > 0) & K.confidence(f"{c}.confidence") & K.nonempty_str(f"{c}.source")


def pose_ok(c: str) -> Column:
    flags = F.col(f"{c}.has_covariance_6x6").isNotNull() & (F.col(f"{c}.uncertainty.covariance_6x6_present") == F.col(f"{c}.has_covariance_6x6"))
    return _matrix(f"{c}.T_world_camera", 4, 4) & K.confidence(f"{c}.confidence") & K.choice(f"{c}.scale_source", K.SCALE_SOURCES) & K.nonempty_str(f"{c}.tracking_state") & flags


def counters_ok(c: str) -> Column:
    """Counters are non-negative, and frames in memory, now and at their peak, are within the bound."""
    bound = F.col(f"{c}.configured_frame_array_bound")
    each = [F.col(f"{c}.{k}") >= 0 for k in COUNTERS] + [F.col(f"{c}.{k}") <= bound for k in COUNTERS[:2]]
    return reduce(lambda a, b: a & b, each, bound > 0)


def arrays_ok(c: str) -> Column:
    """A directory stands there if and only if arrays are stored, and the keys are the known ones."""
    where = F.when(F.col(f"{c}.stored"), F.col(f"{c}.directory").eqNullSafe("arrays")).otherwise(F.col(f"{c}.directory").isNull())
    return F.col(f"{c}.stored").isNotNull() & where & K.same_keys(F.col(f"{c}.optional_npz_keys"), (*K.ARRAY_KEYS, *OPTIONAL_ARRAYS))


def relative_path(x: Column) -> Column:
    """Relative, without "..", backslashes or an empty name."""
    return (F.length(x) > 0) & ~F.startswith(x, F.lit("/")) & ~F.contains(x, F.lit("\\")) & ~F.array_contains(F.split(x, "/"), "..")


POSE = Record({"frame_id": "id", "timestamp_ns": "id", "T_world_camera": "transform", "q_world_camera_xyzw": "quaternion", "camera_center_world_m": "vector3", "covariance_6x6": "covariance?", "confidence": "share", "tracking_state": "tracking", "scale_source": "scale", "diagnostics": "object"}, _pose)
CAMERA = Record({"frame_id": "id", "timestamp_ns": "id", "width": "count", "height": "count", "K": "intrinsics", "distortion_model": "distortion", "distortion_params": "numbers?", "rolling_shutter_row_time_s": "metres?", "confidence": "share", "source": "text"})
OBJECT = Record(
    {"object_id": "id", "label_candidates": "labels", "T_world_object": "transform", "oriented_bbox_center_m": "vector3", "oriented_bbox_axes": "rotation", "oriented_bbox_extents_m": "extents", "mesh_chunk_ids": "texts", "is_dynamic": "flag", "observed_coverage_ratio": "share", "confidence": "share", "uncertainty_m": "metres", "first_seen_frame_id": "id", "last_seen_frame_id": "id", "metadata": "object"},
    lambda: {"seen_order": F.col("first_seen_frame_id") <= F.col("last_seen_frame_id")},
)
MESH = Record({"chunk_id": "text", "version": "count", "T_world_chunk": "transform", "vertices_m": "points", "faces": "triangles", "normals": "points?", "colors": "colors?", "uvs": "pixels?", "object_id_per_face": "integers?", "surface_source_per_face": "sources?", "voxel_size_m": "size", "mean_uncertainty_m": "metres", "p95_uncertainty_m": "metres", "source_frame_ids": "ids", "scale_source": "scale", "flags": "texts"}, _mesh)
MATCHES = Record(
    {"source_frame_id": "id", "target_frame_id": "id", "source_pixels_uv": "pixels", "target_pixels_uv": "pixels", "confidence": "numbers"},
    lambda: {"pairs": (F.size("source_pixels_uv") == F.size("target_pixels_uv")) & (F.size("source_pixels_uv") == 2 * F.size("confidence")), "shares": K.confidence_array("confidence")},
)
FRAME_SUMMARY = Record(
    {"frame_id": "id", "timestamp_ns": "id", "coordinate_frame": "text", "scale_source": "scale", "camera": "camera", "pose": "pose", "confidence_summary": "share_stats", "uncertainty_summary": "depth_stats", "depth_summary": "depth_stats", "tensor_shapes": "tensors", "dense_matches": "matches?", "arrays_path": "text?"},
    lambda: {"arrays_below": F.col("arrays_path").isNull() | (relative_path(F.col("arrays_path")) & F.startswith("arrays_path", F.lit("arrays/")))},
)
ADAPTER = Record({"name": "text", "display_name": "text", "availability": "availability", "capabilities": "capabilities", "install_hint": "text?", "reason": "text?"})
CACHE = Record(
    {"format_name": "text", "format_version": "count", "adapter": "object", "coordinate_frame": "text", "frame_count": "count", "frame_ids": "ids", "scale_sources": "texts", "frame_summaries_path": "text", "arrays": "arrays"},
    lambda: {"frame_counts": F.size("frame_ids") == F.col("frame_count"), "known_scales": F.forall("scale_sources", lambda x: x.isin(*K.SCALE_SOURCES)), "ids_ascend": F.col("frame_ids") == F.array_sort(F.array_distinct("frame_ids"))},
)
WORLD_MAP = Record(
    {"map_id": "text", "world_frame_name": "text", "created_at_ns": "id", "mesh_chunks": "object", "objects": "object", "keyframes": "object", "scale_source": "scale", "global_confidence": "share", "metadata": "object"},
    lambda: {"no_objects": F.size(F.json_object_keys("objects")) == 0, "no_keyframes": F.size(F.json_object_keys("keyframes")) == 0, "chunk_keys": chunk_keys_ok()},
)
EVENT = Record({"event_index": "id", "stage_name": "text", "frame_id": "id?", "timestamp_ns": "id", "latency_ns": "id", "dropped_frame": "flag", "memory_counters": "counters", "paths": "paths", "metadata": "object", "format_name": "text", "format_version": "count"})


def chunk_keys_ok() -> Column:
    """Keys of the mesh chunks equal the chunk_id that each chunk states."""
    keys = F.json_object_keys("mesh_chunks")
    chunks = F.from_json("mesh_chunks", "map<string,struct<chunk_id:string>>")
    return F.forall(keys, lambda k: F.element_at(chunks, k)["chunk_id"] == k)


def global_confidence(c: str) -> Column:
    """Mean of a confidence summary, if it is a share; else null."""
    x = F.col(f"{c}.mean")
    return F.when(K.finite(x) & x.between(0, 1), x)


def observation_checks() -> dict[str, Column]:
    """Frame rows that go into fusion: frame_id, width, height, K (9), T_world_camera (16), depth, sigma and confidence
    images, and optionally static_mask (0..1), object_id and rgb (3 values a pixel)."""
    size = (F.col("height"), F.col("width"))
    positive = lambda c: F.forall(c, lambda x: x >= 0)
    return {
        "frame_id": K.non_negative_int("frame_id"), "image_size": (F.col("width") > 0) & (F.col("height") > 0), "K": K.intrinsics("K"), "T_world_camera": K.transform("T_world_camera"),
        "depth": image("depth", "height", "width") & positive("depth"), "sigma": image("sigma", "height", "width") & positive("sigma"), "confidence": image("confidence", "height", "width") & K.confidence_array("confidence"),
        "static_mask": F.col("static_mask").isNull() | (counted("static_mask", *size) & K.confidence_array("static_mask")),
        "object_id": F.col("object_id").isNull() | (counted("object_id", *size) & texts("object_id")),
        "rgb": F.col("rgb").isNull() | (counted("rgb", *size, 3) & F.forall("rgb", lambda x: x.between(0, 255))),
        "source": K.nonempty_str("source"),
    }


def payload_checks() -> dict[str, Column]:
    """Payloads of a cache, one row a frame: height, width, keys (names of the stored arrays), the arrays
    themselves (flat), and tensor_shapes as the summary records them."""
    want = {"depth_m": 1, "depth_sigma_m": 1, "normal_camera": 3, "point_world": 3, "confidence": 1, "static_mask": 1}
    known = F.array(*map(F.lit, (*K.ARRAY_KEYS, *OPTIONAL_ARRAYS)))
    out = {"unknown_keys": F.size(F.array_except("keys", known)) == 0, "missing_keys": F.size(F.array_except(F.array(*map(F.lit, K.ARRAY_KEYS)), F.col("keys"))) == 0}
    for k, depth in want.items():
        shape = F.array(F.col("height"), F.col("width"), *([F.lit(3).cast("long")] if depth == 3 else []))
        values = K.finite_array(k)
        if k in ("depth_m", "depth_sigma_m"):
            values = values & F.forall(k, lambda x: x >= 0)
        elif k in ("confidence", "static_mask"):
            values = values & K.confidence_array(k)
        out[k] = counted(k, F.col("height"), F.col("width"), depth) & values
        out[f"{k}_shape"] = F.col(f"tensor_shapes.{k}.shape") == shape
    for k in OPTIONAL_ARRAYS:
        out[k] = F.array_contains("keys", k) == F.col(f"tensor_shapes.{k}").isNotNull()
    return out


def clip_checks() -> dict[str, Column]:
    """Clips, one row each: frame_ids, images (frames x 3 x height x width, flat), height, width, K (9 numbers, or 9 a
    frame), T_prior (16 a frame, or null), coordinate_frame, metadata (JSON)."""
    n = F.size("frame_ids")
    each = lambda c, size, ok: F.forall(F.sequence(F.lit(0), F.greatest(F.expr(f"size({c}) div {size}"), F.lit(1)) - 1), lambda i: ok(F.slice(F.col(c), i * size + 1, size)))
    return {
        "frame_ids": K.int_sequence("frame_ids", True) & (F.size(F.array_distinct("frame_ids")) == n),
        "images": (F.col("height") > 0) & (F.col("width") > 0) & counted("images", n, 3, F.col("height"), F.col("width")) & K.finite_array("images"),
        "images_unit": F.forall("images", lambda x: x.between(0, 1)),
        "K": F.size("K").isin(9) | (F.size("K") == 9 * n), "focal": each("K", 9, lambda k: (F.get(k, F.lit(0)) > 0) & (F.get(k, F.lit(4)) > 0)),
        "T_prior": F.col("T_prior").isNull() | ((F.size("T_prior") == 16 * n) & each("T_prior", 16, lambda t: K.rotation([F.get(t, F.lit(4 * i + j)) for i in range(3) for j in range(3)]) & (F.get(t, F.lit(15)) == 1))),
        "coordinate_frame": F.col("coordinate_frame") == CAMERA_FRAME, "metadata": mapping("metadata"),
    }


def output_checks() -> dict[str, Column]:
    """Model outputs, one row a frame: depth, sigma, confidence (height x width), center (3): finite, non-negative, shares."""
    positive = lambda c: F.forall(c, lambda x: x >= 0)
    return {"depth": image("depth", "height", "width") & positive("depth"), "sigma": image("sigma", "height", "width") & positive("sigma"), "confidence": image("confidence", "height", "width") & K.confidence_array("confidence"), "center": K.vector("center", 3)}


def shared_shape(df: DataFrame, group: str, *shape: str) -> DataFrame:
    """Groups whose rows don't have one shape, with the number of shapes."""
    return df.groupBy(group).agg(F.countDistinct(F.struct(*shape)).alias("shapes")).where("shapes <> 1")


def training_flags(c: str) -> Column:
    """A map of flags states what a trained checkpoint must state."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.element_at(F.col(c), k) == v, F.lit(False)) for k, v in TRAINING_FLAGS.items()])


def merged_metadata(base: Column, extra: Column) -> Column:
    """base with extra's entries; null if extra uses a reserved key."""
    reserved = F.array(*map(F.lit, RESERVED_BATCH_KEYS))
    return F.when(~F.arrays_overlap(F.map_keys(extra), reserved), F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.array_contains(F.map_keys(extra), e["key"])), F.map_entries(extra))))
