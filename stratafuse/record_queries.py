"""Registered queries over the record contracts: records with faults that follow from real
columns are written as JSON, read back and checked; the SQL names the faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import checks as K
from stratafuse.operators import records as R
from stratafuse.registry import query, table, union


def _spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table over a few partitions for each core: rows are small here and costly once they are records, and a file may be one task."""
    return table(spark, sf_dir, name).select(*columns).repartition(4 * spark.sparkContext.defaultParallelism)


def _flat_pose(q: str, t: str) -> Column:
    return G.make_transform(G.rotation_from_quaternion(G.mat(q, 4)), G.vec(t))


def _sized(value: Column, n: Column | int) -> Column:
    return F.array_repeat(value, F.lit(n) if isinstance(n, int) else n)


def _identity() -> Column:
    return F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose records, some faulty, with their text in ``text``."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    q = F.array(((k % 7) - 3).cast("double"), ((k % 5) - 2).cast("double"), ((k % 3) - 1).cast("double"), F.lit(4.0))
    size = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))
    c = c.withColumns({"q": q, "t": F.array((k % 11).cast("double"), (k % 13).cast("double"), F.col("c_acctbal"))})
    c = c.withColumns({"pose": _flat_pose("q", "t"), "unit": F.transform("q", lambda x: x / size * F.when(k % 11 == 0, 1.1).otherwise(1.0))})
    segments = {"BUILDING": "OK", "MACHINERY": "LOST", "FURNITURE": "NEW_SUBMAP"}
    state = F.col("c_mktsegment")
    for a, b in segments.items():
        state = F.when(F.col("c_mktsegment") == a, b).otherwise(state)
    variance = [F.when(F.lit(i % 7 == 0), F.when((F.lit(i) == 0) & (F.col("c_nationkey") == 3), F.lit(-1.0)).otherwise(F.lit(1e-4))).otherwise(F.lit(0.0)) for i in range(36)]
    rows = c.select(
        k.alias("pose_id"), (k - 2).alias("frame_id"), (k * 33_333_333).alias("timestamp_ns"),
        F.transform("pose", lambda x, i: F.when((i == 0) & (k % 13 == 0), x * 1.5 + 0.1).otherwise(x)).alias("T_world_camera"),
        F.col("unit").alias("q_world_camera_xyzw"), F.transform("t", lambda x, i: F.when((i == 0) & (k % 7 == 0), x + 0.01).otherwise(x)).alias("camera_center_world_m"),
        F.when(k % 5 != 0, F.array(*variance)).alias("covariance_6x6"), (F.col("c_acctbal") / 10_000).alias("confidence"), state.alias("tracking_state"), F.lit("rgb_prior").alias("scale_source"),
        F.when(k % 19 == 0, F.lit('"note"')).otherwise(F.lit('{"synthetic": true}')).alias("diagnostics"),
    )
    return rows.withColumn("text", R.encode(R.POSE, F.when(F.col("pose_id") % 17 == 0, F.lit("scale_source"))))


@query(
    union(
        ("c_custkey AS pose_id", "frame_id", "customer", "c_custkey < 2"),
        ("c_custkey AS pose_id", "T_world_camera", "customer", "c_custkey % 13 = 0"),
        ("c_custkey AS pose_id", "q_world_camera_xyzw", "customer", "c_custkey % 11 = 0"),
        ("c_custkey AS pose_id", "center", "customer", "c_custkey % 7 = 0"),
        ("c_custkey AS pose_id", "covariance_6x6", "customer", "c_custkey % 5 <> 0 AND c_nationkey = 3"),
        ("c_custkey AS pose_id", "confidence", "customer", "c_acctbal < 0"),
        ("c_custkey AS pose_id", "tracking_state", "customer", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"),
        ("c_custkey AS pose_id", "scale_source", "customer", "c_custkey % 17 = 0"),
        ("c_custkey AS pose_id", "missing", "customer", "c_custkey % 17 = 0"),
        ("c_custkey AS pose_id", "diagnostics", "customer", "c_custkey % 19 = 0"),
    )
)
def pose_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SRC-39, CHK-02, CHK-07..09, CHK-14, CHK-19, CHK-20, CHK-22: pose records read and checked."""
    return R.violations(poses(spark, sf_dir), "text", R.POSE, "pose_id")


@query(
    union(
        ("s_suppkey AS frame_id", "width", "supplier", "s_nationkey = 0 OR s_suppkey % 9 = 2"),
        ("s_suppkey AS frame_id", "K", "supplier", "s_acctbal <= 0"),
        ("s_suppkey AS frame_id", "distortion_model", "supplier", "s_suppkey % 4 = 3"),
        ("s_suppkey AS frame_id", "distortion_params", "supplier", "s_suppkey % 6 = 5"),
        ("s_suppkey AS frame_id", "rolling_shutter_row_time_s", "supplier", "s_suppkey % 5 = 0"),
        ("s_suppkey AS frame_id", "source", "supplier", "s_suppkey % 21 = 0"),
        ("s_suppkey AS frame_id", "missing", "supplier", "s_suppkey % 14 = 1"),
        ("s_suppkey AS frame_id", "confidence", "supplier", "s_suppkey % 14 = 1"),
    )
)
def camera_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, SRC-38, CHK-01, CHK-03, CHK-05, CHK-12, CHK-21: camera records read and checked; a boolean is no integer."""
    k = F.col("s_suppkey")
    f = F.col("s_acctbal") / 100
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("frame_id"), F.lit(0).cast("long").alias("timestamp_ns"), F.col("s_nationkey").cast("long").alias("width"), F.lit(24).cast("long").alias("height"),
        F.array(f, F.lit(0.0), F.lit(15.5), F.lit(0.0), F.lit(30.0), F.lit(11.5), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("K"),
        F.element_at(F.array(*map(F.lit, (*K.DISTORTION_MODELS, "wide"))), (k % 4 + 1).cast("int")).alias("distortion_model"), F.when(k % 2 == 0, F.array(F.lit(0.1), F.lit(-0.2))).alias("distortion_params"),
        F.when(k % 5 == 0, F.lit(-0.5)).when(k % 5 == 1, F.lit(0.25)).alias("rolling_shutter_row_time_s"), F.lit(1.0).alias("confidence"), F.when(k % 21 == 0, F.lit("")).otherwise(F.lit("rig")).alias("source"),
    )
    text = R.encode(R.CAMERA, F.when(F.col("frame_id") % 14 == 1, F.lit("confidence")))
    text = F.when(F.col("frame_id") % 9 == 2, F.regexp_replace(text, '"width":[0-9]+', '"width":true')).otherwise(text)
    text = F.when(F.col("frame_id") % 6 == 5, F.regexp_replace(text, '"distortion_params":null', '"distortion_params":"wide"')).otherwise(text)
    return R.violations(rows.select("frame_id", text.alias("text")).withColumnRenamed("frame_id", "key"), "text", R.CAMERA, "key").withColumnRenamed("key", "frame_id")


@query(
    union(
        ("p_partkey AS object_id", "label_candidates", "part", "p_size > 45"),
        ("p_partkey AS object_id", "oriented_bbox_axes", "part", "p_partkey % 8 = 0"),
        ("p_partkey AS object_id", "oriented_bbox_extents_m", "part", "p_partkey % 10 = 0"),
        ("p_partkey AS object_id", "mesh_chunk_ids", "part", "p_partkey % 12 = 5"),
        ("p_partkey AS object_id", "seen_order", "part", "p_size % 10 > p_partkey % 10"),
        ("p_partkey AS object_id", "observed_coverage_ratio", "part", "p_retailprice / 1000 > 1"),
        ("p_partkey AS object_id", "uncertainty_m", "part", "p_type = 'ECONOMY'"),
        ("p_partkey AS object_id", "is_dynamic", "part", "p_partkey % 25 = 3"),
        ("p_partkey AS object_id", "ragged", "part", "p_partkey % 30 = 7"),
        ("p_partkey AS object_id", "T_world_object", "part", "p_partkey % 30 = 7"),
    )
)
def object_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, CHK-10, CHK-19, LIM-02: object records read and checked."""
    k = F.col("p_partkey")
    axes = F.array(*[F.when((k % 8 == 0) & F.lit(i == 1), F.lit(0.2)).otherwise(F.lit(float(i % 4 == 0))) for i in range(9)])
    rows = table(spark, sf_dir, "part").select(
        k.alias("key"), k.alias("object_id"), F.array(F.struct(F.col("p_name").alias("label"), (F.col("p_size") / 45).alias("confidence"))).alias("label_candidates"), _identity().alias("T_world_object"),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("oriented_bbox_center_m"), axes.alias("oriented_bbox_axes"), F.array((k % 10).cast("double"), F.lit(1.0), F.lit(2.0)).alias("oriented_bbox_extents_m"),
        F.array(F.col("p_brand"), F.when(k % 12 != 5, F.col("p_type"))).alias("mesh_chunk_ids"), F.when(k % 25 != 3, k % 2 == 0).alias("is_dynamic"), (F.col("p_retailprice") / 1000).alias("observed_coverage_ratio"),
        F.lit(0.5).alias("confidence"), F.when(F.col("p_type") == "ECONOMY", F.lit(-0.1)).otherwise(F.lit(0.1)).alias("uncertainty_m"), (F.col("p_size") % 10).cast("long").alias("first_seen_frame_id"), (k % 10).alias("last_seen_frame_id"), F.lit("{}").alias("metadata"),
    )
    text = R.encode(R.OBJECT)
    text = F.when(F.col("key") % 30 == 7, F.regexp_replace(text, r'"T_world_object":\[\[1\.0,', '"T_world_object":[[')).otherwise(text)
    return R.violations(rows.withColumn("text", text).select("key", "text"), "text", R.OBJECT, "key").withColumnRenamed("key", "object_id")


@query(
    union(
        ("o_orderkey", "face_index", "orders", "o_orderkey % 10 = 0"),
        ("o_orderkey", "object_id_per_face_length", "orders", "o_orderkey % 6 = 0"),
        ("o_orderkey", "surface_source_per_face", "orders", "o_orderkey % 7 > 4"),
        ("o_orderkey", "normals_length", "orders", "o_orderkey % 8 = 1"),
        ("o_orderkey", "colors", "orders", "o_orderkey % 9 = 4"),
        ("o_orderkey", "voxel_size_m", "orders", "o_orderstatus = 'P'"),
        ("o_orderkey", "source_frame_ids", "orders", "o_orderkey % 20 = 11"),
        ("o_orderkey", "version", "orders", "o_orderkey = 0"),
        ("o_orderkey", "scale_source", "orders", "o_orderpriority = '5-LOW'"),
        ("o_orderkey", "faces", "orders", "o_orderkey % 22 = 13"),
    )
)
def mesh_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SRC-17, SNK-23, SNK-24, CHK-06, CHK-11, CHK-15, CHK-16, CHK-23, SET-09: mesh records written, read and checked."""
    k = F.col("o_orderkey")
    n = (k % 3 + 4).cast("int")
    rows = _spread(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").select(
        k.alias("key"), F.concat(F.lit("chunk_"), k.cast("string")).alias("chunk_id"), k.alias("version"), _identity().alias("T_world_chunk"),
        F.flatten(_sized(F.array(F.col("o_totalprice") / 1e5, F.lit(0.0), F.lit(1.5)), n)).alias("vertices_m"),
        F.array(*map(F.lit, (0, 1, 2, 0, 2)), F.when(k % 10 == 0, F.lit(99)).when(k % 22 == 13, F.lit(-1)).otherwise(F.lit(3))).cast("array<long>").alias("faces"),
        F.when(k % 4 == 1, F.flatten(_sized(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), n - F.when(k % 8 == 1, 1).otherwise(0)))).alias("normals"),
        F.when(k % 3 == 1, F.flatten(_sized(F.array(F.lit(10), F.lit(20), F.when(k % 9 == 4, F.lit(300)).otherwise(F.lit(30))), n))).cast("array<long>").alias("colors"),
        F.when(k % 5 == 2, F.flatten(_sized(F.array(F.lit(0.5), F.lit(0.25)), n))).alias("uvs"),
        F.when(k % 2 == 0, _sized(F.lit(-1).cast("long"), F.when(k % 6 == 0, 1).otherwise(2))).alias("object_id_per_face"), F.array(F.lit(0).cast("long"), k % 7).alias("surface_source_per_face"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0.0)).otherwise(F.lit(0.1)).alias("voxel_size_m"), F.lit(0.01).alias("mean_uncertainty_m"), F.lit(0.02).alias("p95_uncertainty_m"),
        F.when(k % 20 == 11, F.array().cast("array<long>")).otherwise(F.array(k, k + 1)).alias("source_frame_ids"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("guess")).otherwise(F.lit("known_anchor")).alias("scale_source"), F.array(*map(F.lit, K.TRUTH_FLAGS)).alias("flags"),
    )
    return R.violations(rows.withColumn("text", R.encode(R.MESH)).select("key", "text"), "text", R.MESH, "key").withColumnRenamed("key", "o_orderkey")


def _stats(low: Column, n: Column) -> Column:
    value = lambda x: F.when(n > 0, x)
    return F.struct(F.array(F.lit(24).cast("long"), F.lit(32).cast("long")).alias("shape"), F.lit("float32").alias("dtype"), n.cast("long").alias("count"), value(low).alias("min"), value(low + 0.1).alias("mean"), value(low + 0.2).alias("p50"), value(low + 0.3).alias("p95"), value(low + 0.4).alias("max"))


def _shape(dtype: Column | str, present: Column | None = None) -> Column:
    out = F.struct(F.array(F.lit(24).cast("long"), F.lit(32).cast("long")).alias("shape"), (F.lit(dtype) if isinstance(dtype, str) else dtype).alias("dtype"))
    return out if present is None else F.when(present, out)


def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    camera = F.struct(F.lit(32).cast("long").alias("width"), (F.lit(24).cast("long") - F.when(k % 15 == 4, 24).otherwise(0)).alias("height"), F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ((30, 0, 15.5), (0, 30, 11.5), (0, 0, 1))]).alias("K"), F.lit("none").alias("distortion_model"), F.lit(None).cast("array<double>").alias("distortion_params"), F.lit(None).cast("double").alias("rolling_shutter_row_time_s"), F.lit(1.0).alias("confidence"), F.lit("rig").alias("source"))
    square = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(4)]) for i in range(4)])
    spread = F.struct((k % 16 != 3).alias("covariance_6x6_present"), F.array(F.lit(0.1)).alias("translation_std_m"), F.array(F.lit(0.1)).alias("rotation_std"), F.lit(0.1).alias("max_std"))
    pose = F.struct(square.alias("T_world_camera"), F.array(*[F.lit(float(i == 3)) for i in range(4)]).alias("q_world_camera_xyzw"), F.array(*[F.lit(0.0)] * 3).alias("camera_center_world_m"), F.lit(None).cast("array<array<double>>").alias("covariance_6x6"), F.lit("OK").alias("tracking_state"), F.lit(0.5).alias("confidence"), F.lit("rgb_prior").alias("scale_source"), F.lit(True).alias("has_covariance_6x6"), spread.alias("uncertainty"), F.lit("{}").alias("diagnostics"))
    tensors = F.struct(*[_shape("float32").alias(c) for c in K.ARRAY_KEYS if c != "static_mask"], _shape(F.when(k % 18 == 7, F.lit("")).otherwise(F.lit("bool"))).alias("static_mask"), _shape("float32", k % 2 == 0).alias("object_embeddings"), _shape("float32", k % 3 == 0).alias("object_mask_logits"))
    matches = F.when(k % 4 == 0, F.struct(k.alias("source_frame_id"), (k + 1).alias("target_frame_id"), (k % 50 - 1).alias("match_count"), _stats(F.lit(0.1), F.lit(5)).alias("confidence_summary")))
    path = F.format_string("arrays/frame_%06d.npz", k)
    return _spread(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").select(
        k.alias("key"), k.alias("frame_id"), (k * 33_333_333).alias("timestamp_ns"), F.lit("world").alias("coordinate_frame"), F.when(F.col("o_orderstatus") == "P", F.lit("mixed")).otherwise(F.lit("rgb_prior")).alias("scale_source"), camera.alias("camera"), pose.alias("pose"),
        _stats(F.col("o_totalprice") / 600_000, F.lit(1)).alias("confidence_summary"), _stats(F.lit(0.01), k % 5).alias("uncertainty_summary"), _stats((k % 40 - 1).cast("double"), F.lit(1)).alias("depth_summary"),
        tensors.alias("tensor_shapes"), matches.alias("dense_matches"), F.when(k % 25 == 6, F.concat(F.lit("../"), path)).when(k % 25 == 7, F.lit("other/x.npz")).when(k % 2 == 0, path).alias("arrays_path"),
    )


@query(
    union(
        ("o_orderkey AS frame_id", "camera", "orders", "o_orderkey % 15 = 4"),
        ("o_orderkey AS frame_id", "pose", "orders", "o_orderkey % 16 = 3"),
        ("o_orderkey AS frame_id", "scale_source", "orders", "o_orderstatus = 'P'"),
        ("o_orderkey AS frame_id", "confidence_summary", "orders", "o_totalprice / 600000 + 0.4 > 1"),
        ("o_orderkey AS frame_id", "depth_summary", "orders", "o_orderkey % 40 = 0"),
        ("o_orderkey AS frame_id", "tensor_shapes", "orders", "o_orderkey % 18 = 7"),
        ("o_orderkey AS frame_id", "dense_matches", "orders", "o_orderkey % 4 = 0 AND o_orderkey % 50 = 0"),
        ("o_orderkey AS frame_id", "arrays_below", "orders", "o_orderkey % 25 IN (6, 7)"),
    )
)
def frame_summary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-22, CHK-35, CHK-36, CHK-44, CHK-51, SRC-21, SRC-38, SRC-39: summary rows of a cache written, read and checked."""
    rows = summary_rows(spark, sf_dir)
    text = F.to_json(F.struct(*[F.col(n) for n in sorted(R.FRAME_SUMMARY.fields)]), {"ignoreNullFields": "false"})
    return R.violations(rows.select("key", text.alias("text")), "text", R.FRAME_SUMMARY, "key").withColumnRenamed("key", "frame_id")


@query(
    union(
        ("n_nationkey", "availability", "nation", "n_nationkey % 4 = 3"),
        ("n_nationkey", "capabilities", "nation", "n_nationkey % 5 = 2"),
        ("n_nationkey", "reason", "nation", "n_nationkey % 6 = 1"),
        ("n_nationkey", "name", "nation", "n_nationkey = 7"),
    )
)
def adapter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-40, UDF-05, UDF-06: adapter statuses written, read and checked."""
    k = F.col("n_nationkey")
    flags = [F.when(~((k % 5 == 2) & F.lit(i == 3)), F.lit(i % 2 == 0)).alias(c) for i, c in enumerate(R.CAPABILITIES)]
    rows = table(spark, sf_dir, "nation").select(
        k.alias("key"), F.when(k == 7, F.lit("")).otherwise(F.col("n_name")).alias("name"), F.col("n_name").alias("display_name"), F.element_at(F.array(*map(F.lit, (*R.AVAILABILITY, "soon"))), (k % 4 + 1).cast("int")).alias("availability"),
        F.struct(*flags, F.array(F.lit("note")).alias("notes")).alias("capabilities"), F.lit(None).cast("string").alias("install_hint"), F.when(k % 6 == 1, F.lit("")).when(k % 6 == 2, F.lit("missing module")).alias("reason"),
    )
    return R.violations(rows.withColumn("text", R.encode(R.ADAPTER)).select("key", "text"), "text", R.ADAPTER, "key").withColumnRenamed("key", "n_nationkey")


@query(
    union(
        ("c_custkey AS map_id", "mesh_chunks", "customer", "c_custkey % 9 = 4"),
        ("c_custkey AS map_id", "chunk_keys", "customer", "c_custkey % 9 = 4 OR c_custkey % 8 = 1"),
        ("c_custkey AS map_id", "no_objects", "customer", "c_custkey % 10 = 3"),
        ("c_custkey AS map_id", "no_keyframes", "customer", "c_custkey % 12 = 6"),
        ("c_custkey AS map_id", "global_confidence", "customer", "c_acctbal < 0"),
    )
)
def world_map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-25, SNK-26, AGG-24, SRT-06: world maps written, read and checked."""
    k = F.col("c_custkey")
    name, other = F.concat(F.lit("chunk_"), k.cast("string")), F.lit("other")
    chunk = lambda key, own: F.concat(F.lit('{"'), key, F.lit('": {"chunk_id": "'), own, F.lit('"}}'))
    mean = F.struct((F.col("c_acctbal") / 10_000).alias("mean"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("key"), k.cast("string").alias("map_id"), F.lit("world").alias("world_frame_name"), F.lit(0).cast("long").alias("created_at_ns"),
        F.when(k % 9 == 4, F.lit("[]")).when(k % 8 == 1, chunk(name, other)).otherwise(chunk(name, name)).alias("mesh_chunks"), F.when(k % 10 == 3, F.lit('{"1": {}}')).otherwise(F.lit("{}")).alias("objects"),
        F.when(k % 12 == 6, F.lit('{"1": {}}')).otherwise(F.lit("{}")).alias("keyframes"), F.lit("known_anchor").alias("scale_source"), mean.alias("stats"), F.lit("{}").alias("metadata"),
    ).withColumn("global_confidence", R.global_confidence("stats"))
    return R.violations(rows.withColumn("text", R.encode(R.WORLD_MAP)).select("key", "text"), "text", R.WORLD_MAP, "key").withColumnRenamed("key", "map_id")


@query(
    union(
        ("event_id", "memory_counters", "events", "CAST(floor(value) AS BIGINT) > 60 OR event_id % 23 = 5"),
        ("event_id", "paths", "events", "event_type = 'error'"),
        ("event_id", "stage_name", "events", "event_id % 40 = 0"),
        ("event_id", "latency_ns", "events", "event_id % 33 = 1"),
        ("event_id", "frame_id", "events", "event_id % 27 = 8"),
    )
)
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-17, SNK-27, SRC-27, CHK-45, CHK-48, SET-10, SRT-05: run events written, read and checked."""
    k = F.col("event_id")
    held = F.floor("value").cast("long")
    counters = F.struct(F.lit(60).cast("long").alias("configured_frame_array_bound"), held.alias("frame_arrays_in_memory"), held.alias("peak_frame_arrays_in_memory"), k.alias("processed_frame_count"), F.when(k % 23 == 5, -1).otherwise(0).cast("long").alias("dropped_frame_count"), F.lit(0).cast("long").alias("queued_frame_count"))
    rows = table(spark, sf_dir, "events").select(
        k.alias("key"), k.alias("event_index"), F.when(k % 40 == 0, F.lit("")).otherwise(F.col("event_type")).alias("stage_name"), F.when(k % 27 == 8, -k).when(k % 2 == 0, k).alias("frame_id"), (k * 1_000_000).alias("timestamp_ns"), F.when(k % 33 == 1, -1).otherwise(0).cast("long").alias("latency_ns"),
        F.lit(False).alias("dropped_frame"), counters.alias("memory_counters"), F.create_map(F.lit("output"), F.when(F.col("event_type") == "error", F.lit("../up")).otherwise(F.col("event_type"))).alias("paths"), F.col("props").alias("metadata"), F.lit("event").alias("format_name"), F.lit(1).cast("long").alias("format_version"),
    )
    return R.violations(rows.withColumn("text", R.encode(R.EVENT)).select("key", "text"), "text", R.EVENT, "key").withColumnRenamed("key", "event_id")


@query(
    union(
        ("r_regionkey", "arrays", "region", "r_regionkey = 1"),
        ("r_regionkey", "known_scales", "region", "r_regionkey = 2"),
        ("r_regionkey", "frame_counts", "region", "r_regionkey = 3"),
        ("r_regionkey", "ids_ascend", "region", "r_regionkey = 4"),
        ("r_regionkey", "adapter", "region", "r_regionkey = 4"),
    )
)
def cache_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, CHK-33, CHK-34, JOI-06: headers of prediction caches written, read and checked."""
    k = F.col("r_regionkey")
    ids = F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])
    arrays = F.struct((k % 2 == 0).alias("stored"), F.when(k != 1, F.lit("arrays")).otherwise(F.lit("arrays")).alias("directory"), F.array(*map(F.lit, (*K.ARRAY_KEYS, *R.OPTIONAL_ARRAYS))).alias("optional_npz_keys"))
    arrays = F.when(k == 3, F.struct(F.lit(False).alias("stored"), F.lit(None).cast("string").alias("directory"), F.array(*map(F.lit, (*R.OPTIONAL_ARRAYS, *K.ARRAY_KEYS))).alias("optional_npz_keys"))).otherwise(arrays)
    rows = table(spark, sf_dir, "region").select(
        k.alias("key"), F.lit("prediction_cache").alias("format_name"), F.lit(1).cast("long").alias("format_version"), F.when(k == 4, F.lit("null")).otherwise(F.lit('{"name": "fixture"}')).alias("adapter"), F.lit("world").alias("coordinate_frame"),
        F.when(k == 3, 4).otherwise(3).cast("long").alias("frame_count"), F.when(k == 4, F.reverse(ids)).otherwise(ids).alias("frame_ids"), F.array(F.when(k == 2, F.lit("guess")).otherwise(F.lit("rgb_prior"))).alias("scale_sources"), F.lit("frame_summaries.jsonl").alias("frame_summaries_path"), arrays.alias("arrays"),
    )
    return R.violations(rows.withColumn("text", R.encode(R.CACHE)).select("key", "text"), "text", R.CACHE, "key").withColumnRenamed("key", "r_regionkey")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small image a vector: 2 x 3 values of its components."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda start: F.transform(F.slice("embedding", start, 6), lambda x: F.abs(x.cast("double")))
    return e.select(F.col("vec_id"), F.col("label"), F.col("vec_id").alias("frame_id"), F.lit(3).cast("long").alias("width"), F.lit(2).cast("long").alias("height"), part(1).alias("a"), part(7).alias("b"), part(13).alias("c"))


@query(
    union(
        ("vec_id", "depth", "embeddings", "label = 1"),
        ("vec_id", "sigma", "embeddings", "label = 2"),
        ("vec_id", "confidence", "embeddings", "list_max(list_transform(embedding[13:18], lambda x: abs(x::DOUBLE))) * 4 > 1"),
        ("vec_id", "static_mask", "embeddings", "label = 4"),
        ("vec_id", "object_id", "embeddings", "label = 5"),
        ("vec_id", "rgb", "embeddings", "label = 6"),
        ("vec_id", "K", "embeddings", "label = 7"),
        ("vec_id", "T_world_camera", "embeddings", "label = 8"),
        ("vec_id", "source", "embeddings", "label = 9"),
        ("vec_id", "image_size", "embeddings", "vec_id % 50 = 0"),
        ("vec_id", "depth", "embeddings", "vec_id % 50 = 0 AND label <> 1"),
        ("vec_id", "sigma", "embeddings", "vec_id % 50 = 0 AND label <> 2"),
        ("vec_id", "confidence", "embeddings", "vec_id % 50 = 0 AND NOT list_max(list_transform(embedding[13:18], lambda x: abs(x::DOUBLE))) * 4 > 1"),
        ("vec_id", "object_id", "embeddings", "vec_id % 50 = 0 AND label <> 5"),
        ("vec_id", "rgb", "embeddings", "vec_id % 50 = 0 AND label = 3"),
    )
)
def observation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-17, CHK-18, CHK-24, CHK-25, GEO-36, GEO-37: frame rows for fusion, checked."""
    label = F.col("label")
    rows = _images(spark, sf_dir).withColumn("width", F.when(F.col("vec_id") % 50 == 0, F.lit(0)).otherwise(F.lit(3)).cast("long"))
    rows = rows.select(
        "vec_id", "frame_id", "width", "height", F.array(*[F.when((label == 7) & F.lit(i == 0), F.lit(-1.0)).otherwise(F.lit(float(x))) for i, x in enumerate((8, 0, 1, 0, 8, 0.5, 0, 0, 1))]).alias("K"),
        F.transform(_identity(), lambda x, i: F.when((label == 8) & (i == 15), F.lit(2.0)).otherwise(x)).alias("T_world_camera"), F.transform("a", lambda x, i: F.when((label == 1) & (i == 2), -x - 1).otherwise(x)).alias("depth"),
        F.when(label == 2, F.slice("b", 1, 5)).otherwise(F.col("b")).alias("sigma"), F.transform("c", lambda x: x * 4).alias("confidence"), F.when(label == 4, F.array(F.lit(2.0), *[F.lit(0.0)] * 5)).alias("static_mask"),
        F.when(label == 5, F.array(F.lit(1), F.lit(None).cast("int"))).otherwise(_sized(F.lit(-1), 6)).alias("object_id"), F.when(label == 6, _sized(F.lit(7), 6)).when(label == 3, _sized(F.lit(7), 18)).alias("rgb"), F.when(label == 9, F.lit("")).otherwise(F.lit("rig")).alias("source"),
    )
    return K.violations(rows, "vec_id", R.observation_checks())


@query(
    union(
        ("vec_id", "unknown_keys", "embeddings", "label = 1"),
        ("vec_id", "missing_keys", "embeddings", "label = 2"),
        ("vec_id", "depth_m", "embeddings", "label = 3"),
        ("vec_id", "confidence", "embeddings", "label = 4"),
        ("vec_id", "normal_camera_shape", "embeddings", "label = 5"),
        ("vec_id", "object_embeddings", "embeddings", "label = 6"),
        ("vec_id", "point_world", "embeddings", "label = 7"),
    )
)
def payload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06, CHK-37, CHK-38, CHK-49, CHK-50, JOI-07, SRC-20: payloads of a cache against their summaries."""
    label = F.col("label")
    flat, deep = F.array(F.col("height"), F.col("width")), F.array(F.col("height"), F.col("width"), F.lit(3).cast("long"))
    shape = lambda s: F.struct(s.alias("shape"), F.lit("float32").alias("dtype"))
    tensors = F.struct(*[shape(F.when((label == 5) & F.lit(k == "normal_camera"), flat).otherwise(deep) if k in ("normal_camera", "point_world") else flat).alias(k) for k in K.ARRAY_KEYS], F.when(label == 6, shape(flat)).alias("object_embeddings"), F.lit(None).cast("struct<shape:array<long>,dtype:string>").alias("object_mask_logits"))
    rows = _images(spark, sf_dir).select(
        "vec_id", "height", "width", F.filter(F.array(*[F.when(~((label == 2) & F.lit(k == "static_mask")), F.lit(k)) for k in K.ARRAY_KEYS], F.when(label == 1, F.lit("extra"))), lambda x: x.isNotNull()).alias("keys"),
        F.transform("a", lambda x: F.when(label == 3, -x - 1).otherwise(x)).alias("depth_m"), F.col("b").alias("depth_sigma_m"), F.flatten(_sized(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), 6)).alias("normal_camera"),
        F.transform(F.concat("a", "b", "c"), lambda x, i: F.when((label == 7) & (i == 3), F.lit(float("nan"))).otherwise(x)).alias("point_world"), F.transform("c", lambda x: F.when(label == 4, x + 1.5).otherwise(F.least(x, F.lit(1.0)))).alias("confidence"), _sized(F.lit(1.0), 6).alias("static_mask"), tensors.alias("tensor_shapes"),
    )
    return K.violations(rows, "vec_id", R.payload_checks())


@query(
    union(
        ("vec_id", "frame_ids", "embeddings", "label = 1"),
        ("vec_id", "images", "embeddings", "label = 2"),
        ("vec_id", "images_unit", "embeddings", "label = 3"),
        ("vec_id", "K", "embeddings", "label = 4"),
        ("vec_id", "focal", "embeddings", "label = 5"),
        ("vec_id", "T_prior", "embeddings", "label = 6"),
        ("vec_id", "coordinate_frame", "embeddings", "label = 7"),
        ("vec_id", "metadata", "embeddings", "label = 8"),
    )
)
def clip_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-13, CHK-27..29, CHK-56, GEO-41: clips of two frames, checked."""
    label = F.col("label")
    camera = F.array(*[F.when((label == 5) & F.lit(i == 4), F.lit(0.0)).otherwise(F.lit(float(x))) for i, x in enumerate((8, 0, 1, 0, 8, 0.5, 0, 0, 1))])
    image = F.transform(F.concat("a", "b", "c", "a", "b", "c"), lambda x, i: F.when((label == 3) & (i == 0), F.lit(1.5)).otherwise(F.least(x, F.lit(1.0))))
    rows = _images(spark, sf_dir).select(
        "vec_id", "height", "width", F.array(F.col("frame_id"), F.col("frame_id") + F.when(label == 1, 0).otherwise(1)).alias("frame_ids"), F.when(label == 2, F.slice(image, 1, 30)).otherwise(image).alias("images"),
        F.when(label == 4, F.slice(camera, 1, 8)).when(F.col("vec_id") % 2 == 0, F.concat(camera, camera)).otherwise(camera).alias("K"),
        F.when(label == 6, F.concat(_identity(), F.reverse(_identity()), F.array(F.lit(0.0)))).when(label == 0, F.concat(_identity(), _identity())).alias("T_prior"), F.when(label == 7, F.lit("z_up")).otherwise(F.lit(R.CAMERA_FRAME)).alias("coordinate_frame"), F.when(label == 8, F.lit("[1]")).otherwise(F.lit("{}")).alias("metadata"),
    )
    return K.violations(rows, "vec_id", R.clip_checks())


@query(
    union(
        ("vec_id", "depth", "embeddings", "label = 1"),
        ("vec_id", "sigma", "embeddings", "label = 2"),
        ("vec_id", "confidence", "embeddings", "label = 3"),
        ("vec_id", "center", "embeddings", "label = 4"),
        ("vec_id", "flags", "embeddings", "label IN (5, 6)"),
        ("vec_id", "student_flags", "embeddings", "label = 7"),
    )
)
def model_output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-26, CHK-46, CHK-47, CHK-55: outputs of a model and what a checkpoint states of itself, checked."""
    label = F.col("label")
    flags = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), (F.when((label == 5) & F.lit(k == "accuracy_report"), F.lit(True)).otherwise(F.lit(v))).alias("value")) for k, v in R.TRAINING_FLAGS.items()]))
    rows = _images(spark, sf_dir).select(
        "vec_id", "height", "width", F.when(label == 1, F.transform("a", lambda x: -x - 1)).otherwise(F.col("a")).alias("depth"), F.when(label == 2, F.concat("b", "b")).otherwise(F.col("b")).alias("sigma"), F.transform("c", lambda x: F.when(label == 3, x + 2).otherwise(F.least(x, F.lit(1.0)))).alias("confidence"),
        F.array(F.lit(0.0), F.when(label == 4, F.lit(float("inf"))).otherwise(F.lit(1.0)), F.lit(2.0)).alias("center"), F.when(label == 6, F.map_filter(flags, lambda k, v: k != "training_mvp")).otherwise(flags).alias("flags"),
        (label % 2 == 1).alias("shape_only"), (label == 7).alias("learned_inference"), F.lit(False).alias("usable_for_mapping"), F.lit(False).alias("accuracy_report"), F.lit(False).alias("performance_report"),
    )
    checks = R.output_checks() | {"flags": R.training_flags("flags"), "student_flags": K.truth_boundary(R.STUDENT_FLAGS[0], R.STUDENT_FLAGS[1:])}
    return K.violations(rows, "vec_id", checks)


@query("SELECT user_id, count(DISTINCT (event_type, event_id % 2)) AS shapes FROM events WHERE event_id % 40 < 3 GROUP BY user_id HAVING count(DISTINCT (event_type, event_id % 2)) <> 1")
def shared_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-31: groups whose rows don't agree in shape."""
    rows = table(spark, sf_dir, "events").where("event_id % 40 < 3").withColumn("odd", F.col("event_id") % 2)
    return R.shared_shape(rows, "user_id", "event_type", "odd")


@query("""WITH x AS (SELECT c_custkey, c_mktsegment, c_name, MAP {'batch': c_mktsegment, 'rig': 'a'} AS base, CASE WHEN c_custkey % 5 = 0 THEN MAP {'source': 'x'} ELSE MAP {'rig': c_name} END AS extra FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'batch=' || c_mktsegment || ';rig=' || c_name END AS merged FROM x""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-32: extra metadata merged over a batch's own, reserved keys refused."""
    base = F.create_map(F.lit("batch"), F.col("c_mktsegment"), F.lit("rig"), F.lit("a"))
    extra = F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("source"), F.lit("x"))).otherwise(F.create_map(F.lit("rig"), F.col("c_name")))
    both = R.merged_metadata(base, extra)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query(
    union(
        ("o_orderkey", "pairs", "orders", "o_orderkey % 6 = 1"),
        ("o_orderkey", "shares", "orders", "o_totalprice > 400000"),
        ("o_orderkey", "ragged", "orders", "o_orderkey % 11 = 3"),
        ("o_orderkey", "pairs", "orders", "o_orderkey % 11 = 3 AND o_orderkey % 6 <> 1"),
    )
)
def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-16, CHK-18: dense matches of two frames written, read and checked."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("key"), k.alias("source_frame_id"), (k + 1).alias("target_frame_id"), F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]).alias("source_pixels_uv"), F.array(*[F.lit(float(x)) for x in (2, 2, 4, 4)]).alias("target_pixels_uv"),
        _sized(F.col("o_totalprice") / 400_000, F.when(k % 6 == 1, 3).otherwise(2)).alias("confidence"),
    )
    text = R.encode(R.MATCHES)
    text = F.when(F.col("key") % 11 == 3, F.regexp_replace(text, r'"source_pixels_uv":\[\[1\.0,', '"source_pixels_uv":[[')).otherwise(text)
    return R.violations(rows.withColumn("text", text).select("key", "text"), "text", R.MATCHES, "key").withColumnRenamed("key", "o_orderkey")
