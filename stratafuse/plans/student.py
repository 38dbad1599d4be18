"""A tiny convolutional depth and pose model: training, checkpoints, scoring and fusion of what it predicts.

Training is synthetic: random rooms of known depth. The network is small enough for NumPy: three
3x3 convolutions, 1x1 heads for depth, sigma and confidence, and a pooled head for the camera's
centre. Scoring runs in executors over frame packets, a frame at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import checks as K
from stratafuse.operators import fusion as U
from stratafuse.operators import records as R
from stratafuse.operators import rooms as M
from stratafuse.operators import scenes as S
from stratafuse.operators import summaries as A
from stratafuse.plans import artifacts as P
from stratafuse.plans import previews as V
from stratafuse.session import stored
from stratafuse.sources import clips
from stratafuse.sources import texts as X

SOURCE = "tiny_depth_pose_checkpoint_inference"
LEAST = 1e-4
#: Frames whose mean confidence is lower are LOW_CONFIDENCE.
SURE = 0.25


@dataclass
class Network:
    """Weights by name. Images are (n, 3, height, width) in 0..1."""

    hidden: int = 24
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def random(cls, hidden: int = 24, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda fan, *shape: rng.uniform(-1, 1, shape).astype(np.float32) / np.float32(np.sqrt(fan))
        w = {}
        for i, c in enumerate((3, hidden, hidden)):
            w[f"conv{i}"], w[f"conv{i}_bias"] = draw(9 * c, 9 * c, hidden), draw(9 * c, hidden)
        w["maps"], w["maps_bias"] = draw(hidden, hidden, 3), draw(hidden, 3)
        w["pool"], w["pool_bias"] = draw(hidden, hidden, hidden), draw(hidden, hidden)
        w["center"], w["center_bias"] = draw(hidden, hidden, 3), draw(hidden, 3)
        return cls(hidden, w)

    def forward(self, images: np.ndarray) -> tuple[dict[str, np.ndarray], list]:
        """Outputs (depth, sigma, confidence: n x height x width; center: n x 3), and what the gradient needs."""
        w, kept = self.weights, []
        x = images.transpose(0, 2, 3, 1)
        for i in range(3):
            patches = _patches(x)
            x = np.maximum(patches @ w[f"conv{i}"] + w[f"conv{i}_bias"], 0)
            kept.append((patches, x))
        maps = x @ w["maps"] + w["maps_bias"]
        pooled = x.mean((1, 2))
        inner = np.maximum(pooled @ w["pool"] + w["pool_bias"], 0)
        out = {"depth": np.logaddexp(0, maps[..., 0]) + LEAST, "sigma": np.logaddexp(0, maps[..., 1]) + LEAST, "confidence": 1 / (1 + np.exp(-maps[..., 2])), "center": inner @ w["center"] + w["center_bias"]}
        return out, [kept, maps, pooled, inner]

    def gradients(self, grads: dict[str, np.ndarray], state: list) -> dict[str, np.ndarray]:
        """Gradients of the weights, given those of the outputs."""
        kept, maps, pooled, inner = state
        w, x = self.weights, state[0][-1][1]
        slope = 1 / (1 + np.exp(-maps))
        d_maps = np.stack([grads["depth"] * slope[..., 0], grads["sigma"] * slope[..., 1], grads["confidence"] * slope[..., 2] * (1 - slope[..., 2])], -1)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        out = {"maps": flat(x).T @ flat(d_maps), "maps_bias": flat(d_maps).sum(0), "center": inner.T @ grads["center"], "center_bias": grads["center"].sum(0)}
        d_inner = (grads["center"] @ w["center"].T) * (inner > 0)
        out |= {"pool": pooled.T @ d_inner, "pool_bias": d_inner.sum(0)}
        d = d_maps @ w["maps"].T + (d_inner @ w["pool"].T)[:, None, None] / (x.shape[1] * x.shape[2])
        for i in (2, 1, 0):
            patches, y = kept[i]
            d = d * (y > 0)
            out[f"conv{i}"], out[f"conv{i}_bias"] = flat(patches).T @ flat(d), flat(d).sum(0)
            if i:
                d = _unpatched(d @ w[f"conv{i}"].T)
        return out


def _patches(x: np.ndarray) -> np.ndarray:
    """The 3x3 neighbourhood of each pixel, zeros beyond the edges: (n, h, w, 9 c)."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
    h, w = x.shape[1:3]
    return np.concatenate([p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], -1)


def _unpatched(d: np.ndarray) -> np.ndarray:
    """Sum of the gradients that each pixel has in the neighbourhoods of others."""
    n, h, w, c = *d.shape[:3], d.shape[3] // 9
    out = np.zeros((n, h + 2, w + 2, c), d.dtype)
    for k in range(9):
        i, j = divmod(k, 3)
        out[:, i : i + h, j : j + w] += d[..., k * c : (k + 1) * c]
    return out[:, 1:-1, 1:-1]


def losses(out: dict[str, np.ndarray], target: dict[str, np.ndarray], weights: tuple[float, float, float, float] = (1.0, 0.05, 0.01, 0.1)) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Metrics (as :func:`stratafuse.operators.summaries.prediction_losses` defines them) and gradients of the total."""
    e = out["depth"] - target["depth"]
    a, n = np.abs(e), e.size
    sigma = np.clip(out["sigma"], LEAST, 10.0)
    inside = (out["sigma"] > LEAST) & (out["sigma"] < 10.0)
    c, m = out["confidence"] - target["confidence"], out["center"] - target["center"]
    part = {"loss_depth": np.where(a < 1, a * a / 2, a - 0.5).mean(), "loss_sigma_nll": (a / sigma + np.log(sigma)).mean(), "loss_confidence": (c * c).mean(), "loss_pose_center": np.abs(m).mean()}
    total = sum(w * v for w, v in zip(weights, part.values(), strict=True))
    metrics = {"loss_total": total, **part, "depth_mae_m": a.mean(), "depth_rmse_m": np.sqrt((e * e).mean()), "pose_center_mae_m": part["loss_pose_center"]}
    if not all(np.isfinite(v) for v in metrics.values()):
        raise ValueError("loss_total: is not finite")
    grads = {
        "depth": (weights[0] * np.clip(e, -1, 1) + weights[1] * np.sign(e) / sigma) / n, "sigma": weights[1] * inside * (1 / sigma - a / sigma**2) / n,
        "confidence": weights[2] * 2 * c / c.size, "center": weights[3] * np.sign(m) / m.size,
    }
    return {k: float(v) for k, v in metrics.items()}, grads


@dataclass(frozen=True)
class Config:
    steps: int = 200
    batch_size: int = 8
    num_samples: int = 64
    width: int = 64
    height: int = 48
    seed: int = 0
    learning_rate: float = 0.001
    log_every: int = 10

    def __post_init__(self):
        for name in ("steps", "batch_size", "num_samples", "width", "height", "log_every"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                raise ValueError(f"{name}: must be a positive integer")
        if self.learning_rate <= 0:
            raise ValueError("learning_rate: must be positive")


def _samples(spark: SparkSession, c: Config) -> dict[str, np.ndarray]:
    """The images and targets of the training rooms, which are ``num_samples`` small ones by choice."""
    t = M.room_observations(M.random_rooms(spark, c.num_samples, c.width, c.height, c.seed)).select("frame_id", "depth", "rgb", F.array("K").alias("K"), *[F.col("T_world_camera")[i].alias(n) for n, i in (("ox", 3), ("oy", 7), ("oz", 11))]).orderBy("frame_id").toArrow()
    shape = (c.num_samples, c.height, c.width)
    stack = lambda n, s: np.stack([np.asarray(x.values) for x in t.column(n)]).reshape(s)
    rgb = stack("rgb", (*shape, 3)).astype(np.uint8)
    return {"rgb": rgb, "depth": stack("depth", shape).astype(np.float32), "center": np.stack([t.column(n).to_numpy() for n in ("ox", "oy", "oz")], 1).astype(np.float32), "confidence": np.ones(shape, np.float32)}


def _planes(rgb: np.ndarray) -> np.ndarray:
    return rgb.transpose(0, 3, 1, 2).astype(np.float32) / np.float32(255)


def train(spark: SparkSession, output: str, config: Config | None = None) -> dict:
    """Overfit the network to random rooms (Adam) and write config, metrics, a sample prediction with
    its preview, the checkpoint and a summary below ``output``. Equal configurations give equal files."""
    c = config or Config()
    data, net, rng = _samples(spark, c), Network.random(seed=c.seed), np.random.default_rng(c.seed)
    X.write_json(f"{output}/config.json", asdict(c))
    X.write_text(f"{output}/metrics.jsonl", "")
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    best, metrics, lines = float("inf"), {}, []
    for step in range(1, c.steps + 1):
        rows = rng.integers(0, c.num_samples, size=c.batch_size)
        out, state = net.forward(_planes(data["rgb"][rows]))
        metrics, grads = losses(out, {k: data[k][rows] for k in ("depth", "confidence", "center")})
        for k, g in net.gradients(grads, state).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.weights[k] = (net.weights[k] - c.learning_rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        best = min(best, metrics["depth_mae_m"])
        if step == 1 or step % c.log_every == 0 or step == c.steps:
            lines.append({"format_name": "synthetic_overfit_metric", "step": step, **metrics})
            X.append_json_line(f"{output}/metrics.jsonl", lines[-1])
    save(net, f"{output}/checkpoint_last.npz", c.steps, asdict(c), metrics)
    out, _ = net.forward(_planes(data["rgb"][:1]))
    error = np.abs(out["depth"][0] - data["depth"][0])
    X.write_npz(f"{output}/prediction_sample.npz", rgb_u8=data["rgb"][0], target_depth_m=data["depth"][0], predicted_depth_m=out["depth"][0].astype(np.float32), abs_depth_error_m=error.astype(np.float32), target_depth_sigma_m=np.full_like(error, M.SIGMA), predicted_depth_sigma_m=out["sigma"][0].astype(np.float32), target_confidence=data["confidence"][0], predicted_confidence=out["confidence"][0].astype(np.float32), target_camera_center_world_m=data["center"][0], predicted_camera_center_world_m=out["center"][0].astype(np.float32))
    v, u = np.divmod(np.arange(c.width * c.height), c.width)
    cells = np.column_stack([v, u, data["rgb"][0].reshape(-1, 3)]).tolist()
    px = spark.createDataFrame([(*map(int, r), float(t), float(p)) for r, t, p in zip(cells, data["depth"][0].ravel(), out["depth"][0].ravel(), strict=True)], "v int, u int, r int, g int, b int, target double, predicted double")
    previews = V.write_prediction_preview(px, metrics, R.TRAINING_FLAGS, output)
    summary = {"format_name": "synthetic_overfit_summary", "format_version": 1, "config": asdict(c), "final_metrics": metrics, "best_depth_mae_m": best, "artifacts": ["checkpoint_last.npz", "metrics.jsonl", "prediction_sample.npz", *previews], "truth_boundary": R.TRAINING_FLAGS}
    X.write_json(f"{output}/summary.json", summary)
    return {"output": output, "steps": c.steps, "final_loss": metrics["loss_total"], "first_loss": lines[0]["loss_total"], "best_depth_mae_m": best, "checkpoint": "checkpoint_last.npz", "truth_boundary": R.TRAINING_FLAGS}


# ---------------------------------------------------------------- checkpoints and scoring


def save(net: Network, path: str, step: int, config: dict, metrics: dict) -> None:
    head = {"format_name": "tiny_depth_pose_checkpoint", "format_version": 1, "step": step, "hidden_channels": net.hidden, "config": config, "metrics": metrics, "truth_boundary": R.TRAINING_FLAGS}
    X.write_npz(path, header=np.frombuffer(json.dumps(head, sort_keys=True).encode(), np.uint8), **{f"w_{k}": v for k, v in net.weights.items()})


def load(path: str) -> tuple[Network, dict]:
    """(network, header) of a checkpoint, which must be of this format and state what training states."""
    z = X.read_npz(X.read_bytes(path), path)
    try:
        head = json.loads(z["header"].tobytes())
    except (KeyError, ValueError) as e:
        raise ValueError(f"{path}: has no header") from e
    if (head.get("format_name"), head.get("format_version")) != ("tiny_depth_pose_checkpoint", 1):
        raise ValueError(f"{path}: format_name or format_version is not that of a checkpoint")
    for k, v in R.TRAINING_FLAGS.items():
        if head.get("truth_boundary", {}).get(k) is not v:
            raise ValueError(f"{path}: truth_boundary.{k} must be {str(v).lower()}")
    hidden = head.get("hidden_channels")
    if not isinstance(hidden, int) or hidden <= 0:
        raise ValueError(f"{path}: hidden_channels must be a positive integer")
    net = Network(hidden, {k[2:]: v for k, v in z.items() if k.startswith("w_")})
    want = {k: v.shape for k, v in Network.random(hidden).weights.items()}
    if {k: v.shape for k, v in net.weights.items()} != want:
        raise ValueError(f"{path}: weights are not those of the network")
    return net, head


SCORED = "frame_id long, depth array<float>, sigma array<float>, confidence array<float>, center array<double>"


def predict(packets: DataFrame, net: Network) -> DataFrame:
    """frame_id, depth, sigma, confidence (images, row-major) and center of each packet (frame_id, width, height, rgb bytes)."""
    shared = packets.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, w, h, rgb in zip(*(b.column(c).to_pylist() for c in ("frame_id", "width", "height", "rgb")), strict=True):
                image = np.frombuffer(bytes(rgb), np.uint8).reshape(1, h, w, 3)
                out, _ = shared.value.forward(_planes(image))
                maps = [pa.array([out[k][0].ravel().astype(np.float32)], pa.list_(pa.float32())) for k in ("depth", "sigma", "confidence")]
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int64()), *maps, pa.array([out["center"][0].astype(float)], pa.list_(pa.float64()))], [f.split()[0] for f in SCORED.split(", ")])

    return packets.select("frame_id", "width", "height", "rgb").mapInArrow(run, SCORED)


def placed(center: str, prior: str | None = None) -> Column:
    """T_world_camera of a predicted centre: the prior's rotation, or none."""
    c = tuple(G.float32(F.col(center)[i]) for i in range(3))
    plain = [F.lit(float(i % 4 == 0)) for i in range(9)]
    if prior is None:
        return G.make_transform(plain, c)
    return G.make_transform([F.coalesce(x, y) for x, y in zip(G.rotation_of(prior), plain, strict=True)], c)


def observations(packets: DataFrame, scored: DataFrame, scale_source: str = "rgb_prior") -> DataFrame:
    """Frame rows for fusion from packets and their predictions, with the pose's covariance, confidence and state."""
    rows = packets.select("frame_id", "timestamp_ns", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("K_model").alias("K")).join(scored, "frame_id")
    mean = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x.cast("double"))) / F.size(c)
    rows = rows.withColumns({"mean_confidence": mean("confidence", lambda x: x), "_v": mean("sigma", lambda x: x * x)})
    t = F.greatest(F.col("_v") * (1 + F.greatest(F.lit(0.0), 1 - F.col("mean_confidence"))), F.lit(1e-8))
    r = F.greatest(t * 0.01, F.lit(1e-8))
    covariance = F.array(*[(t if i < 21 else r) if i % 7 == 0 else F.lit(0.0) for i in range(36)])
    state = F.when(F.col("mean_confidence") >= SURE, "OK").otherwise("LOW_CONFIDENCE")
    none = F.lit(None)
    return rows.select(
        "frame_id", "timestamp_ns", "width", "height", "K", placed("center").alias("T_world_camera"), "depth", "sigma", "confidence", F.array_repeat(F.lit(1.0), F.size("depth")).alias("static_mask"), none.cast("array<int>").alias("object_id"), none.cast("array<int>").alias("rgb"), F.lit(SOURCE).alias("source"),
        covariance.alias("covariance_6x6"), "mean_confidence", state.alias("tracking_state"), F.lit(scale_source).alias("scale_source"),
    )


def room_packets(rooms: DataFrame) -> DataFrame:
    """Packets of rendered rooms."""
    o = M.room_observations(rooms)
    rgb = F.unhex(F.array_join(F.transform("rgb", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return o.select("frame_id", F.lit(0).cast("long").alias("timestamp_ns"), "width", "height", rgb.alias("rgb"), F.col("K").alias("K_original"), F.col("K").alias("K_model"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("resize"), F.lit("random_room").alias("source_format"), F.create_map(F.lit("source_format"), F.lit("random_room")).alias("metadata"))


def shape_only(clip: DataFrame) -> DataFrame:
    """Placeholder outputs of a clip's frames, with the flags that say so: depth and sigma 1, confidence and dynamic
    probability 0, normals along z, points 0, no motion."""
    n = F.col("height") * F.col("width")
    full = lambda x, k=1: F.array_repeat(F.lit(x), (n * k).cast("int"))
    frames = clip.select(F.posexplode("frame_ids").alias("place", "frame_id"), "height", "width", "K")
    own = F.when(F.size("K") == 9, F.col("K")).otherwise(F.slice("K", F.col("place") * 9 + 1, 9))
    return frames.select("frame_id", "place", full(1.0).alias("depth"), full(1.0).alias("sigma"), full(0.0).alias("confidence"), full(0.0).alias("dynamic_probability"), F.concat(full(0.0, 2), full(1.0)).alias("normals"), full(0.0, 3).alias("points"), F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)]).alias("T_world_camera"), own.alias("K"), F.lit(True).alias("shape_only"), *[F.lit(False).alias(f) for f in R.STUDENT_FLAGS[1:]])


# ---------------------------------------------------------------- fusion of predictions


def checkpoint_fusion(spark: SparkSession, checkpoint: str, output: str, input_clip: str | None = None, width: int = 32, height: int = 24, seed: int = 0, voxel: float = 0.1, truncation_voxels: float = 3.0) -> dict:
    """Score a clip (or one random room) and fuse the predictions; for a room its truth too, on the same grid, with a comparison."""
    for name, value in (("width", width), ("height", height)):
        if not isinstance(value, int) or value <= 0:
            raise ValueError(f"{name}: must be a positive integer")
    if voxel <= 0 or truncation_voxels <= 0:
        raise ValueError("voxel_size_m: it and the truncation must be positive")
    net, head = load(checkpoint)
    rooms = M.random_rooms(spark, 1, width, height, seed)
    packets = stored(clips.npz_packets(spark, input_clip) if input_clip else room_packets(rooms))
    seen = stored(observations(packets, predict(packets, net)))
    K.require(seen, "frame_id", R.observation_checks())
    size = seen.select("width", "height").distinct().collect()
    if len(size) != 1:
        raise ValueError("rgb_model: frames differ in size")
    lens = S.Scene(width=size[0]["width"], height=size[0]["height"])
    target = None if input_clip else stored(M.room_observations(rooms))
    pixels = lambda o: o.select("frame_id", "K", "T_world_camera", F.posexplode(F.arrays_zip("depth", "confidence")).alias("_p", "x")).select("K", "T_world_camera", F.expr(f"_p div {lens.width}").alias("v"), (F.col("_p") % lens.width).alias("u"), F.col("x.depth").alias("depth_m"), F.col("x.confidence").alias("confidence"))
    points = S.observed_points(pixels(seen), lens)
    points = points.unionByName(S.observed_points(pixels(target), lens)) if target is not None else points
    b = U.observation_bounds(points, voxel, voxel * truncation_voxels).first()
    if b["min_x"] is None:
        raise ValueError(f"{checkpoint}: no point of positive depth and confidence")
    grid = U.Grid(tuple(b[f"min_{c}"] for c in "xyz"), tuple(b[f"max_{c}"] for c in "xyz"), voxel, truncation_voxels)
    meta = {"source_cache": input_clip or "random_room", "adapter": SOURCE, "scale_sources": ["rgb_prior"], "input_kind": "npz_frame_packets" if input_clip else "random_room", "checkpoint_path": checkpoint, "checkpoint_step": head["step"], "truth_boundary": head["truth_boundary"], "frame_ids": [r[0] for r in seen.select("frame_id").orderBy("frame_id").collect()]}
    meta |= {"input_confidence_summary": _all_values(seen, "confidence"), "input_uncertainty_summary_m": _all_values(seen, "sigma")}
    flags = ["checkpoint_inference_bridge", *K.TRUTH_FLAGS]
    predicted = P.write_fused(spark, U.voxel_samples(seen, grid, lens), output, grid, seen.count(), meta | {"flags": flags})
    metrics = {"metric_family": "checkpoint_fusion_without_target", "accuracy_report": False, "n_surface": predicted["n_surface"], "truth_boundary": head["truth_boundary"]}
    if target is not None:
        truth = P.write_fused(spark, U.voxel_samples(target, grid, lens), f"{output}/target", grid, 1, {"input_kind": "random_room", "scale_sources": ["known_anchor"], "flags": ["checkpoint_target_reference", *K.TRUTH_FLAGS]})
        P.write_record(spark, f"{output}/target/metrics", {"metric_family": "target_reference", "accuracy_report": False})
        volumes = [spark.read.parquet(f"{f}/voxels") for f in (output, f"{output}/target")]
        common = U.compare_volumes(*volumes).first()
        both = seen.alias("p").join(target.alias("t"), "frame_id").select("frame_id", F.explode(F.arrays_zip(F.col("p.depth").alias("p"), F.col("t.depth").alias("t"))).alias("x"), F.col("p.T_world_camera").alias("a"), F.col("t.T_world_camera").alias("b"))
        errors = A.large_summary(both.select(F.abs(F.col("x.p").cast("double") - F.col("x.t")).alias("e")), "e").first()
        off = seen.alias("p").join(target.alias("t"), "frame_id").select(F.sqrt(sum(((F.col("p.T_world_camera")[i] - F.col("t.T_world_camera")[i]) ** 2 for i in (3, 7, 11)), F.lit(0.0))).alias("d")).first()["d"]
        metrics |= {"metric_family": "checkpoint_fusion_against_room", "depth_metrics_m": {"mae": errors["mean"], "p95_abs": errors["p95"], "max_abs": errors["max"]}, "camera_center_error_m": off, "n_target_surface": truth["n_surface"], "n_common": common["n_common"], "common_mean_abs_delta": common["mean_abs_delta"]}
    write_prediction(seen, target, f"{output}/prediction_sample.npz")
    P.write_record(spark, f"{output}/metrics", metrics)
    return metrics


def _all_values(rows: DataFrame, column: str) -> dict:
    """mean, p50, p95 and max over all values of an image column."""
    out = A.large_summary(rows.select(F.explode(column).alias("x")), "x").first()
    return {k: out[k] for k in ("mean", "p50", "p95", "max")}


def write_prediction(seen: DataFrame, target: DataFrame | None, path: str) -> None:
    """The predictions of a clip's frames (and a room's truth) as one NPZ file."""
    t = seen.orderBy("frame_id").toArrow()  # the frames of one clip
    shape = (t.num_rows, t.column("height")[0].as_py(), t.column("width")[0].as_py())
    image = lambda a, c: np.stack([np.asarray(x.values, np.float32) for x in a.column(c)]).reshape(shape)
    out = {"frame_ids": t.column("frame_id").to_numpy().astype(np.int32), "K": np.stack([np.asarray(x.values, np.float32).reshape(3, 3) for x in t.column("K")]), "predicted_T_world_camera": np.stack([np.asarray(x.values, np.float32).reshape(4, 4) for x in t.column("T_world_camera")])}
    out |= {f"predicted_{n}": image(t, c) for n, c in (("depth_m", "depth"), ("depth_sigma_m", "sigma"), ("confidence", "confidence"))}
    if target is not None:
        o = target.orderBy("frame_id").toArrow()
        out |= {"target_depth_m": image(o, "depth"), "abs_depth_error_m": np.abs(out["predicted_depth_m"] - image(o, "depth")), "target_T_world_camera": np.stack([np.asarray(x.values, np.float32).reshape(4, 4) for x in o.column("T_world_camera")])}
    X.write_npz(path, **out)
