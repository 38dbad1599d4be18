import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.operators import checks as K
from stratafuse.operators import records as R
from stratafuse.operators import rooms as M
from stratafuse.operators import summaries as A
from stratafuse.plans import artifacts as P
from stratafuse.plans import cli, student
from stratafuse.sources import clips


def plain_conv(x, w, b):
    """One 3x3 convolution with zero padding, as loops: x (h, w, c), w (9 c, out)."""
    h, wd, c = x.shape
    out = np.zeros((h, wd, w.shape[1]))
    for v in range(h):
        for u in range(wd):
            for k in range(9):
                i, j = v + k // 3 - 1, u + k % 3 - 1
                if 0 <= i < h and 0 <= j < wd:
                    out[v, u] += x[i, j] @ w[k * c : (k + 1) * c]
    return out + b


def test_network_against_loops_and_differences():
    rng = np.random.default_rng(0)
    net = student.Network.random(5, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    images = rng.uniform(0, 1, (2, 3, 4, 5))
    out, state = net.forward(images)
    x = images[1].transpose(1, 2, 0)
    for i in range(3):
        x = np.maximum(plain_conv(x, net.weights[f"conv{i}"], net.weights[f"conv{i}_bias"]), 0)
    maps = x @ net.weights["maps"] + net.weights["maps_bias"]
    assert np.allclose(out["depth"][1], np.log1p(np.exp(maps[..., 0])) + 1e-4) and np.allclose(out["confidence"][1], 1 / (1 + np.exp(-maps[..., 2])))
    target = {"depth": rng.uniform(1, 3, (2, 4, 5)), "confidence": np.ones((2, 4, 5)), "center": rng.normal(size=(2, 3))}
    _, grads = student.losses(out, target)
    found = net.gradients(grads, state)
    for name, w in net.weights.items():
        for place in [np.unravel_index(i, w.shape) for i in rng.integers(0, w.size, 3)]:
            old, loss = w[place], []
            for step in (1e-5, -1e-5):
                w[place] = old + step
                loss.append(student.losses(net.forward(images)[0], target)[0]["loss_total"])
            w[place] = old
            assert found[name][place] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-5), name


def test_losses_equal_the_aggregate(spark):
    rng = np.random.default_rng(2)
    out = {"depth": rng.uniform(0, 4, (1, 3, 4)), "sigma": rng.uniform(0, 1, (1, 3, 4)), "confidence": rng.uniform(0, 1, (1, 3, 4)), "center": rng.normal(size=(1, 3))}
    target = {"depth": rng.uniform(0, 4, (1, 3, 4)), "confidence": np.ones((1, 3, 4)), "center": rng.normal(size=(1, 3))}
    want, _ = student.losses(out, target)
    px = spark.createDataFrame([(0, *map(float, r)) for r in zip(out["depth"].ravel(), target["depth"].ravel(), out["sigma"].ravel(), out["confidence"].ravel(), target["confidence"].ravel(), strict=True)], "g int, depth double, target double, sigma double, confidence double, target_confidence double")
    centers = spark.createDataFrame([(0, *map(float, out["center"][0]), *map(float, target["center"][0]))], "g int, x double, y double, z double, tx double, ty double, tz double")
    got = A.prediction_losses(px, ["g"], centers).first().asDict()
    assert {k: got[k] for k in want} == pytest.approx(want)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("train"))
    return folder, student.train(spark, folder, student.Config(steps=60, batch_size=4, num_samples=6, width=16, height=12, log_every=20, learning_rate=0.01))


def test_training_learns_and_is_repeatable(spark, trained, tmp_path):
    folder, report = trained
    lines = [json.loads(x) for x in open(f"{folder}/metrics.jsonl")]
    assert [x["step"] for x in lines] == [1, 20, 40, 60] and lines[-1]["loss_total"] < 0.5 * lines[0]["loss_total"]
    again = student.train(spark, str(tmp_path), student.Config(steps=60, batch_size=4, num_samples=6, width=16, height=12, log_every=20, learning_rate=0.01))
    assert again["final_loss"] == report["final_loss"] and open(f"{folder}/prediction_preview.svg").read().count("<rect") == 1 + 4 * 16 * 12
    with pytest.raises(ValueError, match="steps"):
        student.Config(steps=0)


def test_checkpoint_fusion(spark, trained, tmp_path):
    net, head = student.load(f"{trained[0]}/checkpoint_last.npz")
    packets = student.room_packets(M.random_rooms(spark, 3, 16, 12, 0))
    seen = student.observations(packets, student.predict(packets, net))
    assert K.violations(seen, "frame_id", R.observation_checks()).isEmpty() and K.violations(seen.withColumn("center", F.array(*[F.lit(0.0)] * 3)), "frame_id", R.output_checks()).isEmpty()
    image = np.frombuffer(bytes(packets.where("frame_id = 1").first()["rgb"]), np.uint8).reshape(1, 12, 16, 3)
    assert np.allclose(seen.where("frame_id = 1").first()["depth"], net.forward(student._planes(image))[0]["depth"].ravel(), atol=1e-6)
    m = student.checkpoint_fusion(spark, f"{trained[0]}/checkpoint_last.npz", str(tmp_path / "o"), width=16, height=12)
    assert m["n_common"] > 0 and m["depth_metrics_m"]["mae"] < 1.5 and P.inspect_output(spark, str(tmp_path / "o"))["surface"]["checkpoint_step"] == 60
    assert P.inspect_output(spark, str(tmp_path / "o/target"))["surface"]["n_surface"] == m["n_target_surface"]
    rgb = np.random.default_rng(0).integers(0, 256, (2, 12, 16, 3), dtype=np.uint8)
    np.savez(tmp_path / "clip.npz", rgb_u8=rgb, K=np.array([[14, 0, 7.5], [0, 14, 5.5], [0, 0, 1.0]]))
    assert cli.main(["smoke", "checkpoint-tsdf", f"{trained[0]}/checkpoint_last.npz", str(tmp_path / "p"), "--input", str(tmp_path / "clip.npz")]) == 0
    assert "target_depth_m" not in np.load(tmp_path / "p/prediction_sample.npz").files
    clip = clips.student_clip(clips.npz_packets(spark, str(tmp_path / "clip.npz")))
    stub = student.shape_only(clip).collect()
    assert len(stub) == 2 and stub[0]["depth"] == [1.0] * 192 and stub[1]["normals"][-1] == 1.0 and stub[0]["shape_only"] and not stub[0]["usable_for_mapping"]
    assert K.violations(student.shape_only(clip), "frame_id", {"flags": K.truth_boundary(R.STUDENT_FLAGS[0], R.STUDENT_FLAGS[1:])}).isEmpty()
    prior = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, -1.0, 0.0, 9.0, 1.0, 0.0, 0.0, 9.0, 0.0, 0.0, 1.0, 9.0, 0.0, 0.0, 0.0, 1.0]), ([1.0, 2.0, 3.0], None)], "c array<double>, t array<double>")
    a, b = prior.select(student.placed("c", "t").alias("T")).collect()
    assert a["T"][:4] == [0, -1, 0, 1] and b["T"][:8] == [1, 0, 0, 1, 0, 1, 0, 2]


def test_broken_checkpoints(trained, tmp_path):
    with np.load(f"{trained[0]}/checkpoint_last.npz") as z:
        arrays = {k: z[k] for k in z.files}
    head = json.loads(arrays["header"].tobytes())
    text = lambda h: np.frombuffer(json.dumps(h).encode(), np.uint8)
    for change, message in (({"header": text(head | {"format_version": 2})}, "format"), ({"header": text(head | {"truth_boundary": head["truth_boundary"] | {"accuracy_report": True}})}, "accuracy_report"), ({"w_maps": np.zeros((2, 3))}, "weights"), ({"header": text(head | {"hidden_channels": 0})}, "hidden")):
        np.savez(tmp_path / "c.npz", **(arrays | change))
        with pytest.raises(ValueError, match=message):
            student.load(str(tmp_path / "c.npz"))
    with pytest.raises(ValueError, match="missing file"):
        student.load(str(tmp_path / "none.npz"))
