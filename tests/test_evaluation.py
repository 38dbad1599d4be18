"""Evaluation records and their report, and the losses behind them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.operators import losses as L
from stratafuse.plans import cli
from stratafuse.plans import evaluation as E

BOX = "x double, y double, z double, sx double, sy double, sz double, yaw double"


def test_run_and_report(spark, tmp_path, capsys):
    r = random.Random(3)
    poses = [(t, i, *(p := [0.1 * i, r.random(), r.random()]), *[2 * x + 1 for x in p]) for t in range(3) for i in range(20)] + [(0, 20, None, None, None, 1.0, 1.0, 1.0)]
    spark.createDataFrame(poses, "track int, order int, ex double, ey double, ez double, px double, py double, pz double").write.parquet(f"{tmp_path}/poses")
    spark.createDataFrame([(1.0 + i % 5, 1.0 + i % 5 + 0.1 * (i % 3), i % 2) for i in range(100)], "target double, predicted double, scene int").write.parquet(f"{tmp_path}/depth")
    points = [(i, *(r.random() for _ in range(3))) for i in range(60)]
    spark.createDataFrame(points, "id long, x double, y double, z double").write.parquet(f"{tmp_path}/truth")
    spark.createDataFrame([(i, x + 0.02, y, z) for i, x, y, z in points], "id long, x double, y double, z double").write.parquet(f"{tmp_path}/found")
    boxes = [(i, 0, "a", 3.0 * i, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0) for i in range(4)]
    spark.createDataFrame(boxes, f"id long, frame_id long, label string, {BOX}").write.parquet(f"{tmp_path}/boxes")
    spark.createDataFrame([(*b[:3], 0.5, *b[3:]) for b in boxes[:3]], f"id long, frame_id long, label string, confidence double, {BOX}").write.parquet(f"{tmp_path}/guesses")
    spark.createDataFrame([(i, "fuse" if i % 2 else "read", float(i), 100.0 + i) for i in range(200)], "event_index long, stage string, latency_ms double, mb double").write.parquet(f"{tmp_path}/events")
    about = ["--dataset", "tables", "--split", "all", "--commit", "abc"]
    run = f"{tmp_path}/run"
    assert cli.main(["eval", "report", run]) == 2  # nothing recorded yet
    assert cli.main(["eval", "pose", run, "--input", f"{tmp_path}/poses", *about, "--scale-source", "rgb_prior"]) == 0
    assert cli.main(["eval", "depth", run, "--input", f"{tmp_path}/depth", *about, "--by", "scene"]) == 0
    assert cli.main(["eval", "mesh", run, "--input", f"{tmp_path}/found", "--truth", f"{tmp_path}/truth", *about, "--scale-source", "rgb_prior", "--voxel", "0.01"]) == 0
    assert cli.main(["eval", "objects", run, "--input", f"{tmp_path}/guesses", "--truth", f"{tmp_path}/boxes", *about]) == 0
    assert cli.main(["eval", "runtime", run, "--input", f"{tmp_path}/events", "--memory", "mb", *about]) == 0
    assert cli.main(["eval", "mesh", run, "--input", f"{tmp_path}/found", *about]) == 2 and cli.main(["eval", "pose", run, "--input", f"{tmp_path}/poses"]) == 2
    parts = {p: E.texts.read_json(f"{run}/{p}.json") for p in E.PARTS}
    assert parts["pose"]["metrics"]["alignment"] == "sim3" and parts["pose"]["metrics"]["ate_rmse_m"] < 1e-9 and parts["pose"]["metrics"]["lost"] == 1
    assert parts["depth"]["metrics"]["n"] == 100 and len(parts["depth"]["table"]) == 2
    assert parts["mesh"]["metrics"]["chamfer_m"] <= 0.02 + 1e-12 and parts["mesh"]["table"][-1]["f_score"] == 1.0
    assert parts["objects"]["metrics"]["map"] == pytest.approx(0.75)
    assert parts["runtime"]["metrics"]["memory_slope"] == pytest.approx(1.0)
    assert cli.main(["eval", "report", run]) == 0
    text = open(f"{run}/report.md").read()
    for said in ("1 poses have no estimate", "scale_source rgb_prior", "threshold 0.001 m is below the voxel", "mb grows by 1", "pose: checkpoint is not recorded", "commit: abc"):
        assert said in text
    capsys.readouterr()


def test_losses_against_loops(spark):
    rng = np.random.default_rng(4)
    t = rng.uniform(1, 5, 300)
    p = np.exp(np.log(t) * 0.9 + rng.normal(0, 0.05, 300))
    rows = [(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(p, t, strict=True))] + [(0, -1.0, 2.0), (0, float("inf"), 2.0), (1, None, 2.0), (7, 2.0, 3.0)]
    px = spark.createDataFrame(rows, "g int, p double, t double")
    e = np.log(p) - np.log(t)
    got = L.silog(px.where("g < 2"), "p", "t").first()
    assert got["n"] == 300 and got["silog"] == pytest.approx((e**2).mean() - 0.85 * e.mean() ** 2)
    for r in L.aligned_inverse_depth(px, "p", "t", "g").collect():
        if r["g"] == 7:
            assert (r["a"], r["b"], r["n"]) == (0.0, pytest.approx(1 / 3), 1)
            continue
        x, y = 1 / p[r["g"] :: 2], 1 / t[r["g"] :: 2]
        a, b = np.polyfit(x, y, 1)
        assert (r["a"], r["b"]) == (pytest.approx(a), pytest.approx(b)) and r["loss"] == pytest.approx(np.sqrt((a * x + b - y) ** 2 + 1e-6).mean())
    q = rng.normal(0, 1, (50, 3))
    h = 0.4
    turn = np.array([[math.cos(h), 0, math.sin(h)], [0, 1, 0], [-math.sin(h), 0, math.cos(h)]])
    w = 1.5 * q @ turn.T + [1, 2, 3]
    pts = spark.createDataFrame([(0, *map(float, a), *map(float, b)) for a, b in zip(q, w, strict=True)], "g int, ex double, ey double, ez double, px double, py double, pz double")
    assert L.pointmap_errors(pts, "g", True).first()["loss"] == pytest.approx(1e-3, rel=1e-3)
    assert L.pointmap_errors(pts, "g").first()["loss"] == pytest.approx(np.sqrt(((w - q) ** 2).sum(1) + 1e-6).mean())


def test_points_on_their_rays_and_epipolar_lines(spark):
    rng = np.random.default_rng(5)
    k, h = np.array([[30.0, 0, 15.5], [0, 28.0, 11.5], [0, 0, 1]]), 0.3
    turn, t = np.array([[math.cos(h), 0, math.sin(h)], [0, 1, 0], [-math.sin(h), 0, math.cos(h)]]), np.array([0.4, -0.1, 0.2])
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = turn, t
    rows = []
    for i in range(40):
        u, v, d = float(rng.integers(0, 32)), float(rng.integers(0, 24)), float(rng.uniform(1, 3))
        world = turn @ (np.linalg.inv(k) @ [u, v, 1] * d) + t
        rows.append((i % 2, u, v, d + 0.1 * (i % 2), *map(float, world), k.ravel().tolist(), pose.ravel().tolist()))
    px = spark.createDataFrame(rows, "g int, u double, v double, depth_m double, x double, y double, z double, K array<double>, T_world_camera array<double>")
    got = {r["g"]: r for r in L.pointmap_consistency(px, ["g"]).collect()}
    assert got[0]["depth_error_m"] == pytest.approx(0, abs=1e-9) and got[1]["depth_error_m"] == pytest.approx(0.1) and got[1]["ray_error"] == pytest.approx(0, abs=1e-9)
    f = np.linalg.inv(k).T @ np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ turn @ np.linalg.inv(k)
    lit = lambda m: tuple(F.lit(float(x)) for x in np.ravel(m))
    value, sampson = L.epipolar_errors(L.fundamental(lit(turn), lit(t), lit(k), lit(k)), *[F.col(c) for c in ("a", "b", "c", "d")])
    matches = [(i, *map(float, rng.uniform(0, 30, 4))) for i in range(20)]
    for r in spark.createDataFrame(matches, "i int, a double, b double, c double, d double").select("*", value.alias("e"), sampson.alias("s")).collect():
        x, y = np.array([r["a"], r["b"], 1]), np.array([r["c"], r["d"], 1])
        e, line, back = y @ f @ x, f @ x, f.T @ y
        assert r["e"] == pytest.approx(abs(e)) and r["s"] == pytest.approx(e**2 / (line[:2] @ line[:2] + back[:2] @ back[:2]))
