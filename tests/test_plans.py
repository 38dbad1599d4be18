import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.operators import fusion as U
from stratafuse.operators import scenes as S
from stratafuse.plans import artifacts as A
from stratafuse.plans import cli
from stratafuse.streaming import ingest


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    return folder, A.run_fixture(spark, folder)


def test_run_and_inspection(spark, run):
    folder, summary = run
    assert summary["n_events"] == 15 and summary["bounded"]
    report = A.inspect_run(spark, folder)
    assert report["fusion"]["surface"]["n_surface"] == 944 and report["fusion"]["mesh"]["n_samples"] == 944
    assert report["fusion"]["metrics"]["within_voxel_ratio"] == 1.0 and all(report["fusion"]["truth_boundary"].values())
    assert A.frame_payload(spark, f"{folder}/cache", 1).count() == 768
    with pytest.raises(A.ArtifactError, match="frame_id 9"):
        A.frame_payload(spark, f"{folder}/cache", 9)


def test_mutations_are_rejected(spark, run, tmp_path):
    folder, _ = run
    meta = A.read_record(spark, f"{folder}/fusion/metadata")
    A.write_record(spark, f"{folder}/fusion/metadata", meta | {"n_surface": 1})
    with pytest.raises(A.ArtifactError):
        A.inspect_output(spark, f"{folder}/fusion")
    A.write_record(spark, f"{folder}/fusion/metadata", meta)
    A.run_adapter(spark, "fixture-cube-room", f"{folder}/session", str(tmp_path / "c"), store_arrays=False)
    with pytest.raises(A.ArtifactError, match="no arrays"):
        A.replay_cache(spark, str(tmp_path / "c"), str(tmp_path / "o"))
    A.write_record(spark, str(tmp_path / "c/metadata"), A.read_record(spark, str(tmp_path / "c/metadata")) | {"n_frames": 4})
    with pytest.raises(A.ArtifactError, match="frame_ids"):
        A.load_cache(spark, str(tmp_path / "c"))
    with pytest.raises(KeyError):
        A.adapter_status("none")
    with pytest.raises(NotImplementedError):
        A.run_adapter(spark, "vggt", f"{folder}/session", str(tmp_path / "d"))


def test_command_line(spark, run, capsys):
    assert cli.main([]) == 0 and cli.main(["adapters", "list"]) == 0 and "fixture-cube-room\tavailable" in capsys.readouterr().out
    assert cli.main(["inspect", "session", f"{run[0]}/session"]) == 0
    assert cli.main(["adapters", "run", "nobody", "x", "y"]) == 2


def test_stream_equals_batch(spark, tmp_path):
    frames = S.fixed_frames(spark)
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.fuse_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = U.integrate(U.voxel_samples(S.render_frames(frames)))
    got = ingest.fused(spark, str(tmp_path / "out"))
    assert got.count() == want.count() == 2840
    both = got.alias("a").join(want.alias("b"), ["ix", "iy", "iz"])
    assert both.where(F.abs(F.col("a.tsdf") - F.col("b.tsdf")) > 1e-6).isEmpty()


@pytest.mark.parametrize("turned", [False, True])
def test_replay_of_a_cache_outside_the_room(spark, tmp_path, turned):
    rng = np.random.default_rng(5)
    w, h, centers, k = 8, 6, ((10.0, 5.0, -3.0), (10.2, 5.1, -3.1)), (9.0, 0.0, 3.25, 0.0, 8.0, 2.5, 0.0, 0.0, 1.0)
    a = 0.7 if turned else 0.0
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]], np.float32).astype(float)
    poses = []
    for c in centers:
        poses.append(np.eye(4))
        poses[-1][:3, :3], poses[-1][:3, 3] = r, np.float32(c)
    images = rng.uniform(1.5, 2.0, (2, h, w)).astype(np.float32), rng.uniform(0, 0.1, (2, h, w)).astype(np.float32), rng.choice([0, 0.25, 0.8, 1e-10], (2, h, w)).astype(np.float32)
    frames = spark.createDataFrame([(f, f, *c, list(k), p.ravel().tolist()) for f, (c, p) in enumerate(zip(centers, poses, strict=True))], "frame_id long, timestamp_ns long, ox double, oy double, oz double, K array<double>, T_world_camera array<double>")
    pixels = spark.createDataFrame([(f, v, u, *(float(x[f, v, u]) for x in images)) for f in range(2) for v in range(h) for u in range(w)], "frame_id long, v int, u int, depth_m float, depth_sigma_m float, confidence float")
    A.write_cache(spark, frames if turned else frames.drop("T_world_camera"), pixels, str(tmp_path / "c"), True, {"scale_source": "rgb_prior", "width": w, "height": h})
    assert cli.main(["smoke", "teacher-cache-tsdf", str(tmp_path / "c"), str(tmp_path / "o")]) == 0

    v, u = np.mgrid[:h, :w]
    points = []
    for f, p in enumerate(poses):
        d = images[0][f].astype(float)
        local = np.stack([(u - k[2]) / k[0] * d, (v - k[5]) / k[4] * d, d], -1)[images[2][f] > 0]
        points.append((local @ p[:3, :3].T + p[:3, 3]).astype(np.float32).astype(float))
    points = np.concatenate(points)
    low, high = np.floor((points.min(0) - 0.4) / 0.1) * 0.1, np.ceil((points.max(0) + 0.4) / 0.1) * 0.1
    shape = np.ceil((high - low) / 0.1 - 1e-9).astype(int)
    index = np.argwhere(np.ones(shape))
    sums = np.zeros((2, len(index)))
    for f, p in enumerate(poses):
        q = (low + (index + 0.5) * 0.1 - p[:3, 3]) @ p[:3, :3]
        with np.errstate(all="ignore"):
            pu, pv = np.rint(k[0] * q[:, 0] / q[:, 2] + k[2]), np.rint(k[4] * q[:, 1] / q[:, 2] + k[5])
        ok = np.flatnonzero((q[:, 2] > 0) & (pu >= 0) & (pu < w) & (pv >= 0) & (pv < h))
        d, sigma, conf = (x[f][pv[ok].astype(int), pu[ok].astype(int)].astype(float) for x in images)
        sd = d - q[ok, 2]
        weight = np.where(np.abs(sd) <= 0.3 + 1e-12, conf / (1 + sigma / 0.1), 0)
        sums[:, ok] += np.stack([weight * np.clip(sd / 0.3, -1, 1), weight])
    want = {tuple(i): (s / x, x) for i, s, x in zip(index.tolist(), *sums, strict=True) if x > 0}
    got = {(r.ix, r.iy, r.iz): (r.tsdf, r.weight) for r in spark.read.parquet(str(tmp_path / "o/voxels")).collect()}
    assert set(got) == set(want) and len(got) > 100
    assert all(got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-6) and got[i][1] == pytest.approx(want[i][1], rel=1e-5) for i in want)
    meta = A.read_record(spark, str(tmp_path / "o/metadata"))
    assert meta["grid_min_corner_m"] == pytest.approx(low.tolist()) and meta["grid_max_corner_m"] == pytest.approx(high.tolist())
    assert A.read_record(spark, str(tmp_path / "o/metrics"))["metric_family"] == "not_evaluated"
    report = A.inspect_output(spark, str(tmp_path / "o"))
    assert report["surface"]["n_surface"] == sum(abs(np.float32(t)) <= 1 / 3 for t, _ in want.values())


def test_runs_are_reconciled(spark, run, tmp_path):
    from stratafuse.sources import folders

    folder, summary = run
    assert summary["artifacts"] == ["cache", "events", "fusion", "session"]
    for change, message in (({"peak": 9.0}, "peak"), ({"artifacts": ["cache"]}, "lacks"), ({"n_frames": 4}, "different frames")):
        A.write_record(spark, f"{folder}/summary", summary | change)
        with pytest.raises(A.ArtifactError, match=message):
            A.inspect_run(spark, folder)
    A.write_record(spark, f"{folder}/summary", summary)
    folders.write_events(spark.read.parquet(f"{folder}/events"), str(tmp_path / "events.jsonl"), 3, {"session": "session"})
    events = folders.read_events(spark, str(tmp_path / "events.jsonl"))
    assert events.count() == 15 and events.where("stage_name = 'tsdf_replay_frame'").count() == 3
    lines = (tmp_path / "events.jsonl").read_text().splitlines()
    (tmp_path / "events.jsonl").write_text("\n".join(lines[1:]))
    with pytest.raises(ValueError, match="dense"):
        folders.read_events(spark, str(tmp_path / "events.jsonl"))
    (tmp_path / "events.jsonl").write_text(lines[0].replace('"configured_frame_array_bound":3', '"configured_frame_array_bound":0'))
    with pytest.raises(ValueError, match="memory_counters"):
        folders.read_events(spark, str(tmp_path / "events.jsonl"))
    with pytest.raises(A.ArtifactError, match="asked for"):
        A.run_adapter(spark, "fixture-cube-room", f"{folder}/session", str(tmp_path / "x"), wanted=[0, 2, 1])


def test_modes_and_sidecars(spark, run, tmp_path):
    folder = f"{run[0]}/fusion"
    report = A.inspect_output(spark, folder, mode="complete")
    assert report["cross_checks"]["artifacts_checked"] == ["metadata", "surface", "mesh", "world_map"] and report["surface"]["bounds_max_m"][2] < 4.1
    assert A.world_map_report(spark, folder)["mesh_chunk_ids"] == ["surface_samples"]
    with pytest.raises(A.ArtifactError, match="mode"):
        A.inspect_output(spark, folder, mode="all")
    A.replay_cache(spark, f"{run[0]}/cache", str(tmp_path / "bare"))
    assert A.inspect_output(spark, str(tmp_path / "bare"))["mesh"] is None
    with pytest.raises(A.ArtifactError, match="missing"):
        A.inspect_output(spark, str(tmp_path / "bare"), mode="mesh")
    world = A.read_record(spark, f"{folder}/world_map")
    for change, message in (({"global_confidence": 0.1}, "global_confidence"), ({"objects": {"1": {}}}, "neither"), ({"flags": []}, "flags"), ({"mesh_chunks": {"x": {}}}, "differs")):
        A.write_record(spark, f"{folder}/world_map", world | change)
        with pytest.raises(A.ArtifactError, match=message):
            A.inspect_output(spark, folder, mode="complete")
    A.write_record(spark, f"{folder}/world_map", world)
    metrics = A.read_record(spark, f"{folder}/metrics")
    A.write_record(spark, f"{folder}/metrics", metrics | {"accuracy_report": True})
    with pytest.raises(A.ArtifactError, match="accuracy report"):
        A.inspect_output(spark, folder)
    A.write_record(spark, f"{folder}/metrics", metrics)


def test_exchange_layouts(spark, run, tmp_path):
    import json
    from pathlib import Path

    from stratafuse.plans import previews
    from stratafuse.sources import folders

    session = A.load_session(spark, f"{run[0]}/session")
    out = tmp_path / "session"
    folders.write_session(spark, session, str(out))
    assert sorted(p.name for p in out.rglob("*")) == sorted(["metadata.json", "poses.jsonl", "cameras.jsonl", "objects.jsonl", "mesh_chunks", "index.json", "chunk_cube_room_ground_truth_v1.json", "depth", *[f"frame_{i:06d}.npz" for i in range(3)], "logs", "runtime_profile.json"])
    first = json.loads((out / "objects.jsonl").read_text().splitlines()[0])
    assert first["label_candidates"] == [["synthetic_cube", 1.0]] and first["oriented_bbox_extents_m"] == pytest.approx([0.7, 0.7, 0.7])
    pose = json.loads((out / "poses.jsonl").read_text().splitlines()[1])
    assert pose["T_world_camera"][0] == pytest.approx([1, 0, 0, 0.25]) and pose["diagnostics"] == {"synthetic": True}
    again = A.load_session(spark, str(out))
    for name in ("depth", "mesh_vertices", "mesh_faces"):
        kinds = [F.round(F.col(c).cast("double"), 6).alias(c) for c in again[name].columns]  # the exchange has single precision
        assert again[name].select(*kinds).exceptAll(session[name].select(*kinds)).isEmpty() and again[name].count() == session[name].count()
    A.run_adapter(spark, "fixture-cube-room", str(out), str(tmp_path / "cache"))
    plain = A.replay_cache(spark, str(tmp_path / "cache"), str(tmp_path / "fused"), mesh=True, world_map=True)
    assert plain["n_surface"] == 944

    pixels = session["depth"].select("frame_id", "v", "u", "depth_m", "depth_sigma_m", "confidence", "object_id")
    prediction = {"coordinate_frame": "synthetic_world", "fixture": True, "fixture_session_type": "synthetic_cube_room"}
    cache = tmp_path / "exchange"
    folders.write_cache(spark, session["frames"], pixels, str(cache), A.adapter_record("fixture-cube-room"), prediction)
    with np.load(cache / "arrays/frame_000001.npz") as z:
        assert z["normal_camera"].shape == (24, 32, 3) and z["static_mask"].dtype == bool and np.abs(np.linalg.norm(z["normal_camera"], axis=-1) - 1).max() < 1e-5
        d, p = z["depth_m"], z["point_world"]
        assert np.allclose(p[..., 2], d) is False and np.allclose(p[..., 2] - 0.4, d, atol=1e-6)
    meta = A.replay_cache(spark, str(cache), str(tmp_path / "fused2"))
    assert meta["n_surface"] == 944 and A.read_record(spark, str(tmp_path / "fused2/metrics"))["metric_family"] == "fixture_cube_room_reference"
    assert A.frame_payload(spark, str(cache), 2).count() == 768 and len(A.inspect_cache(spark, str(cache))["confidence_summaries"]) == 3
    written = folders.write_fusion(spark, str(tmp_path / "fused"), str(tmp_path / "npz"))
    assert len(written) == 6
    surface = folders.read_surface(spark, str(tmp_path / "npz/surface_points.npz"))
    assert surface.count() == 944
    side = tmp_path / "npz/mesh_chunk_sidecar.json"
    chunk = folders.read_sidecar(spark, str(side)).first()
    assert len(chunk["vertices_m"]) == 9 * 944 and chunk["faces"][-1] == 3 * 944 - 1 and chunk["source_frame_ids"] == [0, 1, 2] and chunk["scale_source"] == "known_anchor"
    world = folders.read_sidecar(spark, str(tmp_path / "npz/world_map_sidecar.json"), "world_map").first()
    assert list(json.loads(world["mesh_chunks"])) == ["surface_samples"] and world["world_frame_name"] == "synthetic_world"
    text = side.read_text()
    for change, message in ((lambda s: s.replace('"not_accuracy_report"', '"completed_surface"'), "flags"), (lambda s: s.replace('"voxel_size_m": 0.1', '"voxel_size_m": 0.0'), "voxel_size_m"), (lambda s: s.replace("mesh_sidecar", "other"), "sidecar")):
        side.write_text(change(text))
        with pytest.raises(ValueError, match=message):
            folders.read_sidecar(spark, str(side))
    with np.load(tmp_path / "npz/tsdf_grid.npz") as z:
        assert z["tsdf"].shape == (30, 20, 40) and z["weight"].sum() == pytest.approx(5872.549, rel=1e-5)

    files = previews.write_session_preview(spark, again, str(tmp_path / "preview"))
    svg = Path(tmp_path / "preview/top_down.svg").read_text()
    assert len(files) == 4 and svg.count('class="eye"') == svg.count('class="view"') == 3 and svg.count('class="track"') == svg.count('class="body"') == svg.count('class="extent"') == 1 and "1 synthetic_cube" in svg and "grid 0.5 m" in svg
    assert Path(tmp_path / "preview/depth_frame_000000.svg").read_text().count("<rect") == 768

    def broken(change, match):
        lines = (cache / "frame_summaries.jsonl").read_text()
        (cache / "frame_summaries.jsonl").write_text(change(lines))
        with pytest.raises(Exception, match=match):
            A.load_cache(spark, str(cache))["arrays"].count()
        (cache / "frame_summaries.jsonl").write_text(lines)

    broken(lambda s: s.replace('"dtype":"bool"', '"dtype":"float32"', 1), "static_mask")
    broken(lambda s: s.replace('"tracking_state":"OK"', '"tracking_state":""', 1), "pose")
    broken(lambda s: "\n".join(s.splitlines()[1:]) + "\n", "frame_ids")
    broken(lambda s: s.replace("arrays/frame_000000", "../frame_000000"), "arrays_below")
    (cache / "arrays/frame_000000.npz").write_bytes(b"no archive")
    with pytest.raises(Exception, match="not a readable NPZ"):
        A.load_cache(spark, str(cache))
    (out / "depth/frame_x.npz").write_bytes(b"x")
    with pytest.raises(Exception, match="frame_<id>"):
        A.load_session(spark, str(out))
