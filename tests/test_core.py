import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import checks as K
from stratafuse.operators import fusion as U
from stratafuse.operators import scenes as S
from stratafuse.operators import summaries as M
from stratafuse.operators import windows as W
from stratafuse.sources import arrays as A


@pytest.fixture(scope="module")
def room(spark):
    frames = S.render_frames(S.fixed_frames(spark))
    return U.integrate(U.voxel_samples(frames)).persist()


def test_reference_scene(spark, room):
    px = S.render_pixels(S.fixed_frames(spark)).groupBy("frame_id").agg(F.sum("object_id"), F.round(F.min("depth_m"), 4), F.round(F.max("depth_m"), 4), F.avg("depth_m")).orderBy("frame_id").collect()
    assert [r[1] for r in px] == [196, 196, 240]
    assert px[0][2] == pytest.approx(1.45) and px[0][3] == pytest.approx(3.6)
    assert px[2][3 + 1] == pytest.approx(2.591404926031828, abs=1e-6)
    assert room.count() == 2840
    assert room.agg(F.sum("weight")).first()[0] == pytest.approx(5872.54895222187, rel=1e-6)
    surface = U.extract_surface(room, 3)
    assert surface.count() == 944
    m = U.surface_against_scene(surface).first()
    assert m["inside_ratio"] == 1.0 and m["within_voxel_ratio"] == 1.0
    assert m["mean_distance_m"] == pytest.approx(0.04851692, abs=1e-6)
    assert surface.agg(F.avg("confidence")).first()[0] == pytest.approx(0.7172925580861205, abs=1e-6)


def test_pixels_and_images_agree(spark, room):
    frames = S.fixed_frames(spark)
    other = U.integrate(U.voxel_samples(S.observations_from_pixels(frames, S.render_pixels(frames))))
    assert other.exceptAll(room).isEmpty() and U.dense(room, spark).count() == 24_000


def test_markers_and_sample(spark, room):
    s = W.stratified_sample(U.extract_surface(room, 3).select("ix", "iy", "iz", "x", "y", "z"), 2048, "ix", "iy", "iz")
    assert U.triangle_markers(s, 0.1).count() == 2832
    few = W.stratified_sample(spark.range(100).withColumnRenamed("id", "k"), 8, "k").orderBy("sample_id").collect()
    assert [r["k"] for r in few] == [int((i + 0.5) * 100 / 8) for i in range(8)]


def test_poses(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "id int, q array<double>")
    r = G.rotation_from_quaternion(G.mat("q", 4))
    back = G.quaternion_from_rotation(r)
    rows = df.select("q", F.array(*back).alias("b"), K.rotation(r).alias("ok")).collect()
    for row in rows:
        want = np.array(row["q"]) / np.linalg.norm(row["q"])
        assert row["ok"] and np.allclose(np.array(row["b"]), want * (1 if want[3] >= 0 else -1), atol=1e-9)


def test_normals_match_numpy(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(6, 5, 3))
    p[0, 0] = p[0, 1] = p[1, 0] = 0.0
    rows = [(0, v, u, *map(float, p[v, u])) for v in range(6) for u in range(5)]
    got = W.estimate_normals(spark.createDataFrame(rows, "frame_id int, v int, u int, x double, y double, z double")).collect()

    def diff(a, axis):
        out = np.empty_like(a)
        a, o = np.moveaxis(a, axis, 0), np.moveaxis(out, axis, 0)
        o[1:-1], o[0], o[-1] = (a[2:] - a[:-2]) / 2, a[1] - a[0], a[-1] - a[-2]
        return out

    n = np.cross(diff(p, 1), diff(p, 0))
    size = np.linalg.norm(n, axis=2, keepdims=True)
    n = np.where(size > 1e-12, n / np.where(size > 0, size, 1), [0, 0, 1])
    for r in got:
        assert np.allclose([r["nx"], r["ny"], r["nz"]], n[r["v"], r["u"]])


def test_ray_parallel_to_a_slab(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0)], "x double, d double")
    o, d = (F.col("x"), F.lit(0.0), F.lit(-3.0)), (F.col("d"), F.lit(0.0), F.lit(1.0))
    rows = df.select(*G.intersect_box(o, d, (-1, -1, -1), (1, 1, 1))).collect()
    assert tuple(rows[0]) == (2.0, 4.0) and tuple(rows[1]) == (float("inf"), float("-inf"))


def test_checks(spark):
    rows = [(0, 0.5, [1.0] + [0.0] * 35), (1, float("nan"), [1.0] * 36), (2, None, [-1.0] + [0.0] * 35), (3, 2.0, None)]
    df = spark.createDataFrame(rows, "id int, c double, m array<double>")
    bad = {(r[0], r[1]) for r in K.violations(df, "id", {"confidence": K.confidence("c"), "psd": K.covariance_psd("m"), "symmetric": K.covariance_symmetric("m")}).collect()}
    assert bad == {(1, "confidence"), (2, "confidence"), (3, "confidence"), (2, "psd"), (3, "psd"), (3, "symmetric")}
    with pytest.raises(K.ConstraintError, match="confidence: "):
        K.require(df, "id", {"confidence": K.confidence("c")})
    assert K.require(df.where("id = 0"), "id", {"confidence": K.confidence("c")}).count() == 1
    v, f = S.scene_mesh(spark)
    assert (v.count(), f.count()) == (16, 24) and K.face_violations(f, v).isEmpty()
    assert K.face_violations(f, v.where("vertex_id < 15")).count() > 0


def test_sources(spark, tmp_path):
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    (tmp_path / "b.ppm").write_bytes(b"P6\n# note\n2 2\n255\n" + image.tobytes())
    (tmp_path / "a.ppm").write_bytes(b"P6 2 2 255\n" + image[::-1].tobytes())
    px = A.read_ppm_folder(spark, str(tmp_path)).orderBy("frame", "v", "u").collect()
    assert [r["r"] for r in px] == [6, 9, 0, 3, 0, 3, 6, 9] and [r["frame"] for r in px] == [0] * 4 + [1] * 4
    for broken in (b"P5 2 2 255\n", b"P6 2 2 65535\n", b"P6 2 2 255\n\0"):
        with pytest.raises(ValueError):
            A.parse_ppm(broken)
    buf = io.BytesIO()
    np.savez(buf, rgb_u8=np.stack([image, image]))
    (tmp_path / "clip.npz").write_bytes(buf.getvalue())
    assert A.read_npz_clip(spark, str(tmp_path / "clip.npz"), 5).agg(F.min("frame"), F.max("frame"), F.sum("g")).first() == (5, 6, 44)
    (tmp_path / "depth").mkdir()
    np.savez(tmp_path / "depth/frame_000007.npz", depth_m=np.ones((2, 3)), K=np.eye(3)[0])
    assert A.read_depth_folder(spark, str(tmp_path / "depth")).agg(F.count("*"), F.max("frame_id")).first() == (6, 7)
    for path in ("/a", "arrays/../x", "other/x"):
        with pytest.raises(ValueError):
            A.safe_payload_path("r", path)
    with pytest.raises(ValueError):
        A.clip_intrinsics(np.zeros((3, 3)), 2)


def test_large_summary_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0, 7.5], 400), "c": np.array([3.25]), "d": np.concatenate([np.zeros(900), rng.exponential(1e9, 99)]), None: rng.integers(0, 50, 700).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    monkeypatch.setattr(M, "SORTED", 3)  # intervals are split more than once
    monkeypatch.setattr(M, "BINS", 8)
    got = {r["g"]: r for r in M.large_summary(df, "x", "g", (0.01, 0.5, 0.95, 1.0)).collect()}
    for g, xs in groups.items():
        r = got[g]
        assert (r["n"], r["min"], r["max"]) == (len(xs), xs.min(), xs.max()) and r["mean"] == pytest.approx(xs.mean())
        assert [r["p1"], r["p50"], r["p95"], r["p100"]] == pytest.approx(np.percentile(xs, [1, 50, 95, 100]).tolist())
    assert got["e"]["n"] == 0 and got["e"]["p50"] is None
    whole = M.large_summary(df, "x").first()
    assert whole["p95"] == pytest.approx(np.percentile(np.concatenate(list(groups.values())), 95))
    monkeypatch.setattr(M, "FEW_GROUPS", 2)
    plain = {r["g"]: r["p50"] for r in M.large_summary(df, "x", "g").collect()}
    assert plain["b"] == np.percentile(groups["b"], 50)
    assert M.large_summary(df.limit(0), "x").first()["n"] == 0


def test_frame_normals_equal_the_stencil(spark):
    frames = S.fixed_frames(spark)
    px = S.render_pixels(frames)
    d = F.col("depth_m").cast("double")
    px = px.select("frame_id", "v", "u", ((F.col("u") - 15.5) * d / 30.0).alias("x"), ((F.col("v") - 11.5) * d / 30.0).alias("y"), d.alias("z"))
    a = W.estimate_normals(px).select("frame_id", "v", "u", *[F.round(f"n{c}", 9).alias(c) for c in "xyz"])
    b = W.frame_normals(S.render_frames(frames), 32, 24, 30.0, 30.0, 15.5, 11.5).select("frame_id", "v", "u", *[F.round(f"n{c}", 9).alias(c) for c in "xyz"])
    both = a.join(b.withColumnsRenamed({c: f"o{c}" for c in "xyz"}), ["frame_id", "v", "u"])
    assert both.count() == 3 * 768 and both.where(" or ".join(f"abs({c} - o{c}) > 1e-8" for c in "xyz")).isEmpty()


def test_halves_equal_two_volumes(spark):
    samples = U.voxel_samples(S.render_frames(S.fixed_frames(spark)))
    one = U.compare_halves(samples, F.col("frame_id") == 1).first()
    two = U.compare_volumes(U.integrate(samples.where("frame_id <> 1")), U.integrate(samples.where("frame_id = 1"))).first()
    assert one["n_common"] == two["n_common"] > 0 and one["mean_abs_delta"] == pytest.approx(two["mean_abs_delta"])
