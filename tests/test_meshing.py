"""Meshes, nearest neighbours, block-sparse fusion and trajectories against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import blocks as B
from stratafuse.operators import distances as D
from stratafuse.operators import fusion as U
from stratafuse.operators import graphs
from stratafuse.operators import meshing as H
from stratafuse.operators import scenes as S
from stratafuse.operators import trajectories as T
from stratafuse.session import stored

SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- marching cubes


def solid(spark, grid, box):
    """The signed distance of a box, negative inside, at all voxels."""
    p = U.voxel_center(grid)
    inside = G.inside_box(p, *box)
    d = G.distance_to_box_surface(p, *box)
    return U.voxel_grid(spark, grid).select("ix", "iy", "iz", F.when(inside, -d).otherwise(d).alias("tsdf"), F.lit(1.0).alias("weight"))


def plain_faces(volume, grid):
    """Marching cubes a cell at a time, from the case table."""
    v = {(r["ix"], r["iy"], r["iz"]): float(r["tsdf"]) for r in volume.where("weight > 0").collect()}
    out = set()
    for c in v:
        corner = [(c[0] + (k & 1), c[1] + (k >> 1 & 1), c[2] + (k >> 2 & 1)) for k in range(8)]
        if not all(p in v for p in corner):
            continue
        for t in H.case_table()[sum((v[p] < 0) << k for k, p in enumerate(corner))]:
            spots = []
            for e in t:
                low, axis = H.EDGES[e]
                p = corner[low]
                q = tuple(x + (i == axis) for i, x in enumerate(p))
                at = [lo + (x + 0.5) * grid.voxel for lo, x in zip(grid.low, p, strict=True)]
                at[axis] += v[p] / (v[p] - v[q]) * grid.voxel
                spots.append(tuple(round(x, 9) for x in at))
            out.add((*c, *spots))
    return out


def test_case_table_covers_each_cut_edge_once_on_each_side():
    assert len(H.case_table()) == 256 and not H.case_table()[0] and not H.case_table()[255]
    for mask, triangles in enumerate(H.case_table()):
        cut = {e for e, (c, axis) in enumerate(H.EDGES) if (mask >> c & 1) != (mask >> (c | 1 << axis) & 1)}
        assert {e for t in triangles for e in t} == cut
        sides = Counter((t[i], t[(i + 1) % 3]) for t in triangles for i in range(3))
        assert max(sides.values(), default=1) == 1
        open_ = {s for s in sides if s[::-1] not in sides}  # lines on the cell's sides: one in and one out at each cut edge
        assert Counter(a for a, _ in open_) == Counter(b for _, b in open_) == Counter(cut)


@pytest.mark.parametrize("box", [((-0.35, -0.25, 0.85), (0.35, 0.45, 3.55)), ((-0.31, -0.2, 3.0), (0.27, 0.2, 3.4))])
def test_closed_mesh_across_blocks(spark, box):
    grid = U.Grid()  # 40 layers: two blocks
    volume = stored(solid(spark, grid, box))
    faces = stored(H.marching_cubes(volume, grid))
    r = H.mesh_report(faces).first()
    assert (r["boundary_edges"], r["crowded_edges"], r["euler"]) == (0, 0, 2)
    size = [h - lo for lo, h in zip(*box, strict=True)]
    assert abs(r["volume"] / math.prod(size) - 1) < 0.12 and abs(r["area"] / (2 * (size[0] * size[1] + size[1] * size[2] + size[0] * size[2])) - 1) < 0.2
    got = {(f["ix"], f["iy"], f["iz"], *[tuple(round(f[c + x], 9) for x in "xyz") for c in "abc"]) for f in faces.collect()}
    assert got == plain_faces(volume, grid)


def test_random_volume_has_no_cracks(spark):
    rng = random.Random(4)
    n = 9
    rows = [(i, j, k, 1.0 if min(i, j, k) == 0 or max(i, j, k) == n - 1 else rng.uniform(-1, 1), 1.0) for i, j, k in itertools.product(range(n), repeat=3)]
    rows = [(i + 28, j + 28, k + 28, t, w) for i, j, k, t, w in rows]  # across eight blocks
    volume = spark.createDataFrame(rows, "ix int, iy int, iz int, tsdf double, weight double")
    faces = stored(H.marching_cubes(volume))
    r = H.mesh_report(faces).first()
    assert r["boundary_edges"] == 0 and r["crowded_edges"] == 0 and r["n_faces"] > 300
    assert {tuple(round(f[c + x], 9) for c in "abc" for x in "xyz") for f in faces.collect()} == {sum((tuple(s) for s in t[3:]), ()) for t in plain_faces(volume, U.GRID)}
    assert H.marching_cubes(volume.limit(0)).count() == 0
    assert H.marching_cubes(volume.withColumn("weight", F.lit(0.0))).count() == 0


def test_levels_and_decimation(spark):
    grid = U.Grid()
    box = ((-0.8, -0.5, 1.0), (0.8, 0.5, 3.0))
    faces = stored(H.marching_cubes(solid(spark, grid, box), grid))
    vertices = stored(H.mesh_vertices(faces))
    n = faces.count()
    f, v = H.clustered(faces, vertices, 0.3)
    ids = {r["vertex_id"] for r in v.collect()}
    rows = f.collect()
    assert 0 < len(rows) < n / 4 and all({r["a"], r["b"], r["c"]} <= ids and len({r["a"], r["b"], r["c"]}) == 3 for r in rows)
    assert len({frozenset((r["a"], r["b"], r["c"])) for r in rows}) == len(rows)
    f, v = H.decimate(faces, vertices, 1e-8, rounds=3)
    p = {r["vertex_id"]: np.array([r["x"], r["y"], r["z"]]) for r in v.collect()}
    rows = f.collect()
    edges = Counter(frozenset(e) for r in rows for e in ((r["a"], r["b"]), (r["b"], r["c"]), (r["c"], r["a"])))
    assert len(rows) < 0.9 * n and set(edges.values()) == {2}  # still closed
    assert len(p) - len(edges) + len(rows) == 2
    volume = sum(p[r["a"]] @ np.cross(p[r["b"]], p[r["c"]]) / 6 for r in rows)
    assert abs(volume - H.mesh_report(faces).first()["volume"]) < 1e-3
    same, _ = H.decimate(faces, vertices, -1.0, rounds=2)
    assert same.count() == n


def test_components_and_parts(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(3000)]
    edges = [(a * 7 + 1, b * 7 + 1) for a, b in chain] + [(100_000 + rng.randrange(300), 100_000 + rng.randrange(300)) for _ in range(200)] + [(5, 5)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = graphs.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    faces = [(0, 1, 2, 3, 7), (1, 3, 4, 5, 7), (2, 5, 6, 1, 9), (3, 10, 11, 12, None), (4, 12, 13, 14, 3), (5, 20, 21, 22, None)]
    parts = {r["face_id"]: tuple(r)[1:] for r in H.split_objects(spark.createDataFrame(faces, "face_id long, a long, b long, c long, object_id int"), 2).collect()}
    assert parts == {0: (1, 3, 7, False), 1: (1, 3, 7, False), 2: (1, 3, 7, False), 3: (10, 2, 3, False), 4: (10, 2, 3, False), 5: (20, 1, None, True)}


# ---------------------------------------------------------------- nearest neighbours


@pytest.mark.parametrize("cell", [0.05, 1.0, 30.0])
def test_nearest_equals_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(5, 1e-4, (200, 3)), np.full((50, 3), 2.0), [[1e4, -1e4, 3.0]]])
    queries = np.concatenate([rng.normal(0, 2, (150, 3)), rng.normal(5, 1e-4, (60, 3)), points[:40], [[9e5, 0, 0], [-3e3, 7, 1e3], [2.0, 2.0, 2.0]]])
    frame = lambda x, names: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], names)
    q, p = frame(queries, "id long, x double, y double, z double"), frame(points, "n long, x double, y double, z double")
    got = {r["id"]: r["distance"] for r in D.nearest(q, p, cell).collect()}
    want = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2)).min(1)
    assert len(got) == len(queries) and np.allclose([got[i] for i in range(len(queries))], want, rtol=1e-12, atol=0)


def test_nearest_of_nothing_and_metrics(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, float("inf"), 0.0, 0.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.1), (2, 5.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert {r["id"]: r["distance"] for r in D.nearest(a, b, 0.5).collect()} == {1: 0.1, 2: pytest.approx(math.sqrt(1.01)), 3: None, 4: None}
    assert all(r["distance"] is None for r in D.nearest(a, b.limit(0), 0.5).collect()) and D.nearest(a.limit(0), b, 0.5).count() == 0
    r = {x["threshold_m"]: x for x in D.surface_metrics(a.where("id < 3"), b, (0.2, 4.0), 0.5).collect()}
    assert (r[0.2]["precision"], r[0.2]["recall"], r[0.2]["f_score"], r[4.0]["f_score"]) == (0.5, 0.5, 0.5, 1.0)
    assert r[0.2]["chamfer_m"] == pytest.approx(((0.1 + math.sqrt(1.01)) / 2 + (0.1 + 4) / 2) / 2)
    empty = D.surface_metrics(a.limit(0), b, (0.2,), 0.5).first()
    assert empty["n_found"] == 0 and empty["precision"] is None and empty["chamfer_m"] is None


# ---------------------------------------------------------------- block-sparse fusion


def test_blocks_give_the_volume_of_all_voxels(spark):
    from stratafuse import scene_queries as Q

    for frames in (S.render_frames(S.fixed_frames(spark)), Q.posed_frames(spark, SMALL)):
        for grid in (U.GRID, U.Grid(low=(-1.03, -0.9, 0.3), high=(1.2, 0.7, 3.1), voxel=0.07)):
            every = {(r["ix"], r["iy"], r["iz"]): (r["tsdf"], r["weight"]) for r in U.integrate(U.voxel_samples(frames, grid)).collect()}
            got = {(r["ix"], r["iy"], r["iz"]): (r["tsdf"], r["weight"]) for r in B.fuse(frames, grid).collect()}
            assert got == every and every
    few = B.frame_blocks(S.render_frames(S.fixed_frames(spark)), U.Grid(voxel=0.025)).collect()
    assert all(0 < r["n_blocks"] < 0.35 * 15 * 10 * 20 for r in few)  # of all blocks of that grid
    assert B.fuse(frames.limit(0)).count() == 0
    with pytest.raises(Exception, match="expected 768"):
        B.fuse(S.render_frames(S.fixed_frames(spark)).withColumn("depth", F.slice("depth", 1, 5))).count()


# ---------------------------------------------------------------- trajectories


def plain_alignment(e, p, with_scale):
    me, mp = e.mean(0), p.mean(0)
    u, d, vt = np.linalg.svd((p - mp).T @ (e - me) / len(e))
    s = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    r = u @ s @ vt
    c = np.trace(np.diag(d) @ s) / ((e - me) ** 2).sum(1).mean() if with_scale else 1.0
    left = p - (c * e @ r.T + mp - c * r @ me)
    return c, r, np.sqrt((left**2).sum(1).mean())


@pytest.mark.parametrize("with_scale", [True, False])
def test_alignment_of_tracks(spark, with_scale):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(6):
        e = rng.normal(0, 1, (40, 3)) * (1 if k != 3 else [1, 1, 0]) + 1e3 * (k == 5)
        r, _ = np.linalg.qr(rng.normal(0, 1, (3, 3)))
        r *= np.linalg.det(r)
        if k == 4:
            r = r @ np.diag([1, 1, -1])  # a mirror image can't be reached
        p = 1.7 * e @ r.T + rng.normal(0, 5, 3) + rng.normal(0, 0.01, e.shape)
        rows += [(k, *map(float, x), *map(float, y)) for x, y in zip(e, p, strict=True)]
        want[k] = plain_alignment(e, p, with_scale)
    rows += [(7, *[2.0 * i, 0.0, 0.0], *[0.0, 3.0 * i, 1.0]) for i in range(5)] + [(8, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (8, None, 2.0, 3.0, 4.0, 5.0, 6.0), (None, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    got = {r["track"]: r for r in T.aligned_errors(spark.createDataFrame(rows, "track int, ex double, ey double, ez double, px double, py double, pz double"), with_scale).collect()}
    for k, (c, r, rmse) in want.items():
        assert got[k]["rmse_m"] == pytest.approx(rmse, rel=1e-6) and got[k]["scale"] == pytest.approx(c) and got[k]["n_poses"] == 40
        assert np.allclose([got[k][f"r{i}"] for i in range(9)], r.ravel(), atol=1e-6)
    assert got[7]["rank"] == 1 and got[7]["rmse_m"] == pytest.approx(0, abs=1e-9) if with_scale else got[7]["rmse_m"] > 1
    assert got[8]["n_poses"] == 1 and got[8]["rmse_m"] == pytest.approx(0, abs=1e-12) and None in got


def plain_keyframes(rows, distance, angle, gap):
    out, last = [], {}
    for track, n, *pose in sorted(rows):
        p, q = np.array(pose[:3]), np.array(pose[3:]) / np.linalg.norm(pose[3:])
        if track in last:
            m, p0, q0 = last[track]
            if not (np.linalg.norm(p - p0) >= distance or abs(q @ q0) <= np.cos(angle / 2) + 1e-12 or n - m >= gap):
                continue
        last[track] = (n, p, q)
        out.append((track, n))
    return out


@pytest.mark.parametrize("span", [8, 64, 4096])
def test_keyframes_equal_the_loop(spark, span):
    rng = np.random.default_rng(3)
    rows = []
    for track in range(5):
        n = np.unique(np.concatenate([rng.integers(0, 400, 300), [5000, 5001, 9000]])) if track else np.array([17])
        p, h = np.cumsum(rng.normal(0, 0.2, (len(n), 3)), axis=0), np.cumsum(rng.normal(0, 0.1, len(n)))
        rows += [(track, int(i), *map(float, x), 0.0, math.sin(a / 2), 0.0, math.cos(a / 2)) for i, x, a in zip(n, p, h, strict=True)]
    df = spark.createDataFrame(rows, "track int, frame_id long, x double, y double, z double, qx double, qy double, qz double, qw double")
    got = sorted((r["track"], r["frame_id"]) for r in T.keyframes(df.union(df.limit(20)), 0.9, 0.5, 8, span).collect())
    assert got == plain_keyframes(rows, 0.9, 0.5, 8)
    assert T.keyframes(df.limit(0), 0.9, 0.5, 8, span).count() == 0


# ---------------------------------------------------------------- work that must not follow repeated points


def test_equal_points_are_measured_once(spark, monkeypatch):
    """Points at one place count as many, but only places are sought (before: each point was)."""
    one = spark.createDataFrame([(0.0, 0.0, 0.0)] * 40 + [(1.0, 0.0, 0.0)] * 10, "x double, y double, z double")
    other = spark.createDataFrame([(0.0, 0.0, 0.1)], "x double, y double, z double")
    sought, plain = [], D.nearest
    monkeypatch.setattr(D, "nearest", lambda q, p, cell: sought.append(q.count()) or plain(q, p, cell))
    r = D.surface_metrics(one, other, (0.2,), 0.5).first()
    assert sought == [2, 1]
    assert (r["n_found"], r["n_truth"], r["precision"], r["recall"]) == (50, 1, 0.8, 1.0)
    assert r["accuracy_m"] == pytest.approx((40 * 0.1 + 10 * math.sqrt(1.01)) / 50) and r["completeness_m"] == pytest.approx(0.1)


def test_images_equal_the_expressions_and_need_no_lambdas(spark):
    """Images are array operations (before: a lambda over 768 pixels, which Spark interprets), bit for bit those of the expression of a pixel."""
    frames = S.fixed_frames(spark, [(-0.4 + 0.07 * i, 0.02 * i - 0.1, 0.25 + 0.11 * i) for i in range(9)])
    drawn = S.render_frames(frames)
    assert "lambda" not in drawn._jdf.queryExecution().toString()
    depth, box = S.hit(F.col("u"), F.col("v"))
    want = {(r["frame_id"], r["v"], r["u"]): (r["d"], r["o"]) for r in S.pixel_grid(frames).select("frame_id", "v", "u", depth.alias("d"), box.alias("o")).collect()}
    got = {(r["frame_id"], r["v"], r["u"]): (r["depth_m"], r["object_mask"]) for r in S.render_pixels(frames).collect()}
    assert got == want and len(got) == 9 * 768
    assert {(r["frame_id"], i // 32, i % 32): x for r in drawn.collect() for i, x in enumerate(r["depth"])} == {k: d for k, (d, _) in want.items()}
