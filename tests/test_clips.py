import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.operators import checks as K
from stratafuse.operators import fusion as U
from stratafuse.operators import records as R
from stratafuse.operators import rooms as M
from stratafuse.operators import scenes as S
from stratafuse.sources import clips as C


def write_ppm(path, image):
    path.write_bytes(b"P6 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.tobytes())


def test_npz_clip_and_data_source(spark, tmp_path):
    C.write_smoke_clip(str(tmp_path / "a.npz"))
    rows = C.npz_packets(spark, str(tmp_path / "a.npz"), 5).orderBy("frame_id").collect()
    assert [r["frame_id"] for r in rows] == [5, 6] and list(rows[1]["rgb"]) == [0, 0, 0, 20, 40, 60, 80, 100, 120, 140, 160, 180]
    assert rows[0]["K_model"] == [32, 0, 0.5, 0, 32, 0.5, 0, 0, 1] and rows[0]["metadata"]["frame_index"] == "0"
    C.register(spark)
    again = spark.read.format("clip_npz").option("frameIdStart", 5).load(str(tmp_path / "a.npz"))
    assert [r["rgb"] for r in again.orderBy("frame_id").collect()] == [r["rgb"] for r in rows]
    clip = C.student_clip(again, "b")
    assert K.violations(clip.withColumn("id", F.lit(1)), "id", R.clip_checks()).isEmpty()
    got = clip.first()
    want = np.array([list(r["rgb"]) for r in rows], np.uint8).reshape(2, 2, 2, 3).transpose(0, 3, 1, 2).astype(np.float32) / np.float32(255)
    assert got["frame_ids"] == [5, 6] and np.array_equal(np.array(got["images"], np.float32), want.ravel())
    placed, head = C.teacher_batch(again, metadata={"rig": "x"})
    assert head["metadata"]["frame_ids"] == [5, 6] and head["metadata"]["source_formats"] == ["npz_clip"] and placed.count() == 2
    with pytest.raises(ValueError, match="reserved"):
        C.teacher_batch(again, metadata={"source": "x"})
    with pytest.raises(ValueError, match="more than once"):
        C.student_clip(again.union(again))
    assert K.violations(again, "frame_id", C.packet_checks()).isEmpty()
    np.savez(tmp_path / "bad.npz", rgb_u8=np.zeros((1, 2, 2, 3), np.uint8))
    with pytest.raises(Exception, match="has no array K"):
        C.npz_packets(spark, str(tmp_path / "bad.npz")).collect()


def test_ppm_folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = rng.integers(0, 256, (3, 2, 4, 3), dtype=np.uint8)
    for name, image in zip(("b", "a", "c"), images, strict=True):
        write_ppm(tmp_path / f"{name}.ppm", image)
    with pytest.raises(ValueError, match="no intrinsics"):
        C.ppm_packets(spark, str(tmp_path))
    np.savez(tmp_path / "intrinsics.npz", K=np.array([[9, 0, 1], [0, 9, 1], [0, 0, 1.0]]))
    rows = C.ppm_packets(spark, str(tmp_path), frame_id_start=2).orderBy("frame_id").collect()
    assert [bytes(r["rgb"]) for r in rows] == [images[i].tobytes() for i in (1, 0, 2)] and [r["frame_id"] for r in rows] == [2, 3, 4]
    each = np.stack([np.diag([f, f, 1.0]) for f in (1, 2, 3)])
    assert [r["K_model"][0] for r in C.ppm_packets(spark, str(tmp_path), k=each).orderBy("frame_id").collect()] == [1, 2, 3]
    write_ppm(tmp_path / "d.ppm", images[0, :1])
    with pytest.raises(ValueError, match="differ in size"):
        C.ppm_packets(spark, str(tmp_path))


def plain_room(p, w, h):
    """The renderer as loops over pixels and boxes."""
    f = np.float32(max(w, h) * 0.9)
    o, low, high = np.array([p["ox"], p["oy"], p["oz"]]), np.array(M.LOW), np.array([*M.HIGH, p["far"]])

    def hit(d, lo, hi):
        with np.errstate(divide="ignore"):
            t = np.sort(np.stack([(lo - o) / d, (hi - o) / d]), axis=0)
        return t[0].max(), t[1].min()

    depth, obj, rgb = np.zeros((h, w)), np.zeros((h, w), int), np.zeros((h, w, 3), int)
    for v in range(h):
        for u in range(w):
            d = np.array([(u - float(np.float32((w - 1) / 2))) / float(f), (v - float(np.float32((h - 1) / 2))) / float(f), 1.0])
            best, which = hit(d, low, high)[1], -1
            for i, b in enumerate(p["boxes"]):
                near, out = hit(d, np.array(b["low"]), np.array(b["high"]))
                if near <= out and near > 1e-9 and near < best:
                    best, which = near, i
            x = o + d * best
            depth[v, u], obj[v, u] = best, which
            if which < 0:
                base = p["color_b"] if int(np.floor(x[0] * 4) + np.floor(x[1] * 4)) % 2 else p["color_a"]
                z, s = x[2] / p["far"], (x[0] + 1.8) / 3.6
                c = np.array(base) * 0.82 + (40 * z, 35 * s, 30 * (1 - z))
            else:
                b = p["boxes"][which]
                own = (x - b["low"]) / (np.array(b["high"]) - b["low"])
                c = np.array(b["color"]) * (0.75 + 0.25 * (int(np.floor(own.sum() * 6)) % 2)) + (28 * own[0], 24 * own[1], 30 * own[2])
            rgb[v, u] = np.clip(c, 0, 255).astype(int)
    return depth, obj, rgb


def test_random_rooms(spark):
    rng = np.random.default_rng(3)
    seeds = [int(rng.integers(0, np.iinfo(np.int32).max)) for _ in range(5)]
    assert M.sample_seeds(3, 0, 5).tolist() == seeds and M.sample_seeds(3, 2, 5).tolist() == seeds[2:]
    rooms = M.random_rooms(spark, 5, 16, 12, 3)
    assert rooms.exceptAll(M.random_rooms(spark, 5, 16, 12, 3).repartition(3)).isEmpty() and rooms.count() == 5
    px = {(r["sample_id"], r["v"], r["u"]): r for r in M.trace(rooms).collect()}
    for i in (0, 3):
        depth, obj, rgb = plain_room(M.draw_room(seeds[i]), 16, 12)
        for v in range(12):
            for u in range(16):
                r = px[i, v, u]
                assert r["depth"] == pytest.approx(depth[v, u], abs=1e-9) and r["hit"] == obj[v, u] and np.abs(np.array([r["r"], r["g"], r["b"]]) - rgb[v, u]).max() <= 1
    seen = M.room_observations(rooms)
    assert K.violations(seen.withColumns({"static_mask": F.lit(None).cast("array<double>"), "source": F.lit("room")}), "frame_id", R.observation_checks()).isEmpty()
    assert K.violations(M.room_clips(rooms).withColumn("id", F.lit(1)), "id", R.clip_checks()).isEmpty()
    volume = U.integrate(U.voxel_samples(seen.where("frame_id = 0"), U.Grid(), S.Scene(width=16, height=12)))
    assert volume.where("weight > 0").count() > 50
    with pytest.raises(ValueError, match="count: "):
        M.random_rooms(spark, 0)


def test_totals_equal_the_sums_of_pixels(spark):
    """Rooms are summed in their tasks (before: the query had a row for each pixel leave Python)."""
    from stratafuse import scene_queries as Q

    rooms = Q.part_rooms(spark, "/root/testdata/sf0.001").where("sample_id between 1 and 40")
    px = M.trace(rooms)
    want = px.groupBy("sample_id").agg(F.count("*").alias("n_pixels"), F.count_if(F.col("hit") >= 0).alias("box_pixels"), F.sum("hit").alias("hits"), F.sum(F.round(F.col("depth") * 1e6).cast("long")).alias("depth_micro"), *[F.sum(c).alias(c) for c in "rgb"])
    got = M.room_totals(rooms)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 40
    twice = M.room_totals(rooms.union(rooms)).agg(F.sum("n_pixels"), F.count("*")).first()
    assert twice[0] == 2 * 40 * 192 and twice[1] == 40
    made = Q.traced_rooms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_pixels" in [x for x in made.split("\n") if "MapInArrow" in x][0]
