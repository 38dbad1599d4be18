"""Files put together from parts: order, large and empty inputs, NPZ arrays, and failures that leave nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.sources import parts as P
from stratafuse.sources import texts as X


def test_lines_in_order(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("k"), F.concat(F.lit('{"k": '), F.lit(4999) - F.col("id"), F.lit("}")).alias("text")).repartition(7)
    P.write_lines(rows, "k", "text", str(tmp_path / "a"), "deep/x.jsonl")
    lines = (tmp_path / "a/deep/x.jsonl").read_text().split("\n")
    assert lines == [f'{{"k": {i}}}' for i in range(5000)] + [""]
    P.write_lines(rows.where("k < 10"), "k", "text", str(tmp_path / "a"), "deep/x.jsonl")  # written anew
    assert len((tmp_path / "a/deep/x.jsonl").read_text().split("\n")) == 11
    P.write_lines(rows.limit(0), "k", "text", str(tmp_path / "a"), "empty.jsonl")
    assert (tmp_path / "a/empty.jsonl").read_bytes() == b""
    assert sorted(os.listdir(tmp_path / "a")) == ["deep", "empty.jsonl"]  # no parts are left


def test_arrays_of_a_grid_and_of_rows(spark, tmp_path):
    shape, folder = (5, 4, 3), str(tmp_path)
    voxels = spark.createDataFrame([(0, 0, 0, 0.5, 2.0), (4, 3, 2, -0.25, 1.0), (2, 1, 2, 0.125, 3.0)], "ix int, iy int, iz int, tsdf double, weight double")
    surface = spark.range(1000).select("id", *[(F.col("id") * s).cast("double").alias(c) for c, s in (("x", 1), ("y", 2), ("z", 3))]).repartition(5)
    parts = P.grid_parts(voxels, shape, {"tsdf": 1.0, "weight": 0.0}, "g.npz").unionByName(P.constant_parts(spark, {"size": np.asarray(np.float32(0.1))}, "g.npz")).unionByName(P.row_parts(surface, "id", {"p": ("<f4", ["x", "y", "z"]), "z": ("<f8", ["z"])}, "s.npz"))
    arrays = {"g.npz": [("size", "<f4", ()), ("tsdf", "<f4", shape), ("weight", "<f4", shape)], "s.npz": [("p", "<f4", (1000, 3)), ("z", "<f8", (1000,))]}
    assert P.join_parts(spark, folder, P.write_parts(parts, folder), arrays) == ["g.npz", "s.npz"]
    g, s = (X.read_npz((tmp_path / n).read_bytes(), n) for n in ("g.npz", "s.npz"))
    want = np.ones(shape, np.float32)
    want[0, 0, 0], want[4, 3, 2], want[2, 1, 2] = 0.5, -0.25, 0.125
    assert np.array_equal(g["tsdf"], want) and g["weight"].sum() == 6 and g["size"] == np.float32(0.1) and g["size"].shape == ()
    assert np.array_equal(s["p"], np.arange(1000, dtype=np.float32)[:, None] * [1, 2, 3]) and np.array_equal(s["z"], np.arange(1000) * 3.0)
    assert sorted(os.listdir(tmp_path)) == ["g.npz", "s.npz"]
    arrays["g.npz"][1] = ("tsdf", "<f4", (6, 4, 3))
    with pytest.raises(Exception, match="tsdf has 240 bytes"):
        P.join_parts(spark, folder, P.write_parts(parts, folder), arrays)
    assert sorted(os.listdir(tmp_path)) == ["g.npz", "s.npz"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("planted"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="planted"):
        P.write_lines(rows, "id", "text", str(tmp_path / "b"), "x.jsonl")
    assert not (tmp_path / "b").exists() or os.listdir(tmp_path / "b") == []
