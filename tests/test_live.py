"""Streams of poses and depth images: equal to fusing the frames at once, whatever order, repeats and restarts."""

import pytest
from pyspark.sql import functions as F

from stratafuse.operators import blocks as B
from stratafuse.operators import scenes as S
from stratafuse.streaming import live

CENTERS = [(-0.3 + 0.05 * i, -0.1 + 0.02 * i, 0.4 + 0.01 * i) for i in range(12)]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_stream_equals_batch_after_restart_and_reordering(spark, tmp_path, rocks):
    frames = S.render_frames(S.fixed_frames(spark, CENTERS)).withColumns({"map_id": F.when(F.col("frame_id") % 3 == 0, "b").otherwise("a"), "time": (F.lit(1_700_000_000) + F.col("frame_id")).cast("timestamp")})
    rows = {r["frame_id"]: r for r in frames.collect()}
    pose, depth = frames.select("map_id", "frame_id", "time", "ox", "oy", "oz").schema, frames.select("map_id", "frame_id", "time", "depth").schema

    def put(name, schema, ids, number):
        data = [tuple(rows[i][c] for c in schema.names) for i in ids]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/part-{number}")

    def run():
        read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        q = live.write_blocks(live.dirty_blocks(read("poses", pose), read("depths", depth)), f"{tmp_path}/blocks", f"{tmp_path}/checkpoint")
        assert q.awaitTermination(240) and q.exception() is None

    put("poses", pose, [0, 1, 2, 2, 1, 5], 0)
    put("depths", depth, [5, 4, 0], 0)
    run()
    first = {(r["map_id"], r["bx"], r["by"], r["bz"]): r["version"] for r in live.changed_since(spark, f"{tmp_path}/blocks").collect()}
    assert first
    put("poses", pose, [11, 3, 4, 10, 0], 1)
    put("depths", depth, [1, 2, 3, 4, 10, 11, 0], 1)
    put("poses", pose, [6, 7, 8, 9], 2)
    put("depths", depth, [9, 8, 7, 6, 6], 2)
    run()
    got = {(r["map_id"], r["ix"], r["iy"], r["iz"]): (r["tsdf"], r["weight"]) for r in live.live_volume(spark, f"{tmp_path}/blocks").collect()}
    want = {}
    for m in "ab":
        want |= {(m, r["ix"], r["iy"], r["iz"]): (r["tsdf"], r["weight"]) for r in B.fuse(frames.where(F.col("map_id") == m)).collect()}
    assert got == want and {m for m, *_ in got} == {"a", "b"}
    last = {(r["map_id"], r["bx"], r["by"], r["bz"]): r["version"] for r in live.changed_since(spark, f"{tmp_path}/blocks").collect()}
    assert all(last[k] >= v for k, v in first.items()) and any(last[k] > v for k, v in first.items())
