"""Records survive being written and read, and each contract names what is wrong."""

import json

import pytest
from pyspark.sql import functions as F

from stratafuse import record_queries as Q
from stratafuse.operators import checks as K
from stratafuse.operators import records as R
from stratafuse.operators import scenes as S

SF = "/root/testdata/sf0.001"


def test_good_records_round_trip(spark):
    frames = S.with_cameras(S.fixed_frames(spark))
    v, f = S.scene_mesh(spark)
    for record, rows in ((R.POSE, frames), (R.CAMERA, frames), (R.OBJECT, S.box_object(frames)), (R.MESH, S.mesh_chunk(v, f, frames))):
        first = rows.select(R.encode(record).alias("text"))
        found = R.decode(first, "text", record)
        assert K.violations(found.withColumn("_key", F.lit(0)), "_key", record.checks()).isEmpty()
        again = found.select(R.encode(record).alias("text"))
        assert sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in first.collect()) == sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in again.collect())
    summary = json.loads(R.decode(Q.poses(spark, SF).where("pose_id = 1"), "text", R.POSE).select(R.encode(R.POSE)).first()[0])
    assert list(summary) == sorted(R.POSE.fields) and len(summary["T_world_camera"]) == 4


@pytest.mark.parametrize(
    ("change", "found"),
    [
        ({"frame_id": True}, {"frame_id"}),
        ({"frame_id": 1.5}, {"frame_id"}),
        ({"confidence": "much"}, {"confidence"}),
        ({"confidence": None}, {"confidence"}),
        ({"covariance_6x6": None}, set()),
        ({"covariance_6x6": "none"}, {"covariance_6x6"}),
        ({"T_world_camera": [[1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]}, {"ragged", "T_world_camera", "center"}),
        ({"diagnostics": []}, {"diagnostics"}),
        ({"tracking_state": ""}, {"tracking_state"}),
        ({"more": 1}, set()),
    ],
)
def test_faults_of_a_pose(spark, change, found):
    good = json.loads(S.with_cameras(S.fixed_frames(spark)).where("frame_id = 1").select(R.encode(R.POSE)).first()[0])
    rows = spark.createDataFrame([(7, json.dumps(good | change))], "key int, text string")
    got = {r["check"] for r in R.violations(rows, "text", R.POSE, "key").collect()}
    assert got - {"center"} == found - {"center"}


def test_text_that_is_no_record(spark):
    rows = spark.createDataFrame([(1, "no json"), (2, None), (3, "[]"), (4, "{}")], "key int, text string")
    bad = R.violations(rows, "text", R.CAMERA, "key").groupBy("key").agg(F.collect_set("check").alias("c")).collect()
    assert {r["key"] for r in bad} == {1, 2, 3, 4} and all("missing" in r["c"] and "frame_id" in r["c"] for r in bad)


def test_checks_are_compiled_and_records_spread(spark):
    """Checks are a column before the explode (before: within it, where Spark interprets them), and the rows of one file go to all cores before they become records (before: to one task)."""
    for q in (Q.frame_summary_records, Q.mesh_records):
        made = q(spark, "/root/testdata/sf0.001")
        lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert [x for x in lines if "Generate explode" in x and "CASE WHEN" not in x] and any("Repartition" in x for x in lines)
