"""Clips and schedules against loops."""

import random
from collections import Counter

import pytest

from stratafuse.operators import sampling as N


@pytest.mark.parametrize(("length", "stride", "step", "most_gap"), [(4, 1, 1, 0), (3, 2, 2, 0), (3, 2, 1, 1), (5, 3, 2, 2), (1, 1, 1, 0)])
def test_clips_equal_the_loop(spark, length, stride, step, most_gap):
    r = random.Random(length)
    frames = [(s, i) for s in "ab" for i in range(200) if r.random() > 0.2 or i in (63, 64, 65)] + [("c", 5), ("c", 5), ("c", 6), (None, 1), ("c", None)]
    have = {}
    for s, i in frames:
        if s and i is not None:
            have.setdefault(s, set()).add(i)
    want = set()
    for s, ids in have.items():
        for i in ids:
            clip = [i + k * stride for k in range(length)]
            missing = longest = 0
            for j in range(i, clip[-1] + 1):
                missing = 0 if j in ids else missing + 1
                longest = max(longest, missing)
            if i % step == 0 and all(c in ids for c in clip) and longest <= most_gap:
                want.add((s, i, tuple(clip)))
    df = spark.createDataFrame(frames, "sequence string, frame_id long")
    for size in (16, 8192):
        got = [(c["sequence"], c["start"], tuple(c["frame_ids"])) for c in N.strided_clips(df, length, stride, step, most_gap, size).collect()]
        assert set(got) == want and len(got) == len(want)
    assert N.strided_clips(df.limit(0), length).count() == 0


def test_schedule_follows_its_weights_and_agrees_with_itself(spark):
    items = spark.createDataFrame([(s, f"{s}{i}") for s, n in (("a", 50), ("b", 3), ("c", 1)) for i in range(n)] + [(None, "x")], "source string, id string")
    stages = [(10, {"a": 1, "b": 1}), (110, {"c": 1, "b": 3})]
    rows = N.training_schedule(items, stages, 200, 50, 3).collect()
    assert len(rows) == 200 * 50 == len({(r["step"], r["slot"]) for r in rows}) and all(r["item"].startswith(r["source"]) for r in rows)
    share = lambda lo, hi: {s: n / (50 * (hi - lo)) for s, n in Counter(r["source"] for r in rows if lo <= r["step"] < hi).items()}
    before, middle, after = share(0, 11), share(50, 71), share(110, 200)
    assert before.keys() == {"a", "b"} and abs(before["a"] - 0.5) < 0.07 and after.keys() == {"b", "c"} and abs(after["b"] - 0.75) < 0.03
    assert abs(middle["a"] - 0.25) < 0.05 and abs(middle["c"] - 0.125) < 0.05
    again = N.training_schedule(items.repartition(5), stages, 200, 50, 3).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows} != {tuple(r) for r in N.training_schedule(items, stages, 200, 50, 4).collect()}
    assert len({r["item"] for r in rows if r["source"] == "a"}) == 50
    with pytest.raises(ValueError, match="no items of d"):
        N.training_schedule(items, [(0, {"d": 1.0})], 1, 1)
    with pytest.raises(ValueError, match="rising"):
        N.scheduled_weights(items, [(5, {"a": 1.0}), (5, {"a": 1.0})])
