"""Overlaps by sampling and by sums, matching and precision against loops."""

import math
import random

import numpy as np
import pytest

from stratafuse.operators import detections as X

BOX = "x double, y double, z double, sx double, sy double, sz double, yaw double"


def corner_in(v, p):
    d = p - v[:3]
    c, s = math.cos(v[6]), math.sin(v[6])
    x, z = c * d[:, 0] - s * d[:, 2], s * d[:, 0] + c * d[:, 2]
    return (np.abs(x) <= v[3] / 2) & (np.abs(d[:, 1]) <= v[4] / 2) & (np.abs(z) <= v[5] / 2)


def test_overlap_of_turned_boxes():
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.uniform(-1, 1, (40, 3)), rng.uniform(0.5, 2.5, (40, 3)), rng.uniform(-4, 4, (40, 1))], 1)
    b = np.concatenate([rng.uniform(-1, 1, (40, 3)), rng.uniform(0.5, 2.5, (40, 3)), rng.uniform(-4, 4, (40, 1))], 1)
    p = rng.uniform(-3, 3, (200_000, 3))
    for v, w, got in zip(a, b, X.overlap_3d(a, b), strict=True):
        i, j = corner_in(v, p), corner_in(w, p)
        assert abs(got - (i & j).sum() / max(1, (i | j).sum())) < 0.03
    same = X.overlap_3d(a, a)
    turned = a.copy()
    turned[:, 6] += math.pi
    assert np.allclose(same, 1) and np.allclose(X.overlap_3d(a, turned), 1)
    apart = a.copy()
    apart[:, 0] += 50
    assert not X.overlap_3d(a, apart).any()
    flat = np.array([[0, 0, 0, 2, 1, 2, 0.0]]), np.array([[1, 0, 0, 2, 1, 2, 0.0]])
    assert X.overlap_3d(*flat)[0] == pytest.approx(1 / 3)


def test_pairs_matches_and_precision(spark):
    r = random.Random(2)
    truths, guesses = [], []
    for i in range(120):
        v = [r.uniform(0, 12), 0.0, r.uniform(0, 12), r.uniform(1, 3), 1.0, r.uniform(1, 3), r.uniform(-3, 3)]
        truths.append((i, i % 4, "ab"[i % 2], *v))
        for k in range(r.randrange(4)):
            w = [x + r.uniform(-0.4, 0.4) for x in v]
            guesses.append((1000 + 10 * i + k, i % 4, "ab"[i % 2], round(r.random(), 1), *w[:3], *v[3:6], w[6]))
    truths += [(500, 0, None, *v), (501, 0, "a", *v[:3], 0.0, 1.0, 1.0, 0.0), (502, 0, "c", *v)]
    t, g = spark.createDataFrame(truths, f"id long, frame_id long, label string, {BOX}"), spark.createDataFrame(guesses, f"id long, frame_id long, label string, confidence double, {BOX}")
    want = {}
    for x in truths:
        for y in guesses:
            if x[1] == y[1] and x[2] == y[2] and min(x[6:9]) > 0:
                iou = float(X.overlap_3d(np.array([x[3:]]), np.array([y[4:]]))[0])
                if iou > 0:
                    want[x[0], y[0]] = iou
    for cell in (0.7, 5.0):
        got = {(p["truth"], p["guess"]): p["iou"] for p in X.pairs_3d(t, g, cell).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    free, match = {x[0] for x in truths}, {}
    for y in sorted(guesses, key=lambda y: (-y[3], y[0])):
        best = max(((want[x, y[0]], -x) for x in free if want.get((x, y[0]), 0) >= 0.2), default=None)
        if best:
            match[y[0]] = -best[1]
            free.remove(-best[1])
    found = X.matches(X.pairs_3d(t, g, 2.0), g, 0.2)
    assert {p["guess"]: p["truth"] for p in found.collect()} == match and len(match) > 30
    rows = {p["label"]: p for p in X.average_precision(g, t.where("label is not null"), found).collect()}
    for label in "abc":
        own = [y for y in guesses if y[2] == label]
        n = sum(x[2] == label for x in truths)
        points = []
        for c in sorted({y[3] for y in own}, reverse=True):
            some = [y for y in own if y[3] >= c]
            tp = sum(y[0] in match for y in some)
            points.append((tp / n, tp / len(some)))
        ap, last = 0.0, 0.0
        for i, (recall, _) in enumerate(points):
            ap += (recall - last) * max(p for _, p in points[i:])
            last = recall
        assert rows[label]["ap"] == pytest.approx(ap) and rows[label]["n_truth"] == n and rows[label]["n_guess"] == len(own)
    assert X.matches(X.pairs_3d(t.limit(0), g, 2.0), g, 0.2).count() == 0


def test_overlap_in_images_and_track_breaks(spark):
    rows = [((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)), ((0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 3.0, 1.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)), ((0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0))]
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    assert [r[0] for r in spark.createDataFrame(rows, f"a {box}, b {box}").coalesce(1).select(X.iou_2d("a", "b")).collect()] == [pytest.approx(1 / 7), 0.0, 0.0, 1.0]
    seen = spark.createDataFrame([(1, i, g) for i, g in enumerate([None, 5, 5, None, None, 5, 6, None, 5])] + [(2, 0, None), (2, 1, None)], "truth long, frame_id long, guess long")
    assert {r["truth"]: tuple(r)[1:] for r in X.track_breaks(seen).collect()} == {1: (9, 5, 2, 2), 2: (2, 0, 0, 0)}


def test_boxes_on_round_coordinates_lie_in_one_cell(spark):
    """Cells don't begin at round coordinates (before: such boxes went into four cells each, and so did what was shuffled)."""
    at = [(float(10 * (i % 8)), 0.0, float(10 * (i // 8)), 1.0, 1.0, 1.0, 0.0) for i in range(64)]
    box = "id long, frame_id long, label string, x double, y double, z double, sx double, sy double, sz double, yaw double"
    a, b = (spark.createDataFrame([(i + s, 0, "k", *x) for i, x in enumerate(at)], box) for s in (0, 1000))
    pairs = X.pairs_3d(a, b, 5.0)
    assert {(r["truth"], r["guess"], round(r["iou"], 9)) for r in pairs.collect()} == {(i, i + 1000, 1.0) for i in range(64)}
    sides, seen = [pairs._jdf.queryExecution().optimizedPlan()], 0
    while sides:
        p = sides.pop()
        if p.nodeName() == "Join":
            for i in range(2):
                side = p.children().apply(i)
                seen += spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side).count()
        else:
            sides += [p.children().apply(i) for i in range(p.children().size())]
    assert seen == 128
