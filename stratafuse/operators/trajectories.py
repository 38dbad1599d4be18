"""Trajectories: errors after alignment, and keyframes.

Alignment needs no pass of its own over the poses: a track's mean positions and their covariance are one mergeable
aggregate, so a row of numbers a track is all that the closed form sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.session import discard, stored

_PAIRS = [(i, j) for i in "xyz" for j in "xyz"]
ALIGNMENT = ["scale", *[f"r{i}" for i in range(9)], *[f"t{c}" for c in "xyz"], "rank"]


def _solved(with_scale: bool):
    """Turn, scale and shift of each row of moments, by singular values of the covariance of truth and estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda n: np.asarray(b.column(n)).astype(float)  # noqa: E731, B023
            cov = np.stack([column(f"c{i}{j}") for i, j in _PAIRS], 1).reshape(-1, 3, 3)  # of truth i and estimate j
            mean_e, mean_t = (np.stack([column(f"{s}{c}") for c in "xyz"], 1) for s in ("me", "mt"))
            spread = column("spread")
            u, d, vt = np.linalg.svd(cov)
            sign = np.ones_like(d)
            sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)  # a turn, never a mirror image
            turn = (u * sign[:, None, :]) @ vt
            scale = np.divide((d * sign).sum(1), spread, out=np.ones(len(d)), where=spread > 0) if with_scale else np.ones(len(d))
            scale = np.where(scale > 0, scale, 1.0)
            shift = mean_t - scale[:, None] * np.einsum("nij,nj->ni", turn, mean_e)
            rank = (d > 1e-9 * np.maximum(d[:, :1], 1e-300)).sum(1) * (d[:, 0] > 0)
            values = [scale, *turn.reshape(-1, 9).T, *shift.T]
            yield pa.RecordBatch.from_arrays([b.column("track"), *[pa.array(np.ascontiguousarray(x)) for x in values], pa.array(rank, pa.int32())], ["track", *ALIGNMENT])

    return run


def alignments(poses: DataFrame, with_scale: bool = True) -> DataFrame:
    """track, scale, r0..r8, tx, ty, tz, rank: truth = scale * R * estimate + t with the least squares of all poses.

    poses: track, ex, ey, ez (estimate), px, py, pz (truth). Rows with a null or infinite coordinate don't count. rank is that of the
    covariance: below 2 (all poses on a line or in a point) the turn isn't unique and one of several is given; mirror images
    are never used. Without scale it is 1."""
    usable = poses.where(" and ".join(f"abs({s}{c}) < double('inf')" for s in "ep" for c in "xyz"))
    e, t = ({c: F.col(s + c).cast("double") for c in "xyz"} for s in "ep")
    moments = usable.groupBy("track").agg(
        *[F.avg(e[c]).alias(f"me{c}") for c in "xyz"], *[F.avg(t[c]).alias(f"mt{c}") for c in "xyz"],
        *[F.covar_pop(t[i], e[j]).alias(f"c{i}{j}") for i, j in _PAIRS], (F.var_pop(e["x"]) + F.var_pop(e["y"]) + F.var_pop(e["z"])).alias("spread"),
    )
    kind = dict(poses.dtypes)["track"]
    return moments.mapInArrow(_solved(with_scale), f"track {kind}, " + ", ".join(f"{n} double" for n in ALIGNMENT[:-1]) + ", rank int")


def aligned_errors(poses: DataFrame, with_scale: bool = True) -> DataFrame:
    """For each track its alignment, n_poses, and rmse_m, mean_m and max_m of the distances that it leaves. Tracks without a usable pose
    are missing; a null track is one of its own."""
    found = alignments(poses, with_scale).withColumnRenamed("track", "_track")
    rows = poses.where(" and ".join(f"abs({s}{c}) < double('inf')" for s in "ep" for c in "xyz"))
    rows = rows.join(found, rows["track"].eqNullSafe(found["_track"]))
    p = [F.col(f"e{c}").cast("double") for c in "xyz"]
    moved = [F.col("scale") * x + F.col(f"t{c}") for x, c in zip(G.rotate([F.col(f"r{i}") for i in range(9)], tuple(p)), "xyz", strict=True)]
    off = [m - F.col(f"p{c}") for m, c in zip(moved, "xyz", strict=True)]
    d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    sums = rows.groupBy("track", *ALIGNMENT).agg(F.count("*").alias("n_poses"), F.sqrt(F.avg(d2)).alias("rmse_m"), F.avg(F.sqrt(d2)).alias("mean_m"), F.sqrt(F.max(d2)).alias("max_m"))
    return sums.select("track", "n_poses", *ALIGNMENT, "rmse_m", "mean_m", "max_m")


# ---------------------------------------------------------------- keyframes

#: Frame ids of a range; a range's poses and those of the gap behind it are looked at together.
SPAN = 4096


def _successors(distance: float, angle: float, gap: int, span: int):
    """Of each pose of a range the keyframe that follows a keyframe there, and the first one behind the range."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t = rows.sort_by([("frame_id", "ascending")])
        n = np.asarray(t.column("frame_id"))
        p = np.stack([np.asarray(t.column(c)).astype(float) for c in "xyz"], 1)
        q = np.stack([np.asarray(t.column(f"q{c}")).astype(float) for c in "xyzw"], 1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        least = np.cos(min(angle, np.pi) / 2) + 1e-12
        beyond = t.column("beyond")[0].as_py()
        own = int(np.searchsorted(n, (key[1].as_py() + 1) * span))
        follows = np.full(own, -1 if beyond is None else beyond, np.int64)
        for i in range(own):
            at, step = i + 1, 32
            while at < len(n):
                end = min(len(n), at + step)
                apart, turned = np.linalg.norm(p[at:end] - p[i], axis=1), np.abs(q[at:end] @ q[i])
                hit = np.flatnonzero((apart >= distance) | (turned <= least) | (n[at:end] - n[i] >= gap))
                if len(hit):
                    follows[i] = n[at + hit[0]]
                    break
                at, step = end, step * 4
        leaves = follows.copy()
        for i in range(own - 1, -1, -1):
            if 0 <= follows[i] <= n[own - 1]:
                leaves[i] = leaves[np.searchsorted(n, follows[i])]
        columns = {c: t.column(c).slice(0, own) for c in ("track", "range", "frame_id")}
        return pa.table(columns | {c: pa.array(x, pa.int64(), mask=x < 0) for c, x in (("follows", follows), ("leaves", leaves))})

    return run


def _walked(key: tuple, rows: pa.Table) -> pa.Table:
    """The keyframes of a range, from where its first one stands."""
    t = rows.sort_by([("frame_id", "ascending")])
    n = np.asarray(t.column("frame_id"))
    entry, follows = t.column("entry").to_pylist(), t.column("follows").to_pylist()
    marked, at = [], next((i for i, e in enumerate(entry) if e), None)
    while at is not None:
        marked.append(at)
        nxt = follows[at]
        at = int(np.searchsorted(n, nxt)) if nxt is not None and nxt <= n[-1] else None
    keep = pa.array(marked, pa.int64())
    return pa.table({c: t.column(c).take(keep) for c in ("track", "frame_id")})


def keyframes(poses: DataFrame, distance: float, angle: float, gap: int, span: int = SPAN) -> DataFrame:
    """track, frame_id of the keyframes: each track's first pose, and then each first pose that lies ``distance`` or more from the
    last keyframe, is turned by ``angle`` or more (radians) against it, or comes ``gap`` or more frame ids after it.

    poses: track, frame_id (not negative), x, y, z, qx, qy, qz, qw. A track is cut into ranges of ``span`` ids (gap at most). Each range works out
    where every pose would hand over to; which pose it really starts from then follows from the ranges' hand-overs by
    pointer doubling, so a track of any length takes a logarithm of its ranges in rounds and never one task. Of poses of one track and frame_id the
    one that sorts first counts; poses with null values don't."""
    if gap > span or gap < 1:
        raise ValueError("gap: must be from 1 to span")
    fields = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    clean = poses.dropna(subset=["track", "frame_id", *fields]).groupBy("track", F.col("frame_id").cast("long").alias("frame_id")).agg(F.min(F.struct(*fields)).alias("p")).select("track", "frame_id", "p.*")
    clean = stored(clean.withColumn("range", F.floor(F.col("frame_id") / F.lit(span))))
    # the first pose behind a range and its gap
    late = F.min(F.when(F.col("frame_id") >= F.col("range") * span + gap, F.col("frame_id")))
    ranges = clean.groupBy("track", "range").agg(F.min("frame_id").alias("first"), late.alias("late"))
    w = Window.partitionBy("track").orderBy("range")  # a row a range
    one = lambda c, k: F.lead(c, k).over(w)
    beyond = F.when(one("range", 1) == F.col("range") + 1, F.coalesce(one("late", 1), one("first", 2))).otherwise(one("first", 1))
    ranges = stored(ranges.select("track", "range", beyond.alias("beyond"), F.row_number().over(w).alias("place"), "first"))
    both = F.explode(F.when(F.col("frame_id") < F.col("range") * span + gap, F.array(F.col("range") - 1, F.col("range"))).otherwise(F.array("range"))).alias("range")
    dealt = clean.select("track", "frame_id", *fields, both).join(ranges.select("track", "range", "beyond"), ["track", "range"])
    kind = dict(poses.dtypes)["track"]
    steps = stored(dealt.groupBy("track", "range").applyInArrow(_successors(distance, angle, gap, span), f"track {kind}, range long, frame_id long, follows long, leaves long"))
    start = ranges.where("place = 1").select("track", F.col("first").alias("frame_id"))
    heads = steps.where("leaves is not null").select("track", F.col("leaves").alias("frame_id")).union(start).distinct()
    jump = stored(steps.join(heads, ["track", "frame_id"], "left_semi").where("leaves is not null").select("track", F.col("frame_id").alias("at"), F.col("leaves").alias("to")))
    reached, work = start, [clean, ranges, steps, jump]
    while not jump.isEmpty():
        more = reached.join(jump, (reached["track"] == jump["track"]) & (reached["frame_id"] == jump["at"])).select(jump["track"], F.col("to").alias("frame_id"))
        reached = stored(reached.union(more).distinct())
        twice = jump.alias("j").join(jump.alias("k"), (F.col("j.track") == F.col("k.track")) & (F.col("j.to") == F.col("k.at"))).select("j.track", "j.at", "k.to")
        jump = stored(twice)
        work += [reached, jump]
    entered = steps.join(reached.withColumn("entry", F.lit(True)), ["track", "frame_id"], "left")
    out = stored(entered.groupBy("track", "range").applyInArrow(_walked, f"track {kind}, frame_id long"))
    for table in work:
        discard(table)
    return out
