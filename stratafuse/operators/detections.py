"""Object metrics: overlap of turned boxes, matching by confidence, average precision, and breaks of tracks.

Pairs of boxes are sought by the cells that both lie in; a pair counts in one of its common cells. Matching is by offers: every
prediction offers itself to the free truth it overlaps most, every truth keeps the most confident offer. As all truths rank offers alike, the outcome is that
of going through the predictions by falling confidence, but in rounds of joins instead of one loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafuse.session import discard, stored

BOX = ["x", "y", "z", "sx", "sy", "sz", "yaw"]
#: Classes of confidence for running counts; within a class the levels run by themselves.
LEVELS = 4096
#: Where cells begin, in cells: boxes on round coordinates then don't lie across the sides of cells.
ORIGIN = 0.382


def iou_2d(a: str, b: str) -> Column:
    """Overlap over union of two struct columns of x0, y0, x1, y1; 0 for boxes without area."""
    side = lambda c: F.greatest(F.least(f"{a}.{c}1", f"{b}.{c}1") - F.greatest(f"{a}.{c}0", f"{b}.{c}0"), F.lit(0.0))
    area = lambda s: F.greatest(F.col(f"{s}.x1") - F.col(f"{s}.x0"), F.lit(0.0)) * F.greatest(F.col(f"{s}.y1") - F.col(f"{s}.y0"), F.lit(0.0))
    common = side("x") * side("y")
    union = area(a) + area(b) - common
    return F.when(union > 0, common / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def _clip(poly: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (rows of poly, the first n corners) cut to the left of the lines from p to q."""
    rows, most = poly.shape[:2]
    at = np.arange(most)
    after = np.where(at[None] + 1 < n[:, None], at[None] + 1, 0)
    d = q - p
    side = d[:, None, 0] * (poly[..., 1] - p[:, None, 1]) - d[:, None, 1] * (poly[..., 0] - p[:, None, 0])
    nxt, side_next = np.take_along_axis(poly, after[..., None], 1), np.take_along_axis(side, after, 1)
    real = at[None] < n[:, None]
    share = np.divide(side, side - side_next, out=np.zeros_like(side), where=side != side_next)
    cut = poly + share[..., None] * (nxt - poly)
    points = np.stack([poly, cut], 2).reshape(rows, 2 * most, 2)
    keep = np.stack([real & (side >= 0), real & ((side > 0) & (side_next < 0) | (side < 0) & (side_next > 0))], 2).reshape(rows, 2 * most)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : most + 1]
    return np.take_along_axis(points, order[..., None], 1), keep.sum(1)


def overlap_3d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap over union of boxes (rows of BOX: centre, sizes, turn about y) that stand upright: their ground plans in x and z are
    clipped by half-planes, heights overlap in y."""

    def plan(v: np.ndarray) -> np.ndarray:
        c, s = np.cos(v[:, 6]), np.sin(v[:, 6])
        x, z = (np.array(k) * v[:, i, None] / 2 for k, i in (((-1, 1, 1, -1), 3), ((-1, -1, 1, 1), 5)))
        return np.stack([v[:, 0, None] + c[:, None] * x + s[:, None] * z, v[:, 2, None] - s[:, None] * x + c[:, None] * z], 2)

    def area(poly: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.arange(poly.shape[1])
        nxt = np.take_along_axis(poly, np.where(at[None] + 1 < n[:, None], at[None] + 1, 0)[..., None], 1)
        return np.abs(np.where(at[None] < n[:, None], poly[..., 0] * nxt[..., 1] - poly[..., 1] * nxt[..., 0], 0).sum(1)) / 2

    middle = a[:, [0, 2]][:, None]
    p, q = plan(a) - middle, plan(b) - middle
    turn = np.sign((q[:, 1, 0] - q[:, 0, 0]) * (q[:, 2, 1] - q[:, 0, 1]) - (q[:, 1, 1] - q[:, 0, 1]) * (q[:, 2, 0] - q[:, 0, 0]))
    q = np.where(turn[:, None, None] < 0, q[:, ::-1], q)
    n = np.full(len(a), 4)
    for i in range(4):
        p, n = _clip(p, n, q[:, i], q[:, (i + 1) % 4])
    high = np.clip(np.minimum(a[:, 1] + a[:, 4] / 2, b[:, 1] + b[:, 4] / 2) - np.maximum(a[:, 1] - a[:, 4] / 2, b[:, 1] - b[:, 4] / 2), 0, None)
    common = area(p, n) * high
    union = a[:, 3:6].prod(1) + b[:, 3:6].prod(1) - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = (np.stack([np.asarray(b.column(s + n)).astype(float) for n in BOX], 1).reshape(-1, 7) for s in ("a", "b"))
        yield pa.RecordBatch.from_arrays([b.column("truth"), b.column("guess"), pa.array(overlap_3d(a, c))], ["truth", "guess", "iou"])


def pairs_3d(truths: DataFrame, guesses: DataFrame, cell: float) -> DataFrame:
    """truth, guess, iou of all pairs of one frame and label whose boxes overlap.

    truths, guesses: id, frame_id, label and BOX (centre, sizes, yaw about y, in radians). Boxes are put into all cells of
    ``cell`` metres (in x and z) that their bounds touch; a pair is taken in the first common one. Rows with null values or without volume pair with nothing."""

    def cells(df: DataFrame, s: str) -> DataFrame:
        df = df.dropna(subset=["id", "frame_id", "label", *BOX]).where("sx > 0 and sy > 0 and sz > 0")
        c, t = F.abs(F.cos("yaw")), F.abs(F.sin("yaw"))
        half = {"x": (c * F.col("sx") + t * F.col("sz")) / 2, "z": (t * F.col("sx") + c * F.col("sz")) / 2}
        first = {k: F.floor((F.col(k) - h) / cell + ORIGIN) for k, h in half.items()}
        last = {k: F.floor((F.col(k) + h) / cell + ORIGIN) for k, h in half.items()}
        df = df.select(F.col("id").alias(f"{s}id"), "frame_id", "label", *[F.col(n).cast("double").alias(s + n) for n in BOX], *[first[k].alias(f"{s}c{k}") for k in "xz"], *[last[k].alias(f"_{k}") for k in "xz"])
        df = df.withColumn("kx", F.explode(F.sequence(F.col(f"{s}cx"), F.col("_x")))).withColumn("kz", F.explode(F.sequence(F.col(f"{s}cz"), F.col("_z"))))
        return df.drop("_x", "_z")

    both = cells(truths, "a").join(cells(guesses, "b"), ["frame_id", "label", "kx", "kz"])
    both = both.where((F.col("kx") == F.greatest("acx", "bcx")) & (F.col("kz") == F.greatest("acz", "bcz")))
    kinds = [dict(df.dtypes)["id"] for df in (truths, guesses)]
    rows = both.select(F.col("aid").alias("truth"), F.col("bid").alias("guess"), *[s + n for s in "ab" for n in BOX])
    return rows.mapInArrow(_overlaps, f"truth {kinds[0]}, guess {kinds[1]}, iou double").where("iou > 0")


def matches(pairs: DataFrame, guesses: DataFrame, least_iou: float, rounds: int = 100) -> DataFrame:
    """truth, guess, iou: predictions (guess, confidence) by falling confidence (then the smaller id) each take the free truth that they
    overlap most (then the smaller id), if by ``least_iou`` or more. RuntimeError if offers are left after ``rounds`` rounds."""
    ranked = pairs.where(F.col("iou") >= least_iou).join(guesses.select(F.col("id").alias("guess"), "confidence"), "guess")
    open_ = stored(ranked.select("truth", "guess", "iou", F.struct((-F.col("confidence")).alias("c"), F.col("guess").alias("g")).alias("rank")))
    work = [open_]
    for _ in range(rounds):
        offers = open_.groupBy("guess").agg(F.min(F.struct((-F.col("iou")).alias("i"), F.col("truth").alias("t"))).alias("o")).select("guess", F.col("o.t").alias("truth"))
        offered = open_.join(offers, ["guess", "truth"])
        best = offered.groupBy("truth").agg(F.min("rank").alias("top"))
        # an offer that a truth turns down is never made again
        refused = offered.join(best, "truth").where("rank <> top").select("guess", "truth")
        following = stored(open_.join(refused, ["guess", "truth"], "left_anti"))
        work.append(following)
        if following.count() == open_.count():
            out = stored(offered.join(best, "truth").where("rank = top").select("truth", "guess", "iou"))
            for table in work:
                discard(table)
            return out
        open_ = following
    raise RuntimeError(f"offers are open after {rounds} rounds")


def average_precision(guesses: DataFrame, truths: DataFrame, found: DataFrame) -> DataFrame:
    """label, n_truth, n_guess, n_found, ap: the area under the highest precision at each recall and beyond, for every label of truths (id, label).

    guesses: id, label, confidence (0 to 1); found: guess, of the matches. Equal confidences count at once. Running counts go by classes of
    confidence first, so a label of any size is spread over them."""
    hit = guesses.join(found.select(F.col("guess").alias("id"), F.lit(1).alias("hit")), "id", "left")
    level = hit.groupBy("label", "confidence").agg(F.count("hit").alias("tp"), F.count("*").alias("n")).withColumn("class", F.least(F.floor(F.col("confidence") * LEVELS), F.lit(LEVELS - 1)))
    down = lambda part, by, *frame: Window.partitionBy(*part).orderBy(F.desc(by)).rowsBetween(*frame)
    before, upto, rest, after = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing), (1, Window.unboundedFollowing)
    sums = level.groupBy("label", "class").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    sums = sums.select("label", "class", *[F.coalesce(F.sum(c).over(down(["label"], "class", *before)), F.lit(0)).alias(f"b{c}") for c in ("tp", "n")])
    run = level.join(sums, ["label", "class"])
    run = run.select("label", "class", "confidence", "tp", *[(F.col(f"b{c}") + F.sum(c).over(down(["label", "class"], "confidence", *upto))).alias(f"s{c}") for c in ("tp", "n")])
    run = run.withColumn("p", F.col("stp") / F.col("sn"))
    best = run.groupBy("label", "class").agg(F.max("p").alias("m"))
    best = best.select("label", "class", F.max("m").over(down(["label"], "class", *after)).alias("later"))
    run = run.join(best, ["label", "class"]).withColumn("top", F.greatest(F.coalesce("later", F.lit(0.0)), F.max("p").over(down(["label", "class"], "confidence", *rest))))
    totals = run.groupBy("label").agg(F.sum(F.col("tp") * F.col("top")).alias("area"), F.sum("tp").alias("n_found"))
    counts = truths.groupBy("label").agg(F.count("*").alias("n_truth")).join(guesses.groupBy("label").agg(F.count("*").alias("n_guess")), "label", "left").join(totals, "label", "left")
    return counts.select("label", "n_truth", F.coalesce("n_guess", F.lit(0)).alias("n_guess"), F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("area", F.lit(0.0)) / F.col("n_truth")).alias("ap"))


def track_breaks(seen: DataFrame) -> DataFrame:
    """truth, n_frames, n_matched, id_switches (matched by another track than when last matched), fragments (matched again after frames without a match), of
    seen: truth, frame_id, guess (the matched track, null if none), one row a truth and frame."""
    w = Window.partitionBy("truth").orderBy("frame_id")
    rows = seen.withColumns({"last": F.last("guess", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "before": F.lag(F.col("guess").isNotNull()).over(w)})
    return rows.groupBy("truth").agg(F.count("*").alias("n_frames"), F.count("guess").alias("n_matched"), F.count_if(F.col("guess") != F.col("last")).alias("id_switches"), F.count_if(F.col("guess").isNotNull() & F.col("last").isNotNull() & ~F.col("before")).alias("fragments"))
