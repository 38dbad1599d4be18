"""Aggregates: numeric summaries, ratios, calibration, error and trajectory metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups that are summarised by selection; more of them are taken to be small ones. Values of an
#: interval that are sorted; larger ones are split into so many bins first.
FEW_GROUPS, SORTED, BINS = 1000, 4096, 1024


def numeric_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, mean, p50, p95, max of a column (exact percentiles by linear interpolation); nulls when empty.
    For many groups that each fit a task; :func:`large_summary` is for few large ones."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"))


def large_summary(df: DataFrame, value: str, by: str | None = None, points: tuple[float, ...] = (0.5, 0.95), more: dict[str, Column] | None = None) -> DataFrame:
    """by, n, min, mean, max, exact percentiles p<100 p> and the aggregates ``more`` of a finite
    column (nulls don't count), without gathering a group in a task.

    One scan counts and sketches; the sketch's error bounds an interval of values for each
    wanted rank, and further scans split the intervals by histograms until few values are left,
    which are sorted. Only histograms and those values leave the executors. More than
    FEW_GROUPS groups are summarised by a plain aggregate."""
    v, key = F.col(value).cast("double"), [by] if by else []
    names = [f"p{round(100 * p):g}" for p in points]
    plain = {"n": F.count(v), "min": F.min(v), "mean": F.avg(v), "max": F.max(v), **(more or {})}
    near = [min(1.0, max(0.0, p + d)) for p in points for d in (-4e-4, 4e-4)]
    first = df.groupBy(*key).agg(*[c.alias(n) for n, c in plain.items()], F.percentile_approx(v, near, 10_000).alias("_near"))
    rows = first.limit(FEW_GROUPS + 1).collect()
    if len(rows) > FEW_GROUPS:
        return df.groupBy(*key).agg(*[c.alias(n) for n, c in plain.items()], *[F.percentile(v, p).alias(n) for p, n in zip(points, names, strict=True)])
    wanted = []  # (group, rank, low, high) of the values between which a percentile lies
    for g, r in enumerate(rows):
        for i, p in enumerate(points if r["n"] else ()):
            at = (r["n"] - 1) * p
            wanted += [(g, k, r["_near"][2 * i], r["_near"][2 * i + 1]) for k in sorted({math.floor(at), math.ceil(at)})]
    found = _values_at(df.select(*key, v.alias("_v")).where("_v is not null"), by, [r[by] if by else None for r in rows], wanted, [(r["min"], r["max"]) for r in rows])
    out = []
    for g, r in enumerate(rows):
        done = []
        for p in points:
            at = (r["n"] - 1) * p
            lo, hi = (found.get((g, k)) for k in (math.floor(at), math.ceil(at)))
            done.append(None if lo is None else lo + (hi - lo) * (at - math.floor(at)))
        out.append((*(r[c] for c in key), *(r[n] for n in plain), *done))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in first.drop("_near").schema] + [f"{n} double" for n in names]
    return df.sparkSession.createDataFrame(out, ", ".join(fields))


def _values_at(values: DataFrame, by: str | None, groups: list, wanted: list[tuple], ends: list[tuple]) -> dict[tuple, float]:
    """{(group, rank): value}: the values of column _v at the wanted ranks (from 0) of each group."""
    spark, found = values.sparkSession, {}
    kind = values.schema[by].dataType.simpleString() if by else "int"
    todo = {(g, k): (lo, hi) for g, k, lo, hi in wanted}
    for _ in range(64):
        if not todo:
            return found
        spans = sorted(set((g, *x) for (g, _), x in todo.items()))
        table = spark.createDataFrame([(i, groups[g] if by else 0, float(lo), float(hi)) for i, (g, lo, hi) in enumerate(spans)], f"_i int, _g {kind}, _lo double, _hi double")
        same = F.col("_g").eqNullSafe(F.col(by)) if by else F.lit(True)
        inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        cell = F.when(F.col("_v") < F.col("_lo"), -1).when(~inside, BINS).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(5e-324)) * BINS), F.lit(BINS - 1)))
        # a few rows for each group and wanted rank: a map-side join
        hist = values.join(F.broadcast(table), same).groupBy("_i", cell.cast("int").alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where(F.col("_b") < BINS)
        cells: dict[int, list] = {}
        for r in hist.collect():
            cells.setdefault(r["_i"], []).append((r["_b"], r["n"], r["lo"], r["hi"]))
        ends_of = {x: i for i, x in enumerate(spans)}
        short: dict[tuple, list] = {}
        for (g, k), (lo, hi) in list(todo.items()):
            below, hit = 0, None
            for b, n, a, z in sorted(cells.get(ends_of[g, lo, hi], [])):
                if b >= 0 and k < below + n:
                    hit = (a, z, n) if k >= below else None
                    break
                below += n
            if hit is None or (below > k):  # the sketch's interval misses the rank: take all
                todo[g, k] = ends[g]
            elif hit[0] == hit[1]:
                found[g, k] = hit[0]
                del todo[g, k]
            else:
                todo[g, k] = hit[:2]
                if hit[2] <= SORTED:
                    short.setdefault((g, *hit[:2]), []).append((k, below))
        if short:
            order = sorted(short)
            table = spark.createDataFrame([(i, groups[g] if by else 0, float(lo), float(hi)) for i, (g, lo, hi) in enumerate(order)], f"_i int, _g {kind}, _lo double, _hi double")
            few = values.join(F.broadcast(table), same & inside).groupBy("_i").agg(F.array_sort(F.collect_list("_v")).alias("x"))  # SORTED at most
            for r in few.collect():
                for k, below in short[order[r["_i"]]]:
                    found[order[r["_i"]][0], k] = r["x"][k - below]
                    del todo[order[r["_i"]][0], k]
    raise RuntimeError("percentiles: intervals did not shrink")


def ratio(flag: Column) -> Column:
    """Share of rows for which flag is true; 0 when there are none."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def is_close(left: Column, right: Column, tolerance: float = 1e-6) -> Column:
    """|l - r| <= tolerance * (1 + |r|)."""
    return F.abs(left - right) <= F.lit(tolerance) + F.lit(tolerance) * F.abs(right)


def depth_errors(df: DataFrame, predicted: str, target: str, by: list[str] | None = None) -> DataFrame:
    """AbsRel, SqRel, RMSE, log-RMSE and the shares within 1.25, 1.25^2, 1.25^3 of valid pairs."""
    p, t = F.col(predicted).cast("double"), F.col(target).cast("double")
    rows = df.where((p > 0) & (t > 0))
    worst = F.greatest(p / t, t / p)
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(F.abs(p - t) / t).alias("abs_rel"), F.avg((p - t) * (p - t) / t).alias("sq_rel"),
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"), F.sqrt(F.avg(F.pow(F.ln(p) - F.ln(t), F.lit(2.0)))).alias("log_rmse"),
        *[F.avg((worst < 1.25**k).cast("double")).alias(f"delta{k}") for k in (1, 2, 3)],
    )


def calibration(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Rows by confidence bin: n, mean confidence, share correct."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def relative_errors(df: DataFrame, track: str, order: str, a: tuple[str, ...], b: tuple[str, ...], step: int = 1) -> DataFrame:
    """Relative translation error over ``step`` frames and distance travelled, for each track: the
    motion of trajectory a minus that of b."""
    w = Window.partitionBy(track).orderBy(order)
    moved = [[F.col(c) - F.lag(c, step).over(w) for c in cols] for cols in (a, b)]
    err = F.sqrt(sum(((x - y) * (x - y) for x, y in zip(*moved, strict=True)), F.lit(0.0)))
    path = F.sqrt(sum((x * x for x in moved[1]), F.lit(0.0)))
    rows = df.select(track, err.alias("error"), path.alias("path")).where("error is not null")
    return rows.groupBy(track).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rpe_rmse"), F.try_divide(F.sum("error"), F.sum("path")).alias("drift_per_metre"))


def pose_uncertainty(covariance: str) -> Column:
    """Largest square root of the clamped diagonal of a 6x6 covariance array."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.sqrt(F.greatest(F.element_at(covariance, i * 7 + 1), F.lit(0.0)))))


def mean_sigma_covariance(df: DataFrame, sigma: str, confidence: str, by: str) -> DataFrame:
    """Diagonal covariance of a frame: mean sigma^2 * (1 + max(0, 1 - mean confidence)), at least
    1e-8, a hundredth of it for the rotation."""
    base = df.groupBy(by).agg(F.avg(F.col(sigma) * F.col(sigma)).alias("s2"), F.avg(confidence).alias("c"))
    t = F.greatest(F.col("s2") * (1 + F.greatest(F.lit(0.0), 1 - F.col("c"))), F.lit(1e-8))
    return base.select(by, F.array(*[F.when(F.lit(i == j), t * (1.0 if i < 3 else 0.01)).otherwise(F.lit(0.0)) for i in range(6) for j in range(6)]).alias("covariance_6x6"))


def spatial_blocks(points: DataFrame, voxel: float, block: int = 8) -> DataFrame:
    """Points with their voxel (ix, iy, iz), block (bx, by, bz) and place in the block."""
    out = points.withColumns({f"i{c}": F.floor(F.col(c) / F.lit(voxel)).cast("int") for c in "xyz"})
    out = out.withColumns({f"b{c}": F.floor(F.col(f"i{c}") / block).cast("int") for c in "xyz"})
    return out.withColumn("in_block", (F.pmod("ix", F.lit(block)) * block + F.pmod("iy", F.lit(block))) * block + F.pmod("iz", F.lit(block)))


def match_summary(matches: DataFrame, source: str, target: str, confidence: str) -> DataFrame:
    """Dense matches (a row each) by pair of frames: how many, and a summary of their confidence."""
    return numeric_summary(matches, confidence, [source, target]).withColumnRenamed("n", "match_count")


def recorded_or(recorded: dict[str, float | None], rows: DataFrame, value: str) -> tuple[float, float]:
    """mean and p95 as a header records them; computed from rows where it lacks either."""
    if any(recorded.get(k) is None for k in ("mean", "p95")):
        recorded = large_summary(rows, value).first().asDict()
    return float(recorded["mean"]), float(recorded["p95"])


def prediction_losses(px: DataFrame, by: list[str], centers: DataFrame | None = None, weights: tuple[float, float, float, float] = (1.0, 0.05, 0.01, 0.1)) -> DataFrame:
    """Supervised metrics of pixels (depth, target, sigma, confidence, target_confidence) by group: smooth L1 depth loss,
    negative log likelihood of a Laplacian (sigma clipped to 1e-4..10), squared error of the confidence, MAE and RMSE of
    depth. With ``centers`` (by, x, y, z, tx, ty, tz): mean absolute error of camera centres, and the weighted total."""
    e = F.abs(F.col("depth") - F.col("target"))
    sigma = F.least(F.greatest(F.col("sigma"), F.lit(1e-4)), F.lit(10.0))
    c = F.col("confidence") - F.col("target_confidence")
    out = px.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(e < 1, e * e / 2).otherwise(e - 0.5)).alias("loss_depth"), F.avg(e / sigma + F.ln(sigma)).alias("loss_sigma_nll"), F.avg(c * c).alias("loss_confidence"),
        F.avg(e).alias("depth_mae_m"), F.sqrt(F.avg(e * e)).alias("depth_rmse_m"),
    )
    if centers is None:
        return out
    off = [F.abs(F.col(a) - F.col(f"t{a}")) for a in "xyz"]
    moved = centers.groupBy(*by).agg(F.avg((off[0] + off[1] + off[2]) / 3).alias("loss_pose_center"))
    total = sum((F.lit(w) * F.col(f"loss_{n}") for w, n in zip(weights, ("depth", "sigma_nll", "confidence", "pose_center"), strict=True)), F.lit(0.0))
    return out.join(moved, by).withColumns({"pose_center_mae_m": F.col("loss_pose_center"), "loss_total": total})


def running_best(metrics: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """metrics with the lowest value of each run so far."""
    upto = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return metrics.withColumn("best", F.min(value).over(upto))


def variance_covariance(df: DataFrame, sigma: str, by: str) -> DataFrame:
    """Covariance of a target's pose: the mean of sigma squared, at least 1e-8, on all of the diagonal."""
    v = F.greatest(F.avg(F.col(sigma) * F.col(sigma)), F.lit(1e-8))
    return df.groupBy(by).agg(v.alias("_v")).select(by, F.array(*[F.col("_v") if i % 7 == 0 else F.lit(0.0) for i in range(36)]).alias("covariance_6x6"))
