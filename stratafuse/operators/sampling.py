"""Training clips from sequences, and the schedule by which sources are mixed over training steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafuse.operators.windows import global_rank

#: Frame ids of a range; a range sees the ids of a clip's reach behind it too.
RANGE = 8192
CLIPS = "start long, frame_ids array<long>"


def _clips(length: int, stride: int, step: int, most_gap: int, size: int):
    reach = (length - 1) * stride

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low = key[1].as_py() * size
        here = np.unique(np.asarray(rows.column("frame_id"))) - low
        there = np.zeros(size + reach, bool)
        there[here] = True
        # how many ids in a row are missing, up to each id
        run_of = np.arange(size + reach) - np.maximum.accumulate(np.where(there, np.arange(size + reach), -1))
        broken = np.concatenate([[0], np.cumsum(run_of > most_gap)])
        start = here[(here < size) & ((here + low) % step == 0)]
        ids = start[:, None] + stride * np.arange(length)
        whole = there[ids].all(1) & (broken[start + reach + 1] == broken[start])
        start, ids = start[whole], ids[whole] + low
        n = len(start)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * length, pa.int32()), pa.array(ids.ravel(), pa.int64()))
        return pa.table({"sequence": pa.array([key[0].as_py()] * n, rows.schema.field("sequence").type), "start": pa.array(start + low, pa.int64()), "frame_ids": lists})

    return run


def strided_clips(frames: DataFrame, length: int, stride: int = 1, step: int = 1, most_gap: int = 0, size: int = RANGE) -> DataFrame:
    """sequence, start, frame_ids of all clips of ``length`` frames, ``stride`` ids apart, that begin at a multiple of ``step``, have all
    their frames, and between whose first and last frame nowhere more than ``most_gap`` ids in a row are missing.

    frames: sequence, frame_id (not negative); nulls don't count and repeated frames count once. A sequence is cut into ranges of ``size`` ids
    that see a clip's reach beyond their end, so sequences of any length are spread over tasks and clips cross ranges."""
    reach = (length - 1) * stride
    if min(length, stride, step) < 1 or reach > size:
        raise ValueError("length, stride, step: must be positive, and a clip no longer than a range")
    rows = frames.dropna(subset=["sequence", "frame_id"]).select("sequence", F.col("frame_id").cast("long").alias("frame_id"))
    own = F.floor(F.col("frame_id") / F.lit(size))
    inside = F.col("frame_id") - own * size
    rows = rows.withColumn("range", F.explode(F.when((inside < reach) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    kind = dict(frames.dtypes)["sequence"]
    return rows.groupBy("sequence", "range").applyInArrow(_clips(length, stride, step, most_gap, size), f"sequence {kind}, {CLIPS}")


def share(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of its parts: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def scheduled_weights(steps: DataFrame, stages: list[tuple[int, dict[str, float]]]) -> DataFrame:
    """steps (step, ...) with ``weights``: an array of (source, upto), the running shares of the sources (by name) at that step. Between
    two stages (first step, weights) shares go over in a straight line; before the first and after the last they are constant."""
    if not stages or any(min(w.values(), default=0) < 0 or sum(w.values()) <= 0 for _, w in stages) or [s for s, _ in stages] != sorted({s for s, _ in stages}):
        raise ValueError("stages: need rising first steps and weights that aren't negative and not all zero")
    names = sorted({n for _, w in stages for n in w})
    shares = [(s, [w.get(n, 0.0) / sum(w.values()) for n in names]) for s, w in stages]

    def at(i: int) -> Column:
        out = F.lit(float(shares[-1][1][i]))
        for (s, a), (t, b) in reversed(list(zip(shares, shares[1:], strict=False))):
            out = F.when(F.col("step") < t, F.lit(float(a[i])) + F.lit(float(b[i] - a[i])) * ((F.col("step") - s) / F.lit(float(t - s)))).otherwise(out)
        return F.when(F.col("step") <= shares[0][0], F.lit(float(shares[0][1][i]))).otherwise(out)

    running, upto = F.lit(0.0), []
    for i, n in enumerate(names):
        running = running + at(i)
        upto.append(F.struct(F.lit(n).alias("source"), running.alias("upto")))
    return steps.withColumn("weights", F.array(*upto))


def training_schedule(items: DataFrame, stages: list[tuple[int, dict[str, float]]], steps: int, batch: int, seed: int = 0) -> DataFrame:
    """step, slot, source and item (its id) of each of ``batch`` slots of ``steps`` steps; items: source, id.

    A slot's digest falls below one of the running shares of its step, which names its source, and a second digest picks one of the source's
    items: reruns agree, and no state is handed from step to step. Sources without items raise ValueError."""
    ranked = global_rank(items.dropna(subset=["source", "id"]).select("source", "id").distinct(), "source", "id")
    first = ranked.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    named = sorted({n for _, w in stages for n, x in w.items() if x > 0})
    known = {r["source"] for r in first.where(F.col("source").isin(named)).collect()}  # at most the sources of the stages
    if set(named) - known:
        raise ValueError(f"stages: no items of {', '.join(sorted(set(named) - known))}")
    slots = items.sparkSession.range(steps * batch).select(F.expr(f"id div {batch}").alias("step"), (F.col("id") % batch).alias("slot"))
    slots = scheduled_weights(slots, stages).withColumn("u", share(F.lit(seed), F.col("step"), F.col("slot")))
    hit = F.filter("weights", lambda w: F.col("u") < w["upto"])
    last = F.element_at(F.filter("weights", lambda w: w["upto"] > 0), -1)["source"]  # rounding can leave the last share below 1
    slots = slots.withColumn("source", F.coalesce(F.get(hit, F.lit(0))["source"], last))
    picked = slots.join(F.broadcast(first.where(F.col("source").isin(named))), "source")  # a row a source of the stages
    place = picked.select("step", "slot", "source", (F.col("first") + F.floor(share(F.lit(seed), F.lit("item"), F.col("step"), F.col("slot")) * F.col("n"))).alias("rank"))
    return place.join(ranked.select("rank", F.col("id").alias("item")), "rank").select("step", "slot", "source", "item")
