"""Order-dependent operators: stencils, event recorders, ranks without a single task, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.session import stored

# The stages of a run in order; those that name a frame come once for each frame.
STAGES = ("runtime_start", "session_write", "source_frame", "adapter_cache_write", "adapter_cache_frame", "tsdf_replay", "tsdf_replay_frame", "tsdf_output_write", "runtime_complete")


def estimate_normals(pixels: DataFrame) -> DataFrame:
    """pixels (frame_id, v, u, x, y, z in camera space) with unit normals nx, ny, nz: cross
    product of central differences (one-sided at borders); degenerate ones are (0, 0, 1)."""
    row, col = Window.partitionBy("frame_id", "v").orderBy("u"), Window.partitionBy("frame_id", "u").orderBy("v")

    def diff(c: str, w) -> Column:
        after, before = F.lead(c).over(w), F.lag(c).over(w)
        both = after.isNotNull() & before.isNotNull()
        return F.when(both, (after - before) / 2).otherwise(F.coalesce(after, F.col(c)) - F.coalesce(before, F.col(c)))

    out = pixels.withColumns({f"_u{c}": diff(c, row) for c in "xyz"})
    out = out.withColumns({f"_v{c}": diff(c, col) for c in "xyz"})
    n = G.cross(tuple(F.col(f"_u{c}") for c in "xyz"), tuple(F.col(f"_v{c}") for c in "xyz"))
    size = G.norm(n)
    flat = ~(size > 1e-12)
    named = {f"n{c}": F.when(flat, F.lit(1.0 if c == "z" else 0.0)).otherwise(G.safe_divide(x, size)) for c, x in zip("xyz", n, strict=True)}
    return out.withColumns(named).drop(*[f"_{a}{c}" for a in "uv" for c in "xyz"])


def frame_normals(frames: DataFrame, width: int, height: int, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """frame_id, v, u, nx, ny, nz of frame rows with a depth image (row-major array): the normals of
    :func:`estimate_normals`. A pixel's neighbours are looked up in its own row, so nothing is shuffled."""
    n = width * height
    rows = frames.select("frame_id", "depth", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_p"))
    rows = rows.withColumns({"v": F.expr(f"_p div {width}").cast("int"), "u": (F.col("_p") % width).cast("int")})
    near = {"l": (F.greatest(F.col("u") - 1, F.lit(0)), F.col("v")), "r": (F.least(F.col("u") + 1, F.lit(width - 1)), F.col("v")), "t": (F.col("u"), F.greatest(F.col("v") - 1, F.lit(0))), "b": (F.col("u"), F.least(F.col("v") + 1, F.lit(height - 1)))}
    rows = rows.select("frame_id", "v", "u", *[F.element_at("depth", (v * width + u + 1).cast("int")).cast("double").alias(f"_{k}") for k, (u, v) in near.items()])

    def point(k: str) -> G.Vec:
        u, v = near[k]
        d = F.col(f"_{k}")
        return ((u - F.lit(cx)) * d / F.lit(fx), (v - F.lit(cy)) * d / F.lit(fy), d)

    def slope(before: str, after: str, at: str, last: int) -> G.Vec:
        half = F.when((F.col(at) > 0) & (F.col(at) < last), F.lit(2.0)).otherwise(F.lit(1.0))
        return tuple((b - a) / half for a, b in zip(point(before), point(after), strict=True))

    rows = rows.select("frame_id", "v", "u", *[x.alias(f"_{a}{c}") for a, s in (("u", slope("l", "r", "u", width - 1)), ("v", slope("t", "b", "v", height - 1))) for c, x in zip("xyz", s, strict=True)])
    rows = rows.select("frame_id", "v", "u", *[x.alias(f"_n{c}") for c, x in zip("xyz", G.cross(tuple(F.col(f"_u{c}") for c in "xyz"), tuple(F.col(f"_v{c}") for c in "xyz")), strict=True)])
    size = G.norm(tuple(F.col(f"_n{c}") for c in "xyz"))
    flat = ~(size > 1e-12)
    return rows.select("frame_id", "v", "u", *[F.when(flat, F.lit(1.0 if c == "z" else 0.0)).otherwise(G.safe_divide(F.col(f"_n{c}"), size)).alias(f"n{c}") for c in "xyz"])


def record_events(df: DataFrame, run: str, order: str, in_memory: str, dropped: Column, bound: float) -> DataFrame:
    """Event log of each run: event_index from 0, running peak and drop count, whether the bound holds."""
    w = Window.partitionBy(run).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.max(in_memory).over(upto)
    index = F.row_number().over(w) - 1
    return df.select("*", index.cast("long").alias("event_index"), (index * 1_000_000).cast("long").alias("timestamp_ns"), peak.alias("peak_in_memory"), F.sum(dropped.cast("long")).over(upto).alias("dropped_total"), (peak <= bound).alias("within_bound"))


def order_violations(df: DataFrame, run: str, order: str, index: str, monotonic: str) -> DataFrame:
    """(run, index, check) where indices aren't dense from 0 or a counter falls."""
    w = Window.partitionBy(run).orderBy(order)
    before = F.lag(index).over(w)
    checks = F.array(
        F.when(F.coalesce(F.col(index) != before + 1, F.col(index) != 0), F.lit("dense_index")),
        F.when(F.col(monotonic) < F.lag(monotonic).over(w), F.lit("monotonic")),
    )
    return df.withColumn("_checks", F.array_compact(checks)).select(run, index, F.explode("_checks").alias("check"))


def expected_layout(frame_ids: DataFrame) -> DataFrame:
    """(event_index, stage, frame_id): the stages of a run over the frames (frame_id ascending);
    each stage that ends in _frame is repeated for every frame before the next stage begins."""
    spark, n = frame_ids.sparkSession, frame_ids.count()
    start, rows = 0, []
    for s in STAGES:
        rows.append((s, start, s.endswith("_frame")))
        start += n if s.endswith("_frame") else 1
    table = spark.createDataFrame(rows, "stage string, start long, each boolean")
    ranked = global_rank(frame_ids.select("frame_id"), "frame_id")
    frames = ranked.crossJoin(F.broadcast(table.where("each"))).select((F.col("start") + F.col("rank")).alias("event_index"), "stage", "frame_id")
    return frames.unionByName(table.where("not each").select(F.col("start").alias("event_index"), "stage", F.lit(None).cast("long").alias("frame_id")))


def global_rank(df: DataFrame, *keys: str) -> DataFrame:
    """df with ``rank`` from 0 in key order, without gathering rows in one task: range
    partitions are stored, counted, numbered inside and shifted by what lies before them. The
    keys must be unique for a rank that doesn't depend on ties. df is evaluated twice (its keys
    are sampled first), so what is dear should be stored before."""
    return _ranked(df, *keys)[0]


def _ranked(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    parts = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    base, total = [], 0
    for r in sizes:
        base.append((r["_part"], total))
        total += r["n"]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    bases = df.sparkSession.createDataFrame(base, "_part int, _base long")
    return parts.withColumn("_in", inside).join(F.broadcast(bases), "_part").withColumn("rank", (F.col("_base") + F.col("_in")).cast("long")).drop("_part", "_in", "_base"), total


def stratified_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """All rows if there are at most ``most``, else those of ranks floor((k + 0.5) * n / most), with sample_id k."""
    ranked, n = _ranked(df, *keys)
    if n <= most:
        return ranked.withColumnRenamed("rank", "sample_id")
    wanted = df.sparkSession.range(most).select(F.col("id").alias("sample_id"), F.floor((F.col("id") + 0.5) * n / most).cast("long").alias("rank"))
    return ranked.join(F.broadcast(wanted), "rank").drop("rank")


def stable_distinct(values: Column) -> Column:
    """Distinct values in order of first occurrence, nulls left out."""
    return F.array_distinct(F.array_compact(values))
