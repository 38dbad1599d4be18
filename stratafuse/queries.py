"""Registered queries over the driver's tables, each with the SQL that it equals.

Scene queries generate a camera frame for each supplier, so their work grows with the data;
the others bind the same operators to real columns. Floating results are rounded to six
digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import blocks as B
from stratafuse.operators import checks as K
from stratafuse.operators import fusion as U
from stratafuse.operators import scenes as S
from stratafuse.operators import summaries as M
from stratafuse.operators import windows as W
from stratafuse.registry import QUERIES, SQL, query, rounded, table  # noqa: F401
from stratafuse.session import stored


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few rows that each become hundreds of pixels and thousands of voxels: spread them over all cores
    return S.supplier_frames(table(spark, sf_dir, "supplier")).repartition(spark.sparkContext.defaultParallelism)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fuse(S.render_frames(frames(spark, sf_dir)))


# ---------------------------------------------------------------- scene SQL

_F = """
f AS (SELECT s_suppkey AS frame_id, -0.4::DOUBLE + 0.05::DOUBLE * (s_suppkey % 17) AS ox, -0.3::DOUBLE + 0.05::DOUBLE * (s_suppkey % 13) AS oy, 0.25::DOUBLE + 0.03::DOUBLE * (s_suppkey % 11) AS oz FROM supplier),
g AS (SELECT f.*, p.range // 32 AS v, p.range % 32 AS u, (p.range % 32 - 15.5::DOUBLE) / 30.0::DOUBLE AS dx, (p.range // 32 - 11.5::DOUBLE) / 30.0::DOUBLE AS dy FROM f, range(768) p),
b AS (SELECT *, least(greatest((-1.5::DOUBLE - ox) / dx, (1.5::DOUBLE - ox) / dx), greatest((-1.0::DOUBLE - oy) / dy, (1.0::DOUBLE - oy) / dy), 4.0::DOUBLE - oz) AS room,
        greatest(least((-0.35::DOUBLE - ox) / dx, (0.35::DOUBLE - ox) / dx), least((-0.25::DOUBLE - oy) / dy, (0.45::DOUBLE - oy) / dy), 1.85::DOUBLE - oz) AS enter,
        least(greatest((-0.35::DOUBLE - ox) / dx, (0.35::DOUBLE - ox) / dx), greatest((-0.25::DOUBLE - oy) / dy, (0.45::DOUBLE - oy) / dy), 2.55::DOUBLE - oz) AS leave FROM g),
px AS (SELECT frame_id, v, u, ox, oy, oz, (enter <= leave AND enter > 1e-9 AND enter < room) AS obj, CAST(CASE WHEN enter <= leave AND enter > 1e-9 AND enter < room THEN enter ELSE room END AS FLOAT) AS depth FROM b)
"""
_V = (
    _F
    + """,
h AS (SELECT frame_id, ox::FLOAT::DOUBLE AS ox, oy::FLOAT::DOUBLE AS oy, oz::FLOAT::DOUBLE AS oz FROM f),
vx AS (SELECT range // 800 AS ix, (range // 40) % 20 AS iy, range % 40 AS iz FROM range(24000)),
q AS (SELECT frame_id, ix, iy, iz, -1.5::DOUBLE + (ix + 0.5::DOUBLE) * 0.1::DOUBLE - ox AS qx, -1.0::DOUBLE + (iy + 0.5::DOUBLE) * 0.1::DOUBLE - oy AS qy, 0.0::DOUBLE + (iz + 0.5::DOUBLE) * 0.1::DOUBLE - oz AS qz FROM h, vx),
r AS (SELECT *, round_even(30.0::DOUBLE * qx / qz + 15.5::DOUBLE, 0) AS u, round_even(30.0::DOUBLE * qy / qz + 11.5::DOUBLE, 0) AS v FROM q WHERE qz > 0),
sm AS (SELECT r.frame_id, ix, iy, iz, px.depth::DOUBLE - qz AS sd FROM r JOIN px ON px.frame_id = r.frame_id AND px.u = r.u AND px.v = r.v),
w AS (SELECT frame_id, ix, iy, iz, greatest(least(sd / (0.1::DOUBLE * 3.0::DOUBLE), 1), -1) AS s, 1.0::DOUBLE / (1.0::DOUBLE + 0.002::FLOAT::DOUBLE / 0.1::DOUBLE) AS w FROM sm WHERE abs(sd) <= 0.1::DOUBLE * 3.0::DOUBLE),
vol AS (SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, (sum(CAST(round(s * w * 1e9) AS BIGINT))::DOUBLE / sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE)::FLOAT::DOUBLE AS tsdf, (sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE / 1e9::DOUBLE)::FLOAT::DOUBLE AS weight FROM w GROUP BY 1, 2, 3),
n AS (SELECT count(*)::DOUBLE AS n FROM supplier),
sf AS (SELECT ix, iy, iz, -1.5::DOUBLE + (ix + 0.5::DOUBLE) * 0.1::DOUBLE AS x, -1.0::DOUBLE + (iy + 0.5::DOUBLE) * 0.1::DOUBLE AS y, 0.0::DOUBLE + (iz + 0.5::DOUBLE) * 0.1::DOUBLE AS z, tsdf,
        greatest(least(weight / n.n, 1), 0) AS confidence, 0.1::DOUBLE / sqrt(greatest(weight, 1)) + abs(tsdf) * (0.1::DOUBLE * 3.0::DOUBLE) AS uncertainty_m FROM vol, n WHERE weight > 0 AND abs(tsdf) <= 1.0::DOUBLE / 3.0::DOUBLE)
"""
)

@query(f"WITH {_V} SELECT ix, iy, iz, round(tsdf, 6) AS tsdf, round(weight, 4) AS weight FROM vol")
def fused_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-01, AGG-01..04: all frames fused into one sparse volume."""
    return rounded(rounded(volume(spark, sf_dir), "tsdf"), "weight", digits=4)


@query(f"WITH {_F} SELECT frame_id, count(*) AS n_pixels, CAST(sum(obj::INT) AS BIGINT) AS object_pixels, round(min(depth)::DOUBLE, 6) AS min_depth, round(max(depth)::DOUBLE, 6) AS max_depth, CAST(sum(CAST(round(depth::DOUBLE * 1e6) AS BIGINT)) AS BIGINT) AS depth_micro FROM px GROUP BY frame_id")
def scene_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-29, GEO-12..16: rendered depth of every frame."""
    d = F.col("depth_m").cast("double")
    px = S.render_pixels(frames(spark, sf_dir))
    return px.groupBy("frame_id").agg(F.count("*").alias("n_pixels"), F.sum("object_id").alias("object_pixels"), F.round(F.min(d), 6).alias("min_depth"), F.round(F.max(d), 6).alias("max_depth"), F.sum(F.round(d * 1e6).cast("long")).alias("depth_micro"))


@query(f"WITH {_V} SELECT ix, iy, iz, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(tsdf, 6) AS tsdf, round(confidence, 6) AS confidence, round(uncertainty_m, 6) AS uncertainty_m FROM sf")
def surface_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP-01: surface samples with confidence and uncertainty."""
    n = table(spark, sf_dir, "supplier").count()
    return rounded(U.extract_surface(volume(spark, sf_dir), n), "x", "y", "z", "tsdf", "confidence", "uncertainty_m")


_DIST = "(SELECT *, least(rd, bd) AS d FROM (SELECT *, {} AS rd, {} AS bd FROM sf))".format(
    *(
        f"CASE WHEN sqrt({o}) > 0 THEN sqrt({o}) ELSE least({i}) END"
        for o, i in (
            (
                " + ".join(f"greatest({lo}::DOUBLE - {c}, 0, {c} - {hi}::DOUBLE) * greatest({lo}::DOUBLE - {c}, 0, {c} - {hi}::DOUBLE)" for c, lo, hi in zip("xyz", *b, strict=True)),
                ", ".join(f"{c} - {lo}::DOUBLE, {hi}::DOUBLE - {c}" for c, lo, hi in zip("xyz", *b, strict=True)),
            )
            for b in (S.ROOM.room, S.ROOM.box)
        )
    )
)


@query(f"""WITH {_V}, d AS {_DIST} SELECT count(*) AS n_points, CAST(sum((rd <= bd)::INT) AS BIGINT) AS n_room, CAST(sum((bd < rd)::INT) AS BIGINT) AS n_box, round(avg((x BETWEEN -1.6 AND 1.6 AND y BETWEEN -1.1 AND 1.1 AND z BETWEEN -0.1 AND 4.1)::INT), 6) AS inside_ratio,
round(avg((d <= 0.100001)::INT), 6) AS within_voxel_ratio, round(avg(d), 6) AS mean_distance_m, round(quantile_cont(d, 0.95), 6) AS p95_distance_m, round(max(d), 6) AS max_distance_m,
{", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in "xyz" for f in ("min", "max"))} FROM d""")
def surface_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11..14, GEO-24, GEO-25: the surface against the analytic scene."""
    n = table(spark, sf_dir, "supplier").count()
    out = U.surface_against_scene(stored(U.extract_surface(volume(spark, sf_dir), n)))
    return rounded(out, *[c for c in out.columns if not c.startswith("n_")])


@query(f"""WITH {_V}, k AS (SELECT *, row_number() OVER (ORDER BY ix, iy, iz) - 1 AS r, count(*) OVER () AS m FROM sf),
p AS (SELECT range AS sample_id, CAST(floor((range + 0.5) * (SELECT count(*) FROM sf) / 256) AS BIGINT) AS r FROM range(256)),
t AS (SELECT p.sample_id, k.x, k.y, k.z FROM k JOIN p USING (r) WHERE m > 256 UNION ALL SELECT r, x, y, z FROM k WHERE m <= 256),
o AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, -1, 1)) o(corner, a, b))
SELECT sample_id, corner, sample_id * 3 + corner AS vertex_id, round(x + a * 0.016, 6) AS x, round(y + b * 0.016, 6) AS y, round(z, 6) AS z FROM t, o""")
def mesh_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, GEO-28, PIP-07/13: stratified surface samples as marker triangles."""
    n = table(spark, sf_dir, "supplier").count()
    surface = stored(U.extract_surface(volume(spark, sf_dir), n).select("ix", "iy", "iz", "x", "y", "z"))
    return rounded(U.triangle_markers(W.stratified_sample(surface, 256, "ix", "iy", "iz"), U.GRID.voxel), "x", "y", "z")


@query(
    f"""WITH {_V}, a AS (SELECT ix, iy, iz, (sum(CAST(round(s * w * 1e9) AS BIGINT))::DOUBLE / sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE)::FLOAT::DOUBLE AS t FROM w WHERE frame_id % 2 = 0 GROUP BY 1, 2, 3),
c AS (SELECT ix, iy, iz, (sum(CAST(round(s * w * 1e9) AS BIGINT))::DOUBLE / sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE)::FLOAT::DOUBLE AS t FROM w WHERE frame_id % 2 = 1 GROUP BY 1, 2, 3)
SELECT count(*) AS n_common, round(avg(abs(a.t - c.t)), 6) AS mean_abs_delta FROM a JOIN c USING (ix, iy, iz)"""
)
def volume_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-05, AGG-16, SET-08: two volumes on their common voxels."""
    samples = U.voxel_samples(S.render_frames(frames(spark, sf_dir)))
    return rounded(U.compare_halves(samples, F.col("frame_id") % 2 == 1), "mean_abs_delta")


_POINTS = _F + """, pt AS (SELECT frame_id, v, u, depth::DOUBLE AS d, (u - 15.5::DOUBLE) * depth::DOUBLE / 30.0::DOUBLE + ox::FLOAT::DOUBLE AS x, (v - 11.5::DOUBLE) * depth::DOUBLE / 30.0::DOUBLE + oy::FLOAT::DOUBLE AS y, depth::DOUBLE + oz::FLOAT::DOUBLE AS z FROM px)"""


@query(f"WITH {_POINTS} SELECT {', '.join(f'round(floor((min({c}) - (0.3::DOUBLE + 0.1::DOUBLE)) / 0.1::DOUBLE) * 0.1::DOUBLE, 6) AS min_{c}' for c in 'xyz')}, {', '.join(f'round(ceil((max({c}) + (0.3::DOUBLE + 0.1::DOUBLE)) / 0.1::DOUBLE) * 0.1::DOUBLE, 6) AS max_{c}' for c in 'xyz')} FROM pt")
def observation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05/06, GEO-03, GEO-20: padded, snapped bounds of all unprojected points."""
    fr = frames(spark, sf_dir)
    out = U.observation_bounds(S.world_points(S.render_pixels(fr)), 0.1, 0.3)
    return rounded(out, *out.columns)


@query(f"""WITH {_POINTS} SELECT CAST(floor(floor(x / 0.1::DOUBLE) / 8) AS INTEGER) AS bx, CAST(floor(floor(y / 0.1::DOUBLE) / 8) AS INTEGER) AS by, CAST(floor(floor(z / 0.1::DOUBLE) / 8) AS INTEGER) AS bz, count(*) AS n_points, count(DISTINCT (floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE))) AS n_voxels FROM pt GROUP BY 1, 2, 3""")
def spatial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-09: voxel and block hashing of world points."""
    pts = S.world_points(S.render_pixels(frames(spark, sf_dir)))
    return M.spatial_blocks(pts, 0.1).groupBy("bx", "by", "bz").agg(F.count("*").alias("n_points"), F.countDistinct("in_block").alias("n_voxels"))


@query(
    f"""WITH {_F}, c AS (SELECT frame_id, v, u, (u - 15.5::DOUBLE) * depth::DOUBLE / 30.0::DOUBLE AS x, (v - 11.5::DOUBLE) * depth::DOUBLE / 30.0::DOUBLE AS y, depth::DOUBLE AS z FROM px),
d AS (SELECT frame_id, v, u, {", ".join(f"CASE WHEN lead({c}) OVER {w} IS NOT NULL AND lag({c}) OVER {w} IS NOT NULL THEN (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 ELSE coalesce(lead({c}) OVER {w}, {c}) - coalesce(lag({c}) OVER {w}, {c}) END AS {w}{c}" for w in ("r", "k") for c in "xyz")} FROM c WINDOW r AS (PARTITION BY frame_id, v ORDER BY u), k AS (PARTITION BY frame_id, u ORDER BY v)),
n AS (SELECT *, ry * kz - rz * ky AS a, rz * kx - rx * kz AS b, rx * ky - ry * kx AS e FROM d),
m AS (SELECT frame_id, CASE WHEN sqrt(a*a + b*b + e*e) > 1e-12 THEN a / sqrt(a*a + b*b + e*e) ELSE 0 END AS nx, CASE WHEN sqrt(a*a + b*b + e*e) > 1e-12 THEN b / sqrt(a*a + b*b + e*e) ELSE 0 END AS ny, CASE WHEN sqrt(a*a + b*b + e*e) > 1e-12 THEN e / sqrt(a*a + b*b + e*e) ELSE 1 END AS nz FROM n)
SELECT frame_id, {", ".join(f"round(sum(round(n{c}, 9)), 4) AS sum_n{c}" for c in "xyz")} FROM m GROUP BY frame_id"""
)
def camera_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-17, WIN-01: stencil normals of every frame."""
    normals = W.frame_normals(S.render_frames(frames(spark, sf_dir)), 32, 24, 30.0, 30.0, 15.5, 11.5)
    return normals.groupBy("frame_id").agg(*[F.round(F.sum(F.round(f"n{c}", 9)), 4).alias(f"sum_n{c}") for c in "xyz"])


_Q = """q AS (SELECT c_custkey AS pose_id, ((c_custkey % 7) - 3)::DOUBLE AS a, ((c_custkey % 5) - 2)::DOUBLE AS b, ((c_custkey % 3) - 1)::DOUBLE AS c, 4.0::DOUBLE AS d, (c_custkey % 11)::DOUBLE AS tx, (c_custkey % 13)::DOUBLE AS ty, c_acctbal AS tz FROM customer),
n AS (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS k FROM q), u AS (SELECT pose_id, a/k AS x, b/k AS y, c/k AS z, d/k AS w, tx, ty, tz FROM n),
r AS (SELECT *, 1 - 2*(y*y + z*z) AS r0, 2*(x*y - z*w) AS r1, 2*(x*z + y*w) AS r2, 2*(x*y + z*w) AS r3, 1 - 2*(x*x + z*z) AS r4, 2*(y*z - x*w) AS r5, 2*(x*z - y*w) AS r6, 2*(y*z + x*w) AS r7, 1 - 2*(x*x + y*y) AS r8 FROM u)"""


@query(
    f"""WITH {_Q} SELECT pose_id, round(x, 6) AS qx, round(y, 6) AS qy, round(z, 6) AS qz, round(w, 6) AS qw, round(-(r0*tx + r3*ty + r6*tz), 4) AS ix, round(-(r1*tx + r4*ty + r7*tz), 4) AS iy, round(-(r2*tx + r5*ty + r8*tz), 4) AS iz,
true AS valid, round(tx, 6) AS cx FROM r"""
)
def pose_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-05..11, CHK-19/20: quaternion to rotation and back, inverse, composition to the identity."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    q = c.select(k.alias("pose_id"), F.array(((k % 7) - 3).cast("double"), ((k % 5) - 2).cast("double"), ((k % 3) - 1).cast("double"), F.lit(4.0)).alias("q"), F.array((k % 11).cast("double"), (k % 13).cast("double"), F.col("c_acctbal")).alias("t"))
    q = q.withColumn("T", G.make_transform(G.rotation_from_quaternion(G.mat("q", 4)), G.vec("t")))
    r, t = G.rotation_of("T"), G.camera_center("T")
    back = G.quaternion_from_rotation(r)
    ri, ti = G.invert_transform(r, t)
    rc, tc = G.compose_transforms(r, t, ri, ti)
    whole = F.lit(True)
    for x, want in zip((*rc, *tc), (1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), strict=True):
        whole = whole & (F.abs(x - float(want)) < 1e-6)
    return q.select("pose_id", *[F.round(x, 6).alias(n) for x, n in zip(back, ("qx", "qy", "qz", "qw"), strict=True)], *[F.round(x, 4).alias(n) for x, n in zip(ti, ("ix", "iy", "iz"), strict=True)], (whole & K.transform("T")).alias("valid"), F.round(t[0], 6).alias("cx"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 32)::DOUBLE AS u, (l_suppkey % 24)::DOUBLE AS v, 1 + l_discount AS d FROM lineitem),
c AS (SELECT *, (u - 15.5) / 30.0 * d AS x, (v - 11.5) / 30.0 * d AS y FROM p)
SELECT count(*) AS n, round(sum(CAST(round(x * 1e6) AS BIGINT)) / 1e6::DOUBLE, 6) AS sum_x, round(sum(CAST(round(y * 1e6) AS BIGINT)) / 1e6::DOUBLE, 6) AS sum_y, CAST(sum((abs(30.0 * x / d + 15.5 - u) < 1e-5)::INT) AS BIGINT) AS round_trips FROM c"""
)
def pinhole_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-01, GEO-02: unproject pixels, project them again."""
    k = tuple(F.lit(float(x)) for x in (30, 0, 15.5, 0, 30, 11.5, 0, 0, 1))
    u, v = (F.col("l_partkey") % 32).cast("double"), (F.col("l_suppkey") % 24).cast("double")
    x, y, z = G.unproject_pixels(u, v, F.lit(1.0) + F.col("l_discount"), k)
    rows = table(spark, sf_dir, "lineitem").select(u.alias("u"), v.alias("v"), x.alias("x"), y.alias("y"), z.alias("z"))
    pu, pv = G.project_points((F.col("x"), F.col("y"), F.col("z")), k)
    same = (F.abs(pu - F.col("u")) < 1e-5) & (F.abs(pv - F.col("v")) < 1e-5)
    micro = lambda c: F.round(F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.lit(1e6), 6)
    return rows.agg(F.count("*").alias("n"), micro("x").alias("sum_x"), micro("y").alias("sum_y"), F.sum(same.cast("long")).alias("round_trips"))


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(min(l_extendedprice), 6) AS min, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY l_returnflag")
def numeric_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07..10: five-number summaries with exact percentiles."""
    out = M.large_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return rounded(out, "min", "p50", "p95", "max").withColumn("mean", F.round("mean", 4))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER w - 1 AS event_index, (row_number() OVER w - 1) * 1000000 AS timestamp_ns, max(value) OVER w AS peak_in_memory, CAST(sum((event_type = 'error')::INT) OVER w AS BIGINT) AS dropped_total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT *, peak_in_memory <= 50 AS within_bound FROM e""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, STR-01..04: event index, running peak, drops and memory verdict of each run."""
    e = W.record_events(table(spark, sf_dir, "events"), "user_id", "event_id", "value", F.col("event_type") == "error", 50.0)
    return e.select("user_id", "event_id", "event_index", "timestamp_ns", "peak_in_memory", "dropped_total", "within_bound")


@query("""WITH l AS (SELECT user_id, event_id, value, event_id - lag(event_id) OVER w AS gap, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, 'dense_index' AS check FROM l WHERE CASE WHEN gap IS NULL THEN event_id <> 0 ELSE gap <> 1 END UNION ALL SELECT user_id, event_id, 'monotonic' FROM l WHERE value < before""")
def event_order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03, SRT-07: indices that aren't dense, counters that fall."""
    return W.order_violations(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id", "value")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, count(DISTINCT user_id) AS n_runs, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, DOC-06: counts and latency percentiles of each stage."""
    more = {"first_event": F.min("event_id"), "last_event": F.max("event_id"), "n_runs": F.countDistinct("user_id")}
    out = M.large_summary(table(spark, sf_dir, "events"), "value", "event_type", (0.5, 0.9, 0.99), more)
    return rounded(out.drop("min", "mean", "max"), "p50", "p90", "p99")


@query("""WITH s(i, stage) AS (VALUES (0, 'runtime_start'), (1, 'session_write'), (2, 'source_frame'), (3, 'adapter_cache_write'), (4, 'adapter_cache_frame'), (5, 'tsdf_replay'), (6, 'tsdf_replay_frame'), (7, 'tsdf_output_write'), (8, 'runtime_complete')),
n AS (SELECT count(*) AS n FROM supplier), r AS (SELECT s_suppkey AS frame_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier),
t AS (SELECT i, stage, stage LIKE '%_frame' AS f, sum(CASE WHEN stage LIKE '%_frame' THEN n.n ELSE 1 END) OVER (ORDER BY i) - CASE WHEN stage LIKE '%_frame' THEN n.n ELSE 1 END AS start FROM s, n)
SELECT CAST(start + k AS BIGINT) AS event_index, stage, frame_id FROM t, r WHERE f UNION ALL SELECT CAST(start AS BIGINT), stage, NULL FROM t WHERE NOT f""")
def expected_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: the stage sequence of a run over all frames."""
    return W.expected_layout(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id")))


@query("""SELECT event_id, 'k_missing' AS check FROM events WHERE NOT coalesce(json_exists(props, '$.k'), false) UNION ALL SELECT event_id, 'k_range' FROM events WHERE NOT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 90, false)
UNION ALL SELECT event_id, 'value' FROM events WHERE NOT coalesce(value >= 1, false) UNION ALL SELECT event_id, 'event_type' FROM events WHERE NOT coalesce(event_type IN ('click', 'view', 'error', 'purchase'), false)""")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-04, CHK-08: a suite of row checks as violations, in one scan."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    checks = {"k_missing": K.has_json_key("props", "k"), "k_range": k.between(0, 90), "value": K.finite_scalar("value") & (F.col("value") >= 1), "event_type": K.choice("event_type", ("click", "view", "error", "purchase"))}
    return K.violations(table(spark, sf_dir, "events"), "event_id", checks)


@query("SELECT vec_id, 'length' AS check FROM embeddings WHERE len(embedding) <> (SELECT max(len(embedding)) FROM embeddings) UNION ALL SELECT vec_id, 'range' FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0.3 UNION ALL SELECT vec_id, 'label' FROM embeddings WHERE label > 5")
def array_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-12, CHK-14: checks of array values."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return K.violations(e, "vec_id", {"length": K.vector("embedding", n), "range": F.forall("embedding", lambda x: F.abs(x) <= F.lit(0.3)), "label": F.col("label") <= 5})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-30: keys that occur more than once."""
    return K.duplicates(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT 'orders' AS side, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'documents', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, SET-05: keys of one table that the other lacks."""
    a = K.missing_keys(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")
    b = K.missing_keys(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), "key")
    return a.select(F.lit("orders").alias("side"), "key").unionByName(b.select(F.lit("documents").alias("side"), "key"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS m FROM documents), p AS (SELECT range AS sample_id, CAST(floor((range + 0.5) * (SELECT count(*) FROM documents) / 64) AS BIGINT) AS r FROM range(64))
SELECT sample_id, doc_id, lang FROM r JOIN p USING (r)""")
def stratified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05, LIM-01: evenly spaced samples of an ordered table."""
    return W.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), 64, "doc_id").select("sample_id", "doc_id", "lang")


@query("""WITH p AS (SELECT l_returnflag, l_extendedprice AS t, l_extendedprice * (1 + l_discount) AS p FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(abs(p - t) / t), 6) AS abs_rel, round(avg((p - t) * (p - t) / t), 3) AS sq_rel, round(sqrt(avg((p - t) * (p - t))), 3) AS rmse, round(sqrt(avg(pow(ln(p) - ln(t), 2))), 6) AS log_rmse, round(avg((greatest(p/t, t/p) < 1.25)::INT), 6) AS delta1, round(avg((greatest(p/t, t/p) < 1.5625)::INT), 6) AS delta2, round(avg((greatest(p/t, t/p) < 1.953125)::INT), 6) AS delta3 FROM p GROUP BY l_returnflag""")
def depth_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-01: depth error metrics of paired values."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("t"), (F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("p"))
    out = M.depth_errors(rows, "p", "t", ["l_returnflag"])
    return rounded(rounded(out, "abs_rel", "log_rmse", "delta1", "delta2", "delta3"), "sq_rel", "rmse", digits=3)


@query("""WITH m AS (SELECT user_id, value - lag(value) OVER w AS a, 1.01 * value - lag(1.01 * value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS n, round(sqrt(avg((a - b) * (a - b))), 6) AS rpe_rmse, round(sum(abs(a - b)) / nullif(sum(abs(b)), 0), 6) AS drift_per_metre FROM m WHERE a IS NOT NULL GROUP BY user_id""")
def relative_pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-02: relative error at a fixed interval and drift of each track."""
    e = table(spark, sf_dir, "events").withColumn("truth", F.lit(1.01) * F.col("value"))
    return rounded(M.relative_errors(e, "user_id", "event_id", ("value",), ("truth",)), "rpe_rmse", "drift_per_metre")


@query("SELECT CAST(least(floor(l_discount * 10 * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(l_discount * 10), 6) AS mean_confidence, round(avg((l_returnflag = 'A')::INT), 6) AS accuracy FROM lineitem GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-05: reliability by confidence bin."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("c"), "l_returnflag")
    return rounded(M.calibration(rows, "c", F.col("l_returnflag") == "A"), "mean_confidence", "accuracy")


@query("WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, len(roles) AS n_turns, array_to_string(list_transform(list_sort(list_transform(list_distinct(roles), lambda x: {'i': list_position(roles, x), 'r': x})), lambda x: x.r), ',') AS stable_roles FROM t")
def stable_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06, SET-06/07/11: ordered batches and their distinct values in first-seen order."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    roles = F.transform("x", lambda x: x["role"])
    return t.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join(W.stable_distinct(roles), ",").alias("stable_roles"))


from stratafuse import mesh_queries, record_queries, scene_queries  # noqa: E402, F401  register their own
