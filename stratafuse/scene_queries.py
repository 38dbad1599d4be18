"""Registered queries over rooms, drawings, losses and pose statistics, each with the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import blocks as B
from stratafuse.operators import fusion as U
from stratafuse.operators import rooms as M
from stratafuse.operators import scenes as S
from stratafuse.operators import summaries as A
from stratafuse.plans import previews as P
from stratafuse.registry import query, rounded, table

_W, _H = 16, 12


def part_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room with one to three boxes for each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    box = []
    for i in range(3):
        mid = (F.lit(-0.5) + F.lit(0.2) * ((k + 3 * i) % 6), F.lit(-0.4) + F.lit(0.15) * ((size + i) % 6), F.lit(1.4) + F.lit(0.3) * ((k + 2 * i) % 6))
        half = (F.lit(0.15) + F.lit(0.02) * ((size + i) % 5), F.lit(0.2), F.lit(0.25))
        color = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in M.PALETTE]), ((k + i) % 4 + 1).cast("int"))
        box.append(F.struct(F.array(*[m - h for m, h in zip(mid, half, strict=True)]).alias("low"), F.array(*[m + h for m, h in zip(mid, half, strict=True)]).alias("high"), color.alias("color")))
    return table(spark, sf_dir, "part").select(
        k.alias("sample_id"), F.lit(_W).alias("width"), F.lit(_H).alias("height"), (F.lit(3.5) + F.lit(0.7) * (size % 8)).alias("far"), (F.lit(-0.35) + F.lit(0.1) * (k % 8)).alias("ox"), (F.lit(-0.22) + F.lit(0.04) * (k % 11)).alias("oy"), (F.lit(0.25) + F.lit(0.05) * (k % 8)).alias("oz"),
        F.slice(F.array(*box), 1, (k % 3 + 1).cast("int")).alias("boxes"), F.array((size + 92).cast("int"), F.lit(100), F.lit(140)).alias("color_a"), F.array((size + 150).cast("int"), F.lit(180), F.lit(210)).alias("color_b"),
    )


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _room_sql() -> str:
    """The pixels of the rooms of parts, traced: CTEs up to px(sample_id, v, u, depth, hit, r, g, b)."""
    boxes = []
    for i in range(3):
        mid = {"x": f"({_d(-0.5)} + {_d(0.2)} * ((p_partkey + {3 * i}) % 6))", "y": f"({_d(-0.4)} + {_d(0.15)} * ((p_size + {i}) % 6))", "z": f"({_d(1.4)} + {_d(0.3)} * ((p_partkey + {2 * i}) % 6))"}
        half = {"x": f"({_d(0.15)} + {_d(0.02)} * ((p_size + {i}) % 5))", "y": _d(0.2), "z": _d(0.25)}
        boxes += [f"CASE WHEN p_partkey % 3 >= {i} THEN {mid[c]} {s} {half[c]} END AS {n}{i}{c}" for n, s in (("l", "-"), ("h", "+")) for c in "xyz"]
    focal, cx, cy = "CAST(14.4 AS FLOAT)::DOUBLE", "7.5::DOUBLE", "5.5::DOUBLE"
    ray = {"x": "dx", "y": "dy", "z": "1.0::DOUBLE"}

    def slab(low: dict[str, str], high: dict[str, str]) -> tuple[str, str]:
        t = {c: (f"(({low[c]}) - o{c}) / {ray[c]}", f"(({high[c]}) - o{c}) / {ray[c]}") for c in "xyz"}
        return "greatest(" + ", ".join(f"least({a}, {b})" for a, b in t.values()) + ")", "least(" + ", ".join(f"greatest({a}, {b})" for a, b in t.values()) + ")"

    hits = []
    for i in range(3):
        near, out = slab({c: f"l{i}{c}" for c in "xyz"}, {c: f"h{i}{c}" for c in "xyz"})
        hits.append(f"CASE WHEN l{i}x IS NOT NULL AND {near} <= {out} AND {out} > 1e-9 AND {near} > 1e-9 THEN {near} END AS b{i}")
    room = slab(dict(zip("xyz", map(_d, M.LOW), strict=True)), {"x": _d(M.HIGH[0]), "y": _d(M.HIGH[1]), "z": "far"})
    nearest, which, best = "d0", "-1", []
    for i in range(3):
        best.append(f"s{i} AS (SELECT *, CASE WHEN coalesce(b{i} < {nearest}, false) THEN b{i} ELSE {nearest} END AS n{i}, CASE WHEN coalesce(b{i} < {nearest}, false) THEN {i} ELSE {which} END AS w{i} FROM {'t' if i == 0 else f's{i - 1}'})")
        nearest, which = f"n{i}", f"w{i}"
    pick = lambda n, c: "CASE w2 " + " ".join(f"WHEN {i} THEN {n}{i}{c}" for i in range(3)) + " END"
    own = {c: f"((p{c} - ({pick('l', c)})) / greatest(({pick('h', c)}) - ({pick('l', c)}), 1e-6))" for c in "xyz"}
    odd = "(CAST(floor(px * 4.0::DOUBLE) + floor(py * 4.0::DOUBLE) AS BIGINT) & 1) = 1"
    z, x = "((pz - 0.0::DOUBLE) / greatest(far - 0.0::DOUBLE, 1e-6))", f"((px - {_d(-1.8)}) / {_d(3.6)})"
    cue = (f"40.0::DOUBLE * {z}", f"35.0::DOUBLE * {x}", f"30.0::DOUBLE * (1.0::DOUBLE - {z})")
    wall_a, wall_b = ("p_size + 92", "100", "140"), ("p_size + 150", "180", "210")
    stripe = "(0.75::DOUBLE + 0.25::DOUBLE * (CAST(floor((ox1 + oy1 + oz1) * 6.0::DOUBLE) AS BIGINT) & 1))"
    colors = []
    for i, c in enumerate("rgb"):
        tone = "CASE (p_partkey + w2) % 4 " + " ".join(f"WHEN {n} THEN {p[i]}" for n, p in enumerate(M.PALETTE)) + " END"
        wall = f"CAST(CASE WHEN {odd} THEN {wall_b[i]} ELSE {wall_a[i]} END AS DOUBLE) * 0.82::DOUBLE + {cue[i]}"
        boxed = f"CAST({tone} AS DOUBLE) * {stripe} + {(28.0, 24.0, 30.0)[i]!r}::DOUBLE * o{'xyz'[i]}1"
        colors.append(f"CAST(trunc(least(greatest(CASE WHEN w2 < 0 THEN {wall} ELSE {boxed} END, 0), 255)) AS INTEGER) AS {c}")
    return f"""f AS (SELECT p_partkey, p_size, {_d(3.5)} + {_d(0.7)} * (p_size % 8) AS far, {_d(-0.35)} + {_d(0.1)} * (p_partkey % 8) AS ox, {_d(-0.22)} + {_d(0.04)} * (p_partkey % 11) AS oy, {_d(0.25)} + {_d(0.05)} * (p_partkey % 8) AS oz, {", ".join(boxes)} FROM part),
g AS (SELECT f.*, CAST(range // {_W} AS INTEGER) AS v, CAST(range % {_W} AS INTEGER) AS u, (range % {_W} - {cx}) / {focal} AS dx, (range // {_W} - {cy}) / {focal} AS dy FROM f, range({_W * _H})),
t AS (SELECT *, CASE WHEN {room[0]} > 1e-9 THEN {room[0]} ELSE {room[1]} END AS d0, {", ".join(hits)} FROM g), {", ".join(best)},
pt AS (SELECT *, ox + dx * n2 AS px, oy + dy * n2 AS py, oz + 1.0::DOUBLE * n2 AS pz FROM s2), lo AS (SELECT *, {", ".join(f"{own[c]} AS o{c}1" for c in "xyz")} FROM pt),
px AS (SELECT p_partkey AS sample_id, v, u, n2 AS depth, w2 AS hit, {", ".join(colors)} FROM lo)"""


@query(f"WITH {_room_sql()} SELECT sample_id, count(*) AS n_pixels, CAST(sum((hit >= 0)::INT) AS BIGINT) AS box_pixels, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(CAST(round(depth * 1e6) AS BIGINT)) AS BIGINT) AS depth_micro, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM px GROUP BY sample_id")
def traced_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-31, JOI-04, GEO-21..23, GEO-43, GEO-44: rooms of several boxes traced, with colours."""
    return M.room_totals(part_rooms(spark, sf_dir))


def posed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of suppliers with turned cameras, their own K, and sigma and confidence for each pixel."""
    rows = S.supplier_frames(table(spark, sf_dir, "supplier")).repartition(spark.sparkContext.defaultParallelism)
    k = F.col("frame_id")
    q = F.array(F.lit(0.0), (k % 7 - 3) * 0.05, F.lit(0.0), F.lit(1.0))
    rows = rows.withColumn("q", q)
    pose = G.make_transform(G.rotation_from_quaternion(G.mat("q", 4)), (F.col("ox"), F.col("oy"), F.col("oz")))
    focal = F.lit(30.0) + (k % 3)
    zero, one = F.lit(0.0), F.lit(1.0)
    px = F.sequence(F.lit(0), F.lit(32 * 24 - 1))
    rows = rows.withColumns({"T_world_camera": pose, "K": F.array(focal, zero, F.lit(15.5), zero, focal, F.lit(11.5), zero, zero, one)})
    return rows.select(
        "frame_id", "K", "T_world_camera", F.transform(px, lambda p: (F.lit(1.2) + F.lit(0.01) * ((p + k) % 97)).cast("float")).alias("depth"), F.transform(px, lambda p: (F.lit(0.001) * ((p * 3 + k) % 50)).cast("float")).alias("sigma"),
        F.transform(px, lambda p: (F.lit(0.25) * ((p + k * 2) % 5)).cast("float")).alias("confidence"),
    )


_f32 = lambda x: f"({x})::FLOAT::DOUBLE"
_POSED = f"""s AS (SELECT s_suppkey AS k, {_d(-0.4)} + {_d(0.05)} * (s_suppkey % 17) AS ox, {_d(-0.3)} + {_d(0.05)} * (s_suppkey % 13) AS oy, {_d(0.25)} + {_d(0.03)} * (s_suppkey % 11) AS oz, (s_suppkey % 7 - 3) * {_d(0.05)} AS qy, {_d(30.0)} + (s_suppkey % 3) AS f FROM supplier),
n AS (SELECT *, sqrt(0.0::DOUBLE * 0.0::DOUBLE + qy * qy + 0.0::DOUBLE * 0.0::DOUBLE + 1.0::DOUBLE * 1.0::DOUBLE) AS m FROM s), u AS (SELECT *, qy / m AS y, 1.0::DOUBLE / m AS w FROM n),
r AS (SELECT k, {_f32("f")} AS f, {_f32("ox")} AS tx, {_f32("oy")} AS ty, {_f32("oz")} AS tz, {_f32("1 - 2.0::DOUBLE * (y * y + 0.0::DOUBLE)")} AS r0, {_f32("2.0::DOUBLE * (0.0::DOUBLE + y * w)")} AS r2, {_f32("2.0::DOUBLE * (0.0::DOUBLE - y * w)")} AS r6, {_f32("1 - 2.0::DOUBLE * (0.0::DOUBLE + y * y)")} AS r8 FROM u),
b AS (SELECT *, -(r0 * tx + r6 * tz) AS sx, -ty AS sy, -(r2 * tx + r8 * tz) AS sz FROM r),
v AS (SELECT b.*, range // 800 AS ix, (range // 40) % 20 AS iy, range % 40 AS iz, -1.5::DOUBLE + (range // 800 + 0.5::DOUBLE) * 0.1::DOUBLE AS x, -1.0::DOUBLE + ((range // 40) % 20 + 0.5::DOUBLE) * 0.1::DOUBLE AS y, 0.0::DOUBLE + (range % 40 + 0.5::DOUBLE) * 0.1::DOUBLE AS z FROM b, range(24000)),
q AS (SELECT *, r0 * x + 0.0::DOUBLE * y + r6 * z + sx AS qx, y + sy AS qy, r2 * x + 0.0::DOUBLE * y + r8 * z + sz AS qz FROM v),
p AS (SELECT *, round_even(f * qx / qz + 15.5::DOUBLE, 0) AS pu, round_even(f * qy / qz + 11.5::DOUBLE, 0) AS pv FROM q WHERE qz > 0),
c AS (SELECT *, CAST(pv * 32 + pu AS BIGINT) AS pix FROM p WHERE pu >= 0 AND pu < 32 AND pv >= 0 AND pv < 24),
d AS (SELECT ix, iy, iz, {_f32(f"{_d(1.2)} + {_d(0.01)} * ((pix + k) % 97)")} - qz AS sd, {_f32(f"{_d(0.25)} * ((pix + k * 2) % 5)")} / (1.0::DOUBLE + {_f32(f"{_d(0.001)} * ((pix * 3 + k) % 50)")} / 0.1::DOUBLE) AS w FROM c),
o AS (SELECT ix, iy, iz, greatest(least(sd / (0.1::DOUBLE * 3.0::DOUBLE), 1), -1) AS s, w FROM d WHERE abs(sd) <= 0.1::DOUBLE * 3.0::DOUBLE AND w > 0)"""


@query(f"WITH {_POSED} SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, round((sum(CAST(round(s * w * 1e9) AS BIGINT))::DOUBLE / sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE)::FLOAT::DOUBLE, 4) AS tsdf, round((sum(CAST(round(w * 1e9) AS BIGINT))::DOUBLE / 1e9::DOUBLE)::FLOAT::DOUBLE, 4) AS weight FROM o GROUP BY 1, 2, 3")
def posed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-01, AGG-01, AGG-03, AGG-04: turned cameras with their own K, sigma and confidence a pixel, fused."""
    return rounded(B.fuse(posed_frames(spark, sf_dir)), "tsdf", "weight", digits=4)


def attributed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posed frames with a colour, a normal and an object for each pixel."""
    k, px = F.col("frame_id"), F.sequence(F.lit(0), F.lit(32 * 24 - 1))
    more = {
        "color": F.flatten(F.transform(px, lambda p: F.array((p * 3 + k) % 256, (p + k * 5) % 256, (p * 7 + k * 2) % 256))), "normal": F.flatten(F.transform(px, lambda p: F.array(((p + k) % 5 - 2) / 4.0, ((p * 3 + k) % 7 - 3) / 8.0, F.lit(1.0).cast("double")))),
        "object": F.transform(px, lambda p: F.when((F.floor(p / 64) + k) % 4 > 0, (F.floor(p / 64) + k) % 4)),
    }
    return posed_frames(spark, sf_dir).withColumns(more)


_sum6 = lambda x, n: f"CAST(sum(CAST(round(({x}) * 1e6) AS BIGINT)) AS BIGINT) AS {n}"


@query(f"""WITH {_POSED.partition("d AS (SELECT")[0]}d AS (SELECT ix, iy, iz, pix, k, {_f32(f"{_d(1.2)} + {_d(0.01)} * ((pix + k) % 97)")} - qz AS sd, {_f32(f"{_d(0.25)} * ((pix + k * 2) % 5)")} / (1.0::DOUBLE + {_f32(f"{_d(0.001)} * ((pix * 3 + k) % 50)")} / 0.1::DOUBLE) AS w FROM c),
o AS (SELECT *, (pix // 64 + k) % 4 AS obj FROM d WHERE abs(sd) <= 0.1::DOUBLE * 3.0::DOUBLE AND w > 0),
l AS (SELECT ix, iy, iz, nullif(obj, 0) AS obj, {_sum6("w", "w")}, {_sum6("w * ((pix * 3 + k) % 256)", "r")}, {_sum6("w * ((pix + k * 5) % 256)", "g")}, {_sum6("w * ((pix * 7 + k * 2) % 256)", "b")}, {_sum6("w * (((pix + k) % 5 - 2) / 4.0::DOUBLE)", "nx")}, {_sum6("w * (((pix * 3 + k) % 7 - 3) / 8.0::DOUBLE)", "ny")}, {_sum6("w * 1.0::DOUBLE", "nz")} FROM o GROUP BY 1, 2, 3, 4),
m9 AS (SELECT ix, iy, iz, {", ".join(f"sum({c})::DOUBLE AS {c}" for c in ("w", "r", "g", "b", "nx", "ny", "nz"))}, (list(obj ORDER BY w DESC, obj) FILTER (obj IS NOT NULL))[1] AS top, max(w) FILTER (obj IS NOT NULL) AS most, (sum(w) FILTER (obj IS NOT NULL))::DOUBLE AS known, count(obj) AS n_objects FROM l GROUP BY 1, 2, 3)
SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, round(w / 1e6, 6) AS weight, round(r / w, 4) AS red, round(g / w, 4) AS green, round(b / w, 4) AS blue, {", ".join(f"round({c} / sqrt(nx * nx + ny * ny + nz * nz), 4) + 0.0 AS {c}" for c in ("nx", "ny", "nz"))}, CAST(top AS BIGINT) AS object_id, round(most / known, 4) AS object_share, n_objects FROM m9""")
def fused_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-10: colours, normals and objects fused beside the distances."""
    out = B.fuse_attributes(attributed_frames(spark, sf_dir))
    return rounded(rounded(out, "weight"), "red", "green", "blue", "nx", "ny", "nz", "object_share", digits=4).withColumns({c: F.col(c) + F.lit(0.0) for c in ("nx", "ny", "nz")})


_POINTS = _POSED.partition("b AS (SELECT")[0] + f"""e AS (SELECT r.*, range % 32 AS pu, range // 32 AS pv, {_f32(f"{_d(1.2)} + {_d(0.01)} * ((range + k) % 97)")} AS d, {_f32(f"{_d(0.25)} * ((range + k * 2) % 5)")} AS c FROM r, range(768)),
l AS (SELECT *, (pu * f - 15.5::DOUBLE * f) / (f * f) * d AS x, (pv * f - 11.5::DOUBLE * f) / (f * f) * d AS y FROM e WHERE c > 0),
w AS (SELECT {_f32("r0 * x + r2 * d + tx")} AS x, {_f32("y + ty")} AS y, {_f32("r6 * x + r8 * d + tz")} AS z FROM l)"""


@query(f"WITH {_POINTS} SELECT count(*) AS n, {', '.join(f'round(floor((min({c}) - (0.3::DOUBLE + 0.1::DOUBLE)) / 0.1::DOUBLE) * 0.1::DOUBLE, 6) AS min_{c}, round(ceil((max({c}) + (0.3::DOUBLE + 0.1::DOUBLE)) / 0.1::DOUBLE) * 0.1::DOUBLE, 6) AS max_{c}, round(avg({c}), 5) AS mean_{c}' for c in 'xyz')} FROM w")
def posed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-03, GEO-20, AGG-05, AGG-06, SET-01: points of turned cameras with their own K, and the grid around them."""
    points = B.frame_points(posed_frames(spark, sf_dir))
    ranges = points.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(f"mean_{c}") for c in "xyz"], *U.point_ranges())
    out = U.padded_bounds(ranges, 0.1, 0.3, "n", *[f"mean_{c}" for c in "xyz"])
    return rounded(out, *[f"{n}_{c}" for n in ("min", "max") for c in "xyz"])


@query("SELECT c_custkey, (floor(c_custkey * 0.5) % 2 * 0)::BIGINT + c.corner AS corner, round(c_acctbal / 1000 + (1 + c_custkey % 5)::DOUBLE / 2 * c.a, 6) AS x, round((c_custkey % 9) + (2 + c_custkey % 3)::DOUBLE / 2 * c.b, 6) AS z FROM customer, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) c(corner, a, b)")
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-29, SRT-04: corners of objects' boxes from above."""
    k = F.col("c_custkey")
    axes = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    rows = table(spark, sf_dir, "customer").select(k, F.array(F.col("c_acctbal") / 1000, F.lit(0.0), (k % 9).cast("double")).alias("center"), axes.alias("axes"), F.array((1 + k % 5).cast("double"), F.lit(1.0), (2 + k % 3).cast("double")).alias("extents"))
    return rounded(P.footprints(rows, "c_custkey"), "x", "z").withColumn("corner", F.col("corner").cast("long"))


@query("""WITH p AS (SELECT c_custkey AS frame_id, (c_custkey % 11)::DOUBLE AS x, (c_custkey % 13)::DOUBLE AS z FROM customer)
SELECT frame_id, r.ray, round(x + (0.0 + 1.0 * r.side) * r.size, 6) AS end_x, round(z + (1.0 + 0.0 * r.side) * r.size, 6) AS end_z FROM p, (VALUES (0, 0.0, 0.55), (1, 0.25, 0.45), (2, -0.25, 0.45)) r(ray, side, size)""")
def camera_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REN-06: view rays of cameras from above."""
    k = F.col("c_custkey")
    pose = G.make_transform([F.lit(float(i % 4 == 0)) for i in range(9)], ((k % 11).cast("double"), F.lit(0.0), (k % 13).cast("double")))
    rays = P.camera_rays(table(spark, sf_dir, "customer").select(k.alias("frame_id"), pose.alias("T_world_camera")))
    return rounded(rays.select("frame_id", "ray", "end_x", "end_z"), "end_x", "end_z")


@query("""WITH t AS (SELECT l_returnflag, least(greatest((l_extendedprice - 1000) / 90000, 0), 1) AS t FROM lineitem),
c AS (SELECT l_returnflag, printf('#%02x%02x%02x', CAST(round_even(46 + t * 190, 0) AS INTEGER), CAST(round_even(88 + (1.0 - abs(t * 2 - 1)) * 90, 0) AS INTEGER), CAST(round_even(210 - t * 155, 0) AS INTEGER)) AS color FROM t)
SELECT l_returnflag, color, count(*) AS n FROM c GROUP BY 1, 2""")
def depth_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REN-04: values as colours of the depth ramp."""
    color = P.depth_color(F.col("l_extendedprice"), F.lit(1000.0), F.lit(91000.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", color.alias("color")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_type, least(greatest(value / 200, 0), 1) AS t FROM events)
SELECT event_type, printf('#%02x%02x%02x', CAST(round_even(t * 255.0, 0) AS INTEGER), CAST(round_even((1.0 - abs(t * 2 - 1)) * 180.0, 0) AS INTEGER), CAST(round_even((1.0 - t) * 255.0, 0) AS INTEGER)) AS color, count(*) AS n FROM t GROUP BY 1, 2""")
def heat_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REN-10: values as colours of the error ramp."""
    color = P.heat_color(P.heat_ratio(F.col("value"), F.lit(0.0), F.lit(200.0)))
    return table(spark, sf_dir, "events").groupBy("event_type", color.alias("color")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '#f3f4f6' ELSE printf('#%02x%02x%02x', CAST((89 + o_orderkey * 53) % 256 AS INTEGER), CAST((132 + o_orderkey * 97) % 256 AS INTEGER), CAST((63 + o_orderkey * 193) % 256 AS INTEGER)) END AS color FROM orders")
def object_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REN-05: colours of object ids."""
    return table(spark, sf_dir, "orders").select("o_orderkey", P.object_color(F.col("o_orderkey")).alias("color"))


_BOUNDS = "b AS (SELECT min(x) AS a, max(x) AS b, min(z) AS c, max(z) AS d FROM (SELECT s_acctbal / 1000 AS x, (s_nationkey)::DOUBLE AS z FROM supplier UNION ALL SELECT c_acctbal / 2000, (c_nationkey * 2)::DOUBLE FROM customer)), e AS (SELECT a - greatest((b - a) * 0.08, 0.25) AS a, b + greatest((b - a) * 0.08, 0.25) AS b, c - greatest((d - c) * 0.08, 0.25) AS c, d + greatest((d - c) * 0.08, 0.25) AS d FROM b)"


@query(f"WITH {_BOUNDS} SELECT s_suppkey, round(56 + (s_acctbal / 1000 - e.a) / greatest(e.b - e.a, 1e-6) * 528, 4) AS x, round(424 - (s_nationkey - e.c) / greatest(e.d - e.c, 1e-6) * 368, 4) AS y FROM supplier, e")
def plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-30, AGG-19, AGG-20, SET-03: points from above, placed within the bounds of all layers."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("z"))
    b = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 2000).alias("x"), (F.col("c_nationkey") * 2).cast("double").alias("z"))
    rows = a.crossJoin(F.broadcast(P.xz_bounds([a, b])))  # one row of bounds
    x, y = P.plane(F.col("x"), F.col("z"), tuple(F.col(c) for c in ("min_x", "max_x", "min_z", "max_z")))
    return rounded(rows.select("s_suppkey", x.alias("x"), y.alias("y")), "x", "y", digits=4)


@query("""WITH p AS (SELECT l_returnflag AS g, l_extendedprice / 20000 AS t, l_extendedprice * (1 + l_discount) / 20000 AS d, greatest(l_tax, 1e-4) AS s, l_discount * 10 AS c, (l_linestatus = 'F')::INT::DOUBLE AS tc FROM lineitem), e AS (SELECT *, abs(d - t) AS e FROM p),
l AS (SELECT g, count(*) AS n, avg(CASE WHEN e < 1 THEN e * e / 2 ELSE e - 0.5 END) AS a, avg(e / s + ln(s)) AS b, avg((c - tc) * (c - tc)) AS c, avg(e) AS mae, sqrt(avg(e * e)) AS rmse FROM e GROUP BY g),
m AS (SELECT l_returnflag AS g, avg((abs(l_discount - l_tax) + abs(l_quantity / 50 - l_tax) + abs(0.5 - l_discount)) / 3) AS p FROM lineitem GROUP BY 1)
SELECT l.g AS l_returnflag, n, round(a, 6) AS loss_depth, round(b, 4) AS loss_sigma_nll, round(c, 6) AS loss_confidence, round(p, 6) AS loss_pose_center, round(mae, 6) AS depth_mae_m, round(rmse, 6) AS depth_rmse_m, round(p, 6) AS pose_center_mae_m, round(1.0 * a + 0.05 * b + 0.01 * c + 0.1 * p, 4) AS loss_total FROM l JOIN m USING (g)""")
def prediction_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22, DOC-14: supervised losses and errors of predictions."""
    t = table(spark, sf_dir, "lineitem")
    px = t.select("l_returnflag", (F.col("l_extendedprice") / 20000).alias("target"), (F.col("l_extendedprice") * (1 + F.col("l_discount")) / 20000).alias("depth"), F.col("l_tax").alias("sigma"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linestatus") == "F").cast("double").alias("target_confidence"))
    centers = t.select("l_returnflag", F.col("l_discount").alias("x"), (F.col("l_quantity") / 50).alias("y"), F.lit(0.5).alias("z"), F.col("l_tax").alias("tx"), F.col("l_tax").alias("ty"), F.col("l_discount").alias("tz"))
    out = A.prediction_losses(px, ["l_returnflag"], centers)
    return rounded(rounded(out, "loss_depth", "loss_confidence", "loss_pose_center", "depth_mae_m", "depth_rmse_m", "pose_center_mae_m"), "loss_sigma_nll", "loss_total", digits=4)


@query("SELECT l_suppkey % 10 AS source, l_returnflag AS target, count(*) AS match_count, round(min(l_discount), 6) AS min, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_discount, 0.5), 6) AS p50, round(quantile_cont(l_discount, 0.95), 6) AS p95, round(max(l_discount), 6) AS max FROM lineitem GROUP BY 1, 2")
def match_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: dense matches summarised by pair of frames."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("source"), F.col("l_returnflag").alias("target"), "l_discount")
    return rounded(A.match_summary(rows, "source", "target", "l_discount"), "min", "mean", "p50", "p95", "max")


@query("""WITH s AS (SELECT user_id, avg(value / 100 * (value / 100)) AS s2, avg(1 / (1 + value)) AS c FROM events GROUP BY user_id), t AS (SELECT *, greatest(s2 * (1 + greatest(0, 1 - c)), 1e-8) AS t FROM s)
SELECT user_id, round(t, 6) AS translation_variance, round(t * 0.01, 6) AS rotation_variance, round(sqrt(t), 6) AS max_std, round(greatest(s2, 1e-8), 6) AS target_variance FROM t""")
def pose_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-32, GEO-45, AGG-17, AGG-25: covariances of predicted and target poses, and their largest spread."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("sigma"), (1 / (1 + F.col("value"))).alias("confidence"))
    out = A.mean_sigma_covariance(rows, "sigma", "confidence", "user_id").join(A.variance_covariance(rows, "sigma", "user_id").withColumnRenamed("covariance_6x6", "own"), "user_id")
    c = F.col("covariance_6x6")
    return rounded(out.select("user_id", c[0].alias("translation_variance"), c[21].alias("rotation_variance"), A.pose_uncertainty("covariance_6x6").alias("max_std"), F.col("own")[35].alias("target_variance")), "translation_variance", "rotation_variance", "max_std", "target_variance")


@query("SELECT user_id, event_id, round(min(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS best FROM events")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: the lowest error of each run so far."""
    return rounded(A.running_best(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "best"), "best")


@query("""WITH p AS (SELECT s_suppkey, 30.0 + s_suppkey % 3 AS f, (1 + s_nationkey % 4)::DOUBLE AS sx, (2 + s_nationkey % 3)::DOUBLE AS sy FROM supplier)
SELECT s_suppkey, round(f * sx, 6) AS fx, round(15.5 * sx, 6) AS cx, round(f * sy, 6) AS fy, round(11.5 * sy, 6) AS cy, 1.0::DOUBLE AS k22, round(f * sx * 0.5 / 2.0 + 15.5 * sx, 6) AS u FROM p""")
def scaled_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-01, GEO-04: intrinsics of resized images, and a point projected by them."""
    k = F.col("s_suppkey")
    zero, one, f = F.lit(0.0), F.lit(1.0), F.lit(30.0) + k % 3
    own = G.scale_intrinsics((f, zero, F.lit(15.5), zero, f, F.lit(11.5), zero, zero, one), (1 + F.col("s_nationkey") % 4).cast("double"), (2 + F.col("s_nationkey") % 3).cast("double"))
    u, _ = G.project_points((F.lit(0.5), F.lit(0.0), F.lit(2.0)), own)
    return rounded(table(spark, sf_dir, "supplier").select(k, own[0].alias("fx"), own[2].alias("cx"), own[4].alias("fy"), own[5].alias("cy"), own[8].alias("k22"), u.alias("u")), "fx", "cx", "fy", "cy", "u")


_BOXES = ", ".join(f"({o}, {', '.join(map(str, (*b[0], *b[1])))})" for o, b in enumerate((S.ROOM.room, S.ROOM.box)))


@query(f"""WITH b(object_id, x0, y0, z0, x1, y1, z1) AS (VALUES {_BOXES}), v AS (SELECT CAST(object_id * 8 + range AS INTEGER) AS vertex_id, CASE WHEN range % 2 = 1 THEN x1 ELSE x0 END AS x, CASE WHEN range // 2 % 2 = 1 THEN y1 ELSE y0 END AS y, CASE WHEN range // 4 = 1 THEN z1 ELSE z0 END AS z FROM b, range(8))
SELECT s_suppkey, vertex_id, CAST(x + s_suppkey AS DOUBLE) AS x, y::DOUBLE AS y, z::DOUBLE AS z, CAST((CASE vertex_id % 8 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE 6 END) AS BIGINT) AS n_faces FROM v, supplier""")
def scene_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO-26, GEO-27, SET-03: the mesh of room and box for each supplier, with the faces at each vertex."""
    vertices, faces = S.scene_mesh(spark)
    ends = faces.select(F.explode(F.array("a", "b", "c")).alias("vertex_id")).groupBy("vertex_id").agg(F.count("*").alias("n_faces"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(vertices.join(ends, "vertex_id")))  # 16 vertices
    return rows.select("s_suppkey", "vertex_id", (F.col("x") + F.col("s_suppkey")).alias("x"), "y", "z", "n_faces")
