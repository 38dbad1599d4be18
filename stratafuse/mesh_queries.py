"""Registered queries over meshes, surface distances and trajectories, each with the SQL that it equals."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators import detections as X
from stratafuse.operators import distances as D
from stratafuse.operators import fusion as U
from stratafuse.operators import losses as L
from stratafuse.operators import meshing as H
from stratafuse.operators import sampling as N
from stratafuse.operators import scenes as S
from stratafuse.operators import trajectories as T
from stratafuse.queries import _F, _POINTS, _V, frames, volume
from stratafuse.registry import query, rounded, table
from stratafuse.session import stored


# ---------------------------------------------------------------- meshes


@cache
def _mesh_sql() -> str:
    """CTEs from the volume to corner(gx, gy, gz, n, k, id, x, y, z): cells by a self-join, their case's triangles, and the
    corners of these."""
    cases = ", ".join(f"({mask}, {n}, {e}, {f}, {g})" for mask, rows in enumerate(H.case_table()) for n, (e, f, g) in enumerate(rows))
    edges = ", ".join(f"({e}, {c & 1}, {c >> 1 & 1}, {c >> 2 & 1}, {axis})" for e, (c, axis) in enumerate(H.EDGES))
    place = lambda x, axis, low: f"CASE WHEN axis = {axis} THEN {low!r}::DOUBLE + (v{x} + 0.5::DOUBLE) * 0.1::DOUBLE + p.tsdf / (p.tsdf - q.tsdf) * 0.1::DOUBLE ELSE {low!r}::DOUBLE + (v{x} + 0.5::DOUBLE) * 0.1::DOUBLE END AS {x}"
    side = 2 * H.REACH
    return f"""{_V}, cases AS (SELECT * FROM (VALUES {cases}) t(mask, n, e0, e1, e2)), edges AS (SELECT * FROM (VALUES {edges}) t(e, dx, dy, dz, axis)),
own AS (SELECT ix, iy, iz, tsdf FROM vol WHERE weight > 0),
cell AS (SELECT ix - (r.range & 1) AS gx, iy - ((r.range >> 1) & 1) AS gy, iz - ((r.range >> 2) & 1) AS gz, CAST(sum(CASE WHEN tsdf < 0 THEN 1 << r.range ELSE 0 END) AS BIGINT) AS mask FROM own, range(8) r GROUP BY 1, 2, 3 HAVING count(*) = 8),
tri AS (SELECT gx, gy, gz, n, e0, e1, e2 FROM cell JOIN cases USING (mask)),
side AS (SELECT gx, gy, gz, n, 0 AS k, e0 AS e FROM tri UNION ALL SELECT gx, gy, gz, n, 1, e1 FROM tri UNION ALL SELECT gx, gy, gz, n, 2, e2 FROM tri),
spot AS (SELECT s.*, gx + dx AS vx, gy + dy AS vy, gz + dz AS vz, axis FROM side s JOIN edges USING (e)),
corner AS (SELECT gx, gy, gz, n, k, (((vx + {H.REACH}) * {side} + (vy + {H.REACH})) * {side} + (vz + {H.REACH})) * 4 + axis AS id, {place("x", 0, -1.5)}, {place("y", 1, -1.0)}, {place("z", 2, 0.0)}
  FROM spot JOIN own p ON p.ix = vx AND p.iy = vy AND p.iz = vz JOIN own q ON q.ix = vx + (axis = 0)::INT AND q.iy = vy + (axis = 1)::INT AND q.iz = vz + (axis = 2)::INT),
face AS (SELECT gx, gy, gz, n, {", ".join(f"max({v}) FILTER (k = {i}) AS {c}{s}" for i, c in enumerate("abc") for s, v in (("", "id"), ("_x", "x"), ("_y", "y"), ("_z", "z")))} FROM corner GROUP BY gx, gy, gz, n)"""


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.marching_cubes(volume(spark, sf_dir))


@query(f"WITH {_mesh_sql()} SELECT CAST(gx AS INTEGER) AS ix, CAST(gy AS INTEGER) AS iy, CAST(gz AS INTEGER) AS iz, n, a, b, c, {', '.join(f'round({c}_{x}, 6) AS "{c}{x}"' for c in 'abc' for x in 'xyz')} FROM face")
def mesh_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11: marching cubes over the fused volume, vertices welded by the grid edge that they lie on."""
    return rounded(mesh(spark, sf_dir), *[c + x for c in "abc" for x in "xyz"])


_EDGES = "rims AS (SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS k FROM (SELECT a AS u, b AS v FROM face UNION ALL SELECT b, c FROM face UNION ALL SELECT c, a FROM face) GROUP BY 1, 2)"
_CROSS = lambda p, q, r: f"sqrt(pow(({q}_y - {p}_y) * ({r}_z - {p}_z) - ({q}_z - {p}_z) * ({r}_y - {p}_y), 2) + pow(({q}_z - {p}_z) * ({r}_x - {p}_x) - ({q}_x - {p}_x) * ({r}_z - {p}_z), 2) + pow(({q}_x - {p}_x) * ({r}_y - {p}_y) - ({q}_y - {p}_y) * ({r}_x - {p}_x), 2)) / 2"


@query(f"""WITH {_mesh_sql()}, {_EDGES}, points AS (SELECT count(DISTINCT id) AS n FROM corner)
SELECT (SELECT count(*) FROM face) AS n_faces, (SELECT n FROM points) AS n_vertices, (SELECT count(*) FROM rims) AS n_edges, (SELECT count(*) FROM rims WHERE k = 1) AS boundary_edges, (SELECT count(*) FROM rims WHERE k > 2) AS crowded_edges,
(SELECT n FROM points) - (SELECT count(*) FROM rims) + (SELECT count(*) FROM face) AS euler, (SELECT round(sum({_CROSS("a", "b", "c")}), 4) FROM face) AS area""")
def mesh_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11: faces, vertices, edges and holes of the fused volume's mesh."""
    faces = stored(mesh(spark, sf_dir))
    return rounded(H.mesh_report(faces).drop("volume"), "area", digits=4)


def _level_sql(size: float) -> str:
    return f"""(SELECT {size!r}::DOUBLE AS size, (SELECT count(DISTINCT (a, b, c)) FROM (SELECT list_sort([i, j, k])[1] AS a, list_sort([i, j, k])[2] AS b, list_sort([i, j, k])[3] AS c FROM
(SELECT p.g AS i, q.g AS j, r.g AS k FROM face f JOIN named p ON p.size = {size!r} AND p.id = f.a JOIN named q ON q.size = {size!r} AND q.id = f.b JOIN named r ON r.size = {size!r} AND r.id = f.c) WHERE i <> j AND j <> k AND i <> k)) AS n_faces, count(*) AS n_vertices, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z FROM cubes WHERE size = {size!r})"""


@query(f"""WITH {_mesh_sql()}, spots AS (SELECT id, min(x) AS x, min(y) AS y, min(z) AS z FROM corner GROUP BY id),
leveled AS (SELECT s.size, spots.*, floor(x / s.size) AS kx, floor(y / s.size) AS ky, floor(z / s.size) AS kz FROM spots, (VALUES (0.2::DOUBLE), (0.4::DOUBLE)) s(size)),
cubes AS (SELECT size, kx, ky, kz, min(id) AS g, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM leveled GROUP BY 1, 2, 3, 4), named AS (SELECT leveled.size, leveled.id, cubes.g FROM leveled JOIN cubes USING (size, kx, ky, kz))
SELECT * FROM {_level_sql(0.2)} UNION ALL SELECT * FROM {_level_sql(0.4)}""")
def mesh_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11: coarser levels of the mesh by clusters of vertices."""
    faces = stored(mesh(spark, sf_dir))
    vertices = stored(H.mesh_vertices(faces))
    out = None
    for size in (0.2, 0.4):
        f, v = H.clustered(faces, vertices, size)
        row = f.agg(F.count("*").alias("n_faces")).crossJoin(v.agg(F.count("*").alias("n_vertices"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in "xyz"]))  # one row each
        row = row.select(F.lit(size).alias("size"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {_mesh_sql()}, {_EDGES}, points AS (SELECT count(DISTINCT id) AS n FROM corner)
SELECT (SELECT count(*) FROM rims WHERE k = 1) AS boundary_edges, (SELECT count(*) FROM rims WHERE k > 2) AS crowded_edges, (SELECT n FROM points) - (SELECT count(*) FROM rims) + (SELECT count(*) FROM face) AS euler, (SELECT round(sum({_CROSS("a", "b", "c")}), 3) FROM face) AS area, true AS fewer""")
def mesh_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-11: what collapsing edges of almost no error must keep (border, topology, area of flat parts), and that it saves faces."""
    faces = stored(mesh(spark, sf_dir))
    f, v = H.decimate(faces, H.mesh_vertices(faces), 1e-9, rounds=2)
    out = H.mesh_report(stored(H.with_positions(f, v)))
    n = faces.count()
    return rounded(out.select("boundary_edges", "crowded_edges", "euler", "area", (F.col("n_faces") < n).alias("fewer")), "area", digits=3)


_PARTS = """ties AS (SELECT a AS u, b AS v FROM face UNION SELECT b, a FROM face UNION SELECT a, c FROM face UNION SELECT c, a FROM face),
lab(u, c) USING KEY (u) AS (SELECT DISTINCT u, u FROM ties UNION SELECT ties.u, min(lab.c) FROM lab JOIN ties ON ties.v = lab.u JOIN recurring.lab AS own_lab ON own_lab.u = ties.u WHERE lab.c < own_lab.c GROUP BY ties.u)"""


@query(f"""WITH RECURSIVE {_mesh_sql()}, {_PARTS},
seen AS (SELECT lab.c AS component, ((a_x + b_x + c_x) / 3 BETWEEN -0.4 AND 0.4 AND (a_y + b_y + c_y) / 3 BETWEEN -0.3 AND 0.5 AND (a_z + b_z + c_z) / 3 BETWEEN 1.8 AND 2.6)::INT AS obj FROM face JOIN lab ON lab.u = face.a),
votes AS (SELECT component, obj, count(*) AS k FROM seen GROUP BY 1, 2)
SELECT component, CAST(sum(k) AS BIGINT) AS n_faces, CAST(list(obj ORDER BY k DESC, obj)[1] AS INTEGER) AS object_id, sum(k) < 4 AS stray FROM votes GROUP BY component""")
def mesh_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-12: the mesh split into parts that hang together, with the object of each by vote."""
    faces = mesh(spark, sf_dir)
    middle = {x: (F.col(f"a{x}") + F.col(f"b{x}") + F.col(f"c{x}")) / 3 for x in "xyz"}
    low, high = ([v + s for v in b] for s, b in ((-0.05, S.ROOM.box[0]), (0.05, S.ROOM.box[1])))
    inside = middle["x"].between(low[0], high[0]) & middle["y"].between(low[1], high[1]) & middle["z"].between(low[2], high[2])
    faces = stored(faces.select(F.struct("ix", "iy", "iz", "n").alias("face_id"), *"abc", inside.cast("int").alias("object_id")))
    parts = H.split_objects(faces, 4)
    return parts.groupBy("component").agg(F.first("n_faces").alias("n_faces"), F.first("object_id").alias("object_id"), F.first("stray").alias("stray"))


# ---------------------------------------------------------------- distances

_THRESHOLDS = (0.05, 0.1, 0.2)
_pair = "(f.x - t.x) * (f.x - t.x) + (f.y - t.y) * (f.y - t.y) + (f.z - t.z) * (f.z - t.z)"


@query(f"""WITH {_V}{_POINTS[len(_F) :]}, fd AS (SELECT x, y, z FROM sf), tr AS (SELECT DISTINCT x, y, z FROM pt),
there AS (SELECT sqrt(min({_pair})) AS d FROM fd f, tr t GROUP BY f.x, f.y, f.z), back AS (SELECT sqrt(min({_pair})) AS d, t.x, t.y, t.z FROM tr t, fd f GROUP BY t.x, t.y, t.z),
every AS (SELECT back.d FROM pt JOIN back USING (x, y, z)),
rows_ AS (SELECT th.v AS threshold_m, (SELECT count(*) FROM there) AS n_found, (SELECT count(*) FROM every) AS n_truth, (SELECT avg(d) FROM there) AS a, (SELECT avg(d) FROM every) AS b, (SELECT avg((d <= th.v)::INT) FROM there) AS p, (SELECT avg((d <= th.v)::INT) FROM every) AS q FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) th(v))
SELECT threshold_m, n_found, n_truth, round(a, 6) AS accuracy_m, round(b, 6) AS completeness_m, round((a + b) / 2, 6) AS chamfer_m, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f_score FROM rows_""")
def surface_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-04: Chamfer distance, precision, recall and F-score of the fused surface against all depth points."""
    n = table(spark, sf_dir, "supplier").count()
    out = D.surface_metrics(U.extract_surface(volume(spark, sf_dir), n), S.world_points(S.render_pixels(frames(spark, sf_dir))), _THRESHOLDS, 0.1)
    return rounded(out, "accuracy_m", "completeness_m", "chamfer_m", "precision", "recall", "f_score")


# ---------------------------------------------------------------- trajectories


@query("""WITH p AS (SELECT c_nationkey % 5 AS k, 1 + 0.1::DOUBLE * (c_nationkey % 5) AS s, 0.1::DOUBLE * (c_nationkey % 5) AS a FROM customer)
SELECT k AS track, count(*) AS n_poses, round(max(s), 6) AS scale, round(max(cos(a)), 6) AS r0, round(max(-sin(a)), 6) AS r1, 0.0::DOUBLE AS r2, round(max(sin(a)), 6) AS r3, round(max(cos(a)), 6) AS r4, 0.0::DOUBLE AS r5, 0.0::DOUBLE AS r6, 0.0::DOUBLE AS r7, 1.0::DOUBLE AS r8,
k::DOUBLE AS tx, 0.0::DOUBLE - k AS ty, 2.0::DOUBLE AS tz, CAST(3 AS INTEGER) AS rank, 0.0::DOUBLE AS rmse_m, 0.0::DOUBLE AS mean_m, 0.0::DOUBLE AS max_m FROM p GROUP BY k""")
def aligned_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-03: a track for every fifth nation together, whose estimate is turned, scaled and shifted; alignment gives all three back."""
    c = table(spark, sf_dir, "customer")
    k, i = F.col("c_nationkey") % 5, F.col("c_custkey")
    p = {"x": F.lit(0.1) * (i * 37 % 97), "y": F.lit(0.07) * (i * 53 % 89), "z": F.lit(0.05) * (i * 71 % 83)}
    s, a = F.lit(1.0) + F.lit(0.1) * (k % 5), F.lit(0.1) * k
    off = {"x": p["x"] - k, "y": p["y"] + k, "z": p["z"] - 2}
    e = {"x": (F.cos(a) * off["x"] + F.sin(a) * off["y"]) / s, "y": (F.cos(a) * off["y"] - F.sin(a) * off["x"]) / s, "z": off["z"] / s}
    poses = c.select(k.alias("track"), *[x.alias(f"e{n}") for n, x in e.items()], *[x.alias(f"p{n}") for n, x in p.items()])
    out = T.aligned_errors(poses)
    return out.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in out.columns if n not in ("track", "n_poses", "rank")})


@query("""WITH RECURSIVE p AS (SELECT c_nationkey AS track, c_custkey AS n, 0.01::DOUBLE * c_custkey + 0.05::DOUBLE * ((c_custkey * 7) % 11) AS x, 0.03::DOUBLE * (c_custkey % 13) AS y, 0.01::DOUBLE * (c_custkey % 40) AS h FROM customer),
k(track, n) AS (SELECT track, min(n) FROM p GROUP BY track UNION ALL
  SELECT track, n FROM (SELECT k.track, min(q.n) AS n FROM k JOIN p c ON c.track = k.track AND c.n = k.n JOIN p q ON q.track = k.track AND q.n > k.n
    AND (sqrt((q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y)) >= 0.73 OR abs(cos(q.h - c.h)) <= cos(0.155::DOUBLE) OR q.n - k.n >= 60) GROUP BY k.track) WHERE n IS NOT NULL)
SELECT track, CAST(n AS BIGINT) AS frame_id FROM k""")
def keyframe_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-08: keyframes of a track a nation by distance, angle and gap."""
    i = F.col("c_custkey")
    h = F.lit(0.01) * (i % 40)
    poses = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("track"), i.alias("frame_id"), (F.lit(0.01) * i + F.lit(0.05) * ((i * 7) % 11)).alias("x"), (F.lit(0.03) * (i % 13)).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("qx"), F.sin(h).alias("qy"), F.lit(0.0).alias("qz"), F.cos(h).alias("qw"))
    return T.keyframes(poses, 0.73, 0.31, 60)


# ---------------------------------------------------------------- objects


@query("""WITH g AS (SELECT (l_orderkey * 8 + l_linenumber) * 2 + (l_linestatus = 'F')::INT AS id, l_linestatus AS label, l_orderkey AS o, 0.05::DOUBLE * min(l_partkey % 9) AS d, (max(l_quantity)::DOUBLE - 1) / 50.0::DOUBLE AS confidence FROM lineitem GROUP BY l_orderkey, l_linenumber, l_linestatus),
p AS (SELECT g.id, o, confidence FROM g JOIN orders ON o_orderkey = o AND o_orderstatus = g.label WHERE (1 - d) / (1 + d) >= 0.5), m AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY o ORDER BY confidence DESC, id) AS r FROM p) WHERE r = 1),
l AS (SELECT label, confidence, count(m.id) AS tp, count(*) AS n FROM g LEFT JOIN m USING (id) GROUP BY 1, 2), s AS (SELECT *, sum(tp) OVER w AS stp, sum(n) OVER w AS sn FROM l WINDOW w AS (PARTITION BY label ORDER BY confidence DESC)),
t AS (SELECT label, tp, n, max(stp / sn::DOUBLE) OVER (PARTITION BY label ORDER BY confidence DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top FROM s), a AS (SELECT label, sum(tp * top) AS area, sum(tp) AS n_found, sum(n) AS n_guess FROM t GROUP BY label)
SELECT o_orderstatus AS label, count(*) AS n_truth, CAST(coalesce(max(n_guess), 0) AS BIGINT) AS n_guess, CAST(coalesce(max(n_found), 0) AS BIGINT) AS n_found, round(coalesce(max(area), 0) / count(*), 6) AS ap FROM orders LEFT JOIN a ON a.label = o_orderstatus GROUP BY 1""")
def detection_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-07: boxes of orders against those of their lines: overlaps, matches by confidence, average precision."""
    o, i = F.col("o_orderkey"), F.col("l_orderkey")
    one, zero = F.lit(1.0), F.lit(0.0)
    box = lambda key, shift, yaw: [(F.lit(10.0) * (key % 64) + shift).alias("x"), zero.alias("y"), zero.alias("z"), one.alias("sx"), one.alias("sy"), one.alias("sz"), yaw.alias("yaw")]
    truths = table(spark, sf_dir, "orders").select(o.alias("id"), F.expr("o_orderkey div 64").alias("frame_id"), F.col("o_orderstatus").alias("label"), *box(o, zero, F.lit(3.141592653589793) * (o % 2)))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_linestatus").agg(F.min(F.col("l_partkey") % 9).alias("d"), F.max("l_quantity").alias("q"))
    confidence = (F.col("q").cast("double") - 1) / 50.0
    guesses = lines.select(((i * 8 + F.col("l_linenumber")) * 2 + (F.col("l_linestatus") == "F").cast("int")).alias("id"), F.expr("l_orderkey div 64").alias("frame_id"), F.col("l_linestatus").alias("label"), confidence.alias("confidence"), *box(i, F.lit(0.05) * F.col("d"), zero))
    found = X.matches(X.pairs_3d(truths, guesses, 5.0), guesses, 0.5)
    return rounded(X.average_precision(guesses, truths, found), "ap")


@query("""WITH s AS (SELECT o_custkey AS truth, o_orderkey AS f, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS g FROM orders),
w AS (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY truth ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(g IS NOT NULL) OVER (PARTITION BY truth ORDER BY f) AS before FROM s)
SELECT truth, count(*) AS n_frames, count(g) AS n_matched, count(*) FILTER (g <> last) AS id_switches, count(*) FILTER (g IS NOT NULL AND last IS NOT NULL AND NOT before) AS fragments FROM w GROUP BY truth""")
def track_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-07: switches and breaks of tracks."""
    o = F.col("o_orderkey")
    return X.track_breaks(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("truth"), o.alias("frame_id"), F.when(o % 4 > 0, o % 3).alias("guess")))


# ---------------------------------------------------------------- training samples

_STAGES = [(0, {"A": 3.0, "N": 1.0}), (40, {"A": 1.0, "N": 1.0, "R": 2.0})]


@query("""WITH f AS (SELECT DISTINCT o_orderkey // 400 AS sequence, o_orderkey AS n FROM orders WHERE o_orderkey % 37 <> 5 AND o_totalprice > 60000), s AS (SELECT sequence, n AS start FROM f WHERE n % 2 = 0),
c AS (SELECT s.sequence, s.start, list(f.n ORDER BY f.n) AS frame_ids FROM s JOIN f ON f.sequence = s.sequence AND f.n BETWEEN s.start AND s.start + 6 AND (f.n - s.start) % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 4),
g AS (SELECT c.sequence, c.start, f.n, lead(f.n) OVER (PARTITION BY c.sequence, c.start ORDER BY f.n) - f.n AS d FROM c JOIN f ON f.sequence = c.sequence AND f.n BETWEEN c.start AND c.start + 6)
SELECT c.sequence, c.start, array_to_string(frame_ids, ',') AS frames FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sequence = c.sequence AND g.start = c.start AND d > 1)""")
def training_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-15: strided clips that don't cross gaps."""
    o = F.col("o_orderkey")
    frames_ = table(spark, sf_dir, "orders").where((o % 37 != 5) & (F.col("o_totalprice") > 60000)).select(F.expr("o_orderkey div 400").alias("sequence"), o.alias("frame_id"))
    return N.strided_clips(frames_, 4, 2, 2).select("sequence", "start", F.array_join("frame_ids", ",").alias("frames"))


@query("""WITH i AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT l_returnflag AS source, l_orderkey AS id FROM lineitem)),
s AS (SELECT range // 64 AS step, range % 64 AS slot FROM range(6400)),
h AS (SELECT *, CAST('0x' || substr(md5('7:' || step || ':' || slot), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u, CAST('0x' || substr(md5('7:item:' || step || ':' || slot), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS v, least(step / 40.0::DOUBLE, 1) AS t FROM s),
w AS (SELECT *, 0.75::DOUBLE - 0.5::DOUBLE * t AS a, 0.75::DOUBLE - 0.5::DOUBLE * t + 0.25::DOUBLE AS b FROM h), p AS (SELECT *, CASE WHEN u < a THEN 'A' WHEN u < b THEN 'N' ELSE 'R' END AS source FROM w)
SELECT step, slot, p.source, i.id AS item FROM p JOIN i ON i.source = p.source AND i.r = CAST(floor(v * n) AS BIGINT)""")
def mixed_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-18: sources mixed by weights that change over the steps."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("id"))
    return N.training_schedule(items, _STAGES, 100, 64, 7)


# ---------------------------------------------------------------- losses


@query("""WITH p AS (SELECT l_returnflag AS g, l_extendedprice / 20000.0::DOUBLE AS t, l_extendedprice * (1 + l_discount) / 20000.0::DOUBLE AS p FROM lineitem), e AS (SELECT g, ln(p) - ln(t) AS e, 1.0::DOUBLE / p AS i, 1.0::DOUBLE / t AS j FROM p WHERE p > 0 AND t > 0),
m AS (SELECT g, count(*) AS n, avg(e * e) - 0.85::DOUBLE * avg(e) * avg(e) AS s, covar_pop(i, j) / var_pop(i) AS a, avg(i) AS mi, avg(j) AS mj FROM e GROUP BY g), l AS (SELECT e.g, avg(sqrt(pow(a * i + (mj - a * mi) - j, 2) + 1e-6)) AS loss FROM e JOIN m USING (g) GROUP BY e.g)
SELECT m.g AS l_returnflag, n, round(s, 6) AS silog, round(a, 5) AS a, round(mj - a * mi, 5) AS b, round(loss, 6) AS loss FROM m JOIN l ON l.g = m.g""")
def depth_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-14: scale-aware log error, and inverse depth after scale and shift."""
    px = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 20000.0).alias("t"), (F.col("l_extendedprice") * (1 + F.col("l_discount")) / 20000.0).alias("p"))
    logs = L.silog(px, "p", "t", ["l_returnflag"])
    line = L.aligned_inverse_depth(px, "p", "t", "l_returnflag").drop("n")
    return rounded(rounded(logs.join(line, "l_returnflag"), "silog", "loss"), "a", "b", digits=5)


@query("""WITH c AS (SELECT c_nationkey AS g, c_custkey % 40 AS u, c_custkey % 30 AS v, 1.0::DOUBLE + (c_custkey % 7) * 0.5::DOUBLE AS z, 0.05::DOUBLE * (c_custkey % 3) AS off, 0.1::DOUBLE * (c_nationkey % 4) AS h, 0.2::DOUBLE + 0.01::DOUBLE * c_nationkey AS tx FROM customer),
p AS (SELECT *, (u - 19.5::DOUBLE) / 30.0::DOUBLE * z AS x, (v - 14.5::DOUBLE) / 30.0::DOUBLE * z AS y FROM c), q AS (SELECT *, cos(h) * x + sin(h) * z + tx AS qx, y AS qy, cos(h) * z - sin(h) * x AS qz FROM p),
j AS (SELECT *, 30.0::DOUBLE * qx / qz + 19.5::DOUBLE AS uj, 30.0::DOUBLE * qy / qz + 14.5::DOUBLE + off AS vj FROM q WHERE qz > 0.1),
n AS (SELECT *, (u - 19.5::DOUBLE) / 30.0::DOUBLE AS a, (v - 14.5::DOUBLE) / 30.0::DOUBLE AS b, (uj - 19.5::DOUBLE) / 30.0::DOUBLE AS c, (vj - 14.5::DOUBLE) / 30.0::DOUBLE AS d FROM j),
e AS (SELECT *, 0.0::DOUBLE AS l0, -tx * (cos(h) - sin(h) * a) AS l1, tx * b AS l2, tx * sin(h) * d AS k0, tx AS k1 FROM n)
SELECT g AS c_nationkey, count(*) AS n, round(avg(abs(d * l1 + l2)), 6) AS epipolar, round(avg(pow(d * l1 + l2, 2) / (pow(l1 / 30.0::DOUBLE, 2) + pow(k0 / 30.0::DOUBLE, 2) + pow(k1 / 30.0::DOUBLE, 2))), 5) AS sampson FROM e GROUP BY g""")
def epipolar_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-14: epipolar distances of matches between two cameras a nation, some a little off."""
    i, k = F.col("c_custkey"), F.col("c_nationkey")
    h, tx = F.lit(0.1) * (k % 4), F.lit(0.2) + F.lit(0.01) * k
    u, v, z = (i % 40).cast("double"), (i % 30).cast("double"), F.lit(1.0) + (i % 7) * F.lit(0.5)
    camera = tuple(F.lit(x) for x in (30.0, 0.0, 19.5, 0.0, 30.0, 14.5, 0.0, 0.0, 1.0))
    rows = table(spark, sf_dir, "customer").select(k, u.alias("u"), v.alias("v"), z.alias("z"), (F.lit(0.05) * (i % 3)).alias("off"), h.alias("h"), tx.alias("tx"))
    p = G.unproject_pixels(F.col("u"), F.col("v"), F.col("z"), camera)
    h, tx = F.col("h"), F.col("tx")
    r = (F.cos(h), F.lit(0.0), F.sin(h), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(h), F.lit(0.0), F.cos(h))
    q = G.transform_points(r, (tx, F.lit(0.0), F.lit(0.0)), p)
    rows = rows.withColumns({f"q{c}": x for c, x in zip("xyz", q, strict=True)}).where("qz > 0.1")
    uj, vj = (F.lit(30.0) * F.col(f"q{c}") / F.nullif(F.col("qz"), F.lit(0.0)) + F.lit(m) for c, m in (("x", 19.5), ("y", 14.5)))
    value, sampson = L.epipolar_errors(L.fundamental(r, (tx, F.lit(0.0), F.lit(0.0)), camera, camera), F.col("u"), F.col("v"), uj, vj + F.col("off"))
    out = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg(value).alias("epipolar"), F.avg(sampson).alias("sampson"))
    return rounded(rounded(out, "epipolar"), "sampson", digits=5)
