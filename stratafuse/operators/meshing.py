"""Triangle meshes from signed distance volumes: marching cubes, topology, levels of detail, decimation, splitting.

A mesh is two tables: faces (a, b, c: vertex ids, anticlockwise from outside) and vertices (vertex_id, x, y, z).
Vertices of marching cubes are named by the grid edge that they lie on, so that cells and blocks agree on them without talking
to each other. What is done to a mesh is a fixed number of joins and aggregates a round; nothing is gathered but the voxels of
a block, whose number is fixed.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafuse.functions import geometry as G
from stratafuse.operators.fusion import GRID, Grid
from stratafuse.operators.graphs import connected_components
from stratafuse.session import discard, stored

#: Edges of a cell: (lower corner, axis). Corner c is the voxel at (c & 1, c >> 1 & 1, c >> 2 & 1).
EDGES = [(c, axis) for axis in range(3) for c in range(8) if not c >> axis & 1]
#: Cells of a block's side.
BLOCK = 32
#: Voxel indices lie in +-2^18; a vertex id holds its edge's voxel and axis.
REACH = 1 << 18
FACES = "ix int, iy int, iz int, n int, a long, b long, c long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


# ---------------------------------------------------------------- marching cubes


def _rings() -> list[list[int]]:
    """Corners of the six sides of a cell, anticlockwise as seen from outside."""
    out = []
    for axis in range(3):
        p, q = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        out += [[c | side << axis for c in ([0, p, p | q, q] if side else [q, p | q, p, 0])] for side in (0, 1)]
    return out


def _edge(c: int, d: int) -> int:
    return EDGES.index((min(c, d), (c ^ d).bit_length() - 1))


def _outlines(mask: int) -> list[list[int]]:
    """Closed runs of cut edges around the corners inside (bits of the mask). On a side, each run of inside corners is
    cut off by a line of its own: cells that share the side draw the same lines, so meshes have no cracks."""
    follows = {}
    for ring in _rings():
        inside = [mask >> c & 1 for c in ring]
        for i in range(4):
            if inside[i] and not inside[i - 1]:
                j = i
                while inside[(j + 1) % 4]:
                    j += 1
                follows[_edge(ring[i - 1], ring[i])] = _edge(ring[j % 4], ring[(j + 1) % 4])
    out = []
    while follows:
        e, line = min(follows), []
        while e in follows:
            line.append(e)
            e = follows.pop(e)
        out.append(line)
    return out


@cache
def case_table() -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """Triangles (of edge numbers) of each of the 256 masks. Outlines are cut into triangles without a diagonal inside a side,
    which a neighbour could draw too."""
    sides = [{_edge(r[i], r[(i + 1) % 4]) for i in range(4)} for r in _rings()]

    def filled(line: list[int]) -> tuple[tuple[int, int, int], ...]:
        @cache
        def best(i: int, j: int) -> tuple[int, tuple]:
            if j - i < 2:
                return 0, ()
            ways = []
            for k in range(i + 1, j):
                flat = sum(q - p > 1 and any({line[p], line[q]} <= s for s in sides) for p, q in ((i, k), (k, j)))
                (m, left), (n, right) = best(i, k), best(k, j)
                ways.append((m + n + flat, (*left, *right, (line[i], line[k], line[j]))))
            return min(ways)

        return best(0, len(line) - 1)[1]

    return tuple(tuple(t for line in _outlines(mask) for t in filled(line)) for mask in range(256))


@cache
def _arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of triangles and first row of each case, and all rows."""
    table = case_table()
    count = np.array([len(t) for t in table])
    return count, np.cumsum(count) - count, np.array([t for case in table for t in case], np.int64).reshape(-1, 3)


def vertex_id(ix, iy, iz, axis):
    """The id of the edge from voxel (ix, iy, iz) along an axis; arrays, numbers or columns."""
    side = 2 * REACH
    return (((ix + REACH) * side + (iy + REACH)) * side + (iz + REACH)) * 4 + axis


def _block_faces(low: tuple[float, ...], voxel: float):
    """The faces of one block from its voxels, those of the next blocks' first layers included."""

    def run(key: tuple, voxels: pa.Table) -> pa.Table:
        corner = np.array([k.as_py() for k in key], np.int64) * BLOCK
        at = np.stack([np.asarray(voxels.column(n)).astype(np.int64) for n in ("ix", "iy", "iz")]) - corner[:, None]
        v = np.full((BLOCK + 1,) * 3, np.nan)
        v[at[0], at[1], at[2]] = np.asarray(voxels.column("tsdf"))
        part = lambda c: v[tuple(slice(c >> k & 1, BLOCK + (c >> k & 1)) for k in range(3))]
        mask = sum((part(c) < 0).astype(np.int64) << c for c in range(8))
        whole = np.logical_and.reduce([~np.isnan(part(c)) for c in range(8)])
        count, first, rows = _arrays()
        cells = np.argwhere(whole & (count[mask] > 0))
        case = mask[cells[:, 0], cells[:, 1], cells[:, 2]]
        n = np.arange(count[case].sum()) - np.repeat(np.cumsum(count[case]) - count[case], count[case])
        cell = np.repeat(cells, count[case], axis=0)
        edges = rows[np.repeat(first[case], count[case]) + n]
        out = {name: pa.array(cell[:, k] + corner[k], pa.int32()) for k, name in enumerate(("ix", "iy", "iz"))} | {"n": pa.array(n, pa.int32())}
        start, axis = np.array([c for c, _ in EDGES]), np.array([x for _, x in EDGES])
        positions = {}
        for k, name in enumerate("abc"):
            c, along = start[edges[:, k]], axis[edges[:, k]]
            p = cell + np.stack([c & 1, c >> 1 & 1, c >> 2 & 1], 1)
            q = p.copy()
            q[np.arange(len(q)), along] += 1
            v0, v1 = v[p[:, 0], p[:, 1], p[:, 2]], v[q[:, 0], q[:, 1], q[:, 2]]
            share = v0 / (v0 - v1)
            g = p + corner
            out[name] = pa.array(vertex_id(g[:, 0], g[:, 1], g[:, 2], along), pa.int64())
            for d, x in enumerate("xyz"):
                base = low[d] + (g[:, d] + 0.5) * voxel
                positions[name + x] = pa.array(np.where(along == d, base + share * voxel, base), pa.float64())
        return pa.table(out | positions)

    return run


def marching_cubes(volume: DataFrame, grid: Grid = GRID) -> DataFrame:
    """The faces (with cell, number in it, vertex ids and positions) of the zero level of a volume (ix, iy, iz, tsdf, weight).

    Only cells whose eight voxels are all observed have faces; tsdf 0 counts as outside. A block of cells gets its own voxels
    and the first layers of the next blocks: at most (BLOCK + 1)^3 rows, and a tenth more than the volume in all. An empty
    volume has no faces."""
    own = volume.where("weight > 0").select("ix", "iy", "iz", F.col("tsdf").cast("double").alias("tsdf"))

    def blocks(c: str) -> Column:
        """The block of a voxel, and the one before it if that block's last cells need it."""
        block = F.floor(F.col(c) / F.lit(BLOCK))
        return F.explode(F.when(F.pmod(F.col(c), F.lit(BLOCK)) == 0, F.array(block - 1, block)).otherwise(F.array(block)))

    rows = own
    for c in "xyz":
        rows = rows.select("*", blocks(f"i{c}").alias(f"b{c}"))
    return rows.groupBy("bx", "by", "bz").applyInArrow(_block_faces(tuple(map(float, grid.low)), grid.voxel), FACES)


def mesh_vertices(faces: DataFrame) -> DataFrame:
    """vertex_id, x, y, z of the vertices of :func:`marching_cubes`, each once."""
    corners = F.explode(F.array(*[F.struct(F.col(n).alias("vertex_id"), *[F.col(n + x).alias(x) for x in "xyz"]) for n in "abc"]))
    return faces.select(corners.alias("v")).select("v.*").groupBy("vertex_id").agg(*[F.min(x).alias(x) for x in "xyz"])


# ---------------------------------------------------------------- topology and measures


def face_edges(faces: DataFrame) -> DataFrame:
    """a < b of each side of each face."""
    sides = [F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]
    return faces.select(F.explode(F.array(*sides)).alias("e")).select("e.*")


def mesh_report(faces: DataFrame) -> DataFrame:
    """One row of a mesh with positions: n_faces, n_vertices, n_edges, boundary_edges (of one face), crowded_edges (of more than two),
    euler (vertices - edges + faces), area and volume (of closed meshes). faces is read three times: it should be stored."""
    p = {n: [F.col(n + x) for x in "xyz"] for n in "abc"}
    side = lambda s, t: tuple(y - x for x, y in zip(p[s], p[t], strict=True))
    area = G.norm(G.cross(side("a", "b"), side("a", "c"))) / 2
    volume = G.dot(p["a"], G.cross(p["b"], p["c"])) / 6
    sums = faces.agg(F.count("*").alias("n_faces"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.coalesce(F.sum(volume), F.lit(0.0)).alias("volume"))
    vertices = mesh_vertices(faces).agg(F.count("*").alias("n_vertices"))
    uses = face_edges(faces).groupBy("a", "b").agg(F.count("*").alias("k"))
    edges = uses.agg(F.count("*").alias("n_edges"), F.count_if(F.col("k") == 1).alias("boundary_edges"), F.count_if(F.col("k") > 2).alias("crowded_edges"))
    out = sums.crossJoin(vertices).crossJoin(edges)  # a row each
    return out.select("n_faces", "n_vertices", "n_edges", "boundary_edges", "crowded_edges", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).alias("euler"), "area", "volume")


# ---------------------------------------------------------------- levels of detail


def clustered(faces: DataFrame, vertices: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of a coarser level: the vertices of each cube of ``size`` become their mean; faces whose corners meet
    go, and of faces with the same three corners one stays (the one that sorts first by corners, turned so that the smallest
    comes first). The id of a cube is that of its smallest vertex."""
    keys = [F.floor(F.col(x) / F.lit(size)).alias(f"k{x}") for x in "xyz"]
    named = vertices.select("vertex_id", *"xyz", *keys)
    cubes = named.groupBy("kx", "ky", "kz").agg(F.min("vertex_id").alias("cluster"), *[F.avg(x).alias(x) for x in "xyz"])
    to = named.select("vertex_id", "kx", "ky", "kz").join(cubes.select("kx", "ky", "kz", "cluster"), ["kx", "ky", "kz"]).select("vertex_id", "cluster")
    out = faces.select(*"abc")
    for n in "abc":
        out = out.join(to.select(F.col("vertex_id").alias(n), F.col("cluster").alias(f"_{n}")), n).drop(n).withColumnRenamed(f"_{n}", n)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    turned = F.when((a < b) & (a < c), F.struct(a, b, c)).when(b < c, F.struct(b.alias("a"), c.alias("b"), a.alias("c"))).otherwise(F.struct(c.alias("a"), a.alias("b"), b.alias("c")))
    turned = out.where("a <> b and b <> c and a <> c").select(turned.alias("t")).select("t.*")
    one = turned.groupBy("a", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi")).agg(F.min(F.struct("b", "c")).alias("t")).select("a", "t.b", "t.c")
    return one, cubes.select(F.col("cluster").alias("vertex_id"), *"xyz")


# ---------------------------------------------------------------- decimation

_Q = [f"q{i}" for i in range(10)]


def _quadrics(corners: DataFrame) -> DataFrame:
    """vertex_id and the sums q0..q9 of its faces' plane quadrics, weighted by area (upper triangle, row-major)."""
    p = {n: [F.col(f"{n}.{x}") for x in "xyz"] for n in "abc"}
    side = lambda s, t: tuple(y - x for x, y in zip(p[s], p[t], strict=True))
    rows = corners.select(*[F.col(f"{n}.id").alias(n) for n in "abc"], *[x.alias(f"m{k}") for k, x in enumerate(G.cross(side("a", "b"), side("a", "c")))], *[x.alias(f"p{k}") for k, x in enumerate(p["a"])])
    size = F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1") + F.col("m2") * F.col("m2"))
    rows = rows.withColumn("size", size).where("size > 0").withColumns({f"m{k}": F.col(f"m{k}") / F.col("size") for k in range(3)})
    rows = rows.withColumn("m3", -(F.col("m0") * F.col("p0") + F.col("m1") * F.col("p1") + F.col("m2") * F.col("p2")))
    terms = [(i, j) for i in range(4) for j in range(i, 4)]
    rows = rows.select(F.explode(F.array(*"abc")).alias("vertex_id"), *[(F.col(f"m{i}") * F.col(f"m{j}") * F.col("size") / 2).alias(q) for q, (i, j) in zip(_Q, terms, strict=True)])
    return rows.groupBy("vertex_id").agg(*[F.sum(q).alias(q) for q in _Q])


def _error(q: list[Column], p: list[Column]) -> Column:
    x, y, z = p
    return F.greatest(q[0] * x * x + 2 * q[1] * x * y + 2 * q[2] * x * z + 2 * q[3] * x + q[4] * y * y + 2 * q[5] * y * z + 2 * q[6] * y + q[7] * z * z + 2 * q[8] * z + q[9], F.lit(0.0))


def _corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """face_id and its corners a, b, c as (id, x, y, z)."""
    out = faces.select("face_id", *"abc")
    for n in "abc":
        out = out.join(vertices.select(F.col("vertex_id").alias(n), F.struct(F.col("vertex_id").alias("id"), *"xyz").alias(f"_{n}")), n).drop(n)
    return out.select("face_id", *[F.col(f"_{n}").alias(n) for n in "abc"])


def decimate(faces: DataFrame, vertices: DataFrame, most_error: float, rounds: int = 8, least_faces: int = 0) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) with edges collapsed in rounds while their quadric error is at most ``most_error``.

    A round collapses a set of independent edges at once: those that are cheapest among all edges around both their ends and
    their ends' neighbours, so no face is touched twice. An edge becomes its middle or one of its ends, whichever
    errs least. It stays if it or one of its ends lies on a boundary or on an edge of more than two faces, if its ends have other than two
    neighbours in common, or if a face would turn over; what stays doesn't hold up its neighbours in the next round. Rounds
    end early when nothing can be collapsed or ``least_faces`` are reached. Both results are stored tables."""
    tri = stored(faces.select(F.monotonically_increasing_id().alias("face_id"), *"abc"))
    points = stored(vertices.select("vertex_id", *"xyz"))
    barred = None  # edges that failed since their surroundings last changed
    for _ in range(rounds):
        corners = stored(_corners(tri, points))
        uses = stored(face_edges(tri).groupBy("a", "b").agg(F.count("*").alias("k")))
        fixed = uses.where("k <> 2").select(F.explode(F.array("a", "b")).alias("v")).distinct()
        quadrics = _quadrics(corners)
        edges = uses.select("a", "b").join(fixed.select(F.col("v").alias("a")), "a", "left_anti").join(fixed.select(F.col("v").alias("b")), "b", "left_anti")
        if barred is not None:
            edges = edges.join(barred, ["a", "b"], "left_anti")
        for n in "ab":
            own = quadrics.join(points, "vertex_id").select(F.col("vertex_id").alias(n), F.struct(*_Q, *"xyz").alias(f"_{n}"))
            edges = edges.join(own, n)
        q = [F.col(f"_a.{x}") + F.col(f"_b.{x}") for x in _Q]
        ends = [[F.col(f"_{n}.{x}") for x in "xyz"] for n in "ab"]
        ways = [[(s + t) / 2 for s, t in zip(*ends, strict=True)], *ends]
        cost = F.array_min(F.array(*[F.struct(_error(q, p).alias("error"), F.lit(i).alias("way"), *[x.alias(n) for x, n in zip(p, "xyz", strict=True)]) for i, p in enumerate(ways)]))
        priced = edges.select("a", "b", cost.alias("to")).where(F.col("to.error") <= most_error)
        priced = stored(priced.select("a", "b", "to", F.struct("to.error", F.xxhash64("a", "b").alias("h"), "a", "b").alias("rank")))
        # the cheapest edge at each vertex, then around each vertex's neighbours
        at = priced.select(F.explode(F.array("a", "b")).alias("v"), "rank").groupBy("v").agg(F.min("rank").alias("rank"))
        around = uses.select("a", "b").union(uses.select("b", "a")).toDF("v", "other").join(at.select(F.col("v").alias("other"), "rank"), "other").select("v", "rank").union(at)
        around = around.groupBy("v").agg(F.min("rank").alias("low"))
        chosen = priced.join(around.select(F.col("v").alias("a"), F.col("low").alias("_a")), "a").join(around.select(F.col("v").alias("b"), F.col("low").alias("_b")), "b")
        chosen = stored(chosen.where("rank = _a and rank = _b").select("a", "b", "to"))
        # common neighbours of both ends: two in a mesh without holes
        ring = uses.select("a", "b").union(uses.select("b", "a")).toDF("v", "other")
        common = chosen.join(ring.toDF("a", "x"), "a").join(ring.toDF("b", "y"), "b").where("x = y").groupBy("a", "b").agg(F.count("*").alias("k")).where("k <> 2").select("a", "b")
        # faces at one end that would turn over
        moved = chosen.select(F.explode(F.array("a", "b")).alias("v"), "a", "b", "to").withColumnsRenamed({"a": "ea", "b": "eb"})
        touched = corners.select("*", F.explode(F.array("a.id", "b.id", "c.id")).alias("v")).join(moved, "v")
        both = F.array_contains(F.array("a.id", "b.id", "c.id"), F.col("ea")) & F.array_contains(F.array("a.id", "b.id", "c.id"), F.col("eb"))
        old = {n: [F.col(f"{n}.{x}") for x in "xyz"] for n in "abc"}
        new = {n: [F.when(F.col(f"{n}.id") == F.col("v"), F.col(f"to.{x}")).otherwise(F.col(f"{n}.{x}")) for x in "xyz"] for n in "abc"}
        normal = lambda p: G.cross(*[tuple(y - x for x, y in zip(p["a"], p[t], strict=True)) for t in "bc"])
        before, after = normal(old), normal(new)
        turned = touched.where(~both & (G.dot(before, after) <= F.lit(0.2) * G.norm(before) * G.norm(after))).select(F.col("ea").alias("a"), F.col("eb").alias("b"))
        failed = stored(common.union(turned).distinct())
        done = stored(chosen.join(failed, ["a", "b"], "left_anti"))
        n = done.count()
        if not n and failed.isEmpty():
            for table in (corners, uses, priced, chosen, failed, done):
                discard(table)
            break
        to = done.select(F.col("b").alias("v"), F.col("a").alias("into"))
        out = tri
        for c in "abc":
            out = out.join(to.select(F.col("v").alias(c), F.col("into").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        out = stored(out.where("a <> b and b <> c and a <> c").select("face_id", *"abc"))
        place = points.join(done.select(F.col("b").alias("vertex_id")), "vertex_id", "left_anti").join(done.select(F.col("a").alias("vertex_id"), "to"), "vertex_id", "left")
        place = stored(place.select("vertex_id", *[F.coalesce(F.col(f"to.{x}"), F.col(x)).alias(x) for x in "xyz"]))
        # a failed edge may be tried again once something near it has changed
        near = done.select(F.explode(F.array("a", "b")).alias("v"))
        changed = ring.join(near, "v").select(F.col("other").alias("v")).union(near).distinct()
        still = failed if barred is None else failed.union(barred).distinct()
        still = still.join(changed.select(F.col("v").alias("a")), "a", "left_anti").join(changed.select(F.col("v").alias("b")), "b", "left_anti")
        kept = stored(still.select("a", "b"))
        for table in (tri, points, corners, uses, priced, chosen, failed, done, *([barred] if barred is not None else [])):
            discard(table)
        tri, points, barred = out, place, kept
        if least_faces and tri.count() <= least_faces:
            break
    return tri.select(*"abc"), points


def with_positions(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces (a, b, c) with the positions of their corners (ax, ay, az, bx, ...), as :func:`mesh_report` wants them."""
    out = faces.select(*"abc")
    for n in "abc":
        out = out.join(vertices.select(F.col("vertex_id").alias(n), *[F.col(x).alias(n + x) for x in "xyz"]), n)
    return out


# ---------------------------------------------------------------- splitting


def split_objects(faces: DataFrame, least_faces: int = 1) -> DataFrame:
    """face_id, component (its smallest vertex), n_faces, object_id and whether the part is stray, for each face
    (face_id, a, b, c, object_id): a part is what hangs together by vertices. Its object is the one that most of its faces
    name (the smallest of several; faces that name none don't count, and parts of such faces have none); a part of fewer than ``least_faces`` faces is stray."""
    edges = faces.select(F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")))).alias("e")).select("e.*")
    parts = connected_components(edges)
    of = faces.join(parts.select(F.col("node").alias("a"), "component"), "a")
    votes = of.groupBy("component", "object_id").agg(F.count("*").alias("k"))
    best = votes.groupBy("component").agg(F.sum("k").alias("n_faces"), F.min(F.when(F.col("object_id").isNotNull(), F.struct(-F.col("k"), "object_id"))).alias("x"))
    found = best.select("component", "n_faces", F.col("x.object_id").alias("object_id"), (F.col("n_faces") < least_faces).alias("stray"))
    return of.select("face_id", "component").join(found, "component").select("face_id", "component", "n_faces", "object_id", "stray")
