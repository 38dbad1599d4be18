"""Exact nearest neighbours of point sets, and the surface metrics over them.

Points fall into cells of a pyramid: cubes whose side grows fourfold from level to level, each with the number of its points and one of
them. A query point keeps the cells that can still hold its nearest neighbour: those whose box is no farther than the nearest
point it knows of, which is at most the one that each cell shows. Near points start at the 27 cells around them, whose ring is enough
if a known point lies within one side; all others start at the top of the pyramid and go down. Cells of many
points go down further, below the base. So neither far outliers nor crowded cells make pairs of all with all.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafuse.session import discard, stored

#: Points that a cell is compared with at once; fuller cells are divided.
LEAF = 128
#: Levels below the base, and by how much the sides of levels differ.
DOWN, RATIO = 12, 4
_KEY = ["kx", "ky", "kz"]


def _finite(points: DataFrame) -> DataFrame:
    return points.where(" and ".join(f"abs({c}) < double('inf')" for c in "xyz"))


def _square(a: list[Column], b: list[Column]) -> Column:
    d = [p - q for p, q in zip(a, b, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _to_box(p: list[Column], size: float) -> Column:
    """Squared distance of a point to the cell kx, ky, kz of a level, less what rounding can add."""
    gaps = [F.greatest(F.greatest(F.col(k) * F.lit(size) - x, x - (F.col(k) + 1) * F.lit(size)) - F.lit(1e-12) * (F.abs(x) + F.lit(size)), F.lit(0.0)) for x, k in zip(p, _KEY, strict=True)]
    return (gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]) * F.lit(1 - 1e-9)


def _pyramid(points: DataFrame, cell: float) -> tuple[dict[int, DataFrame], int, int]:
    """Cells (kx, ky, kz, n, rep) of each level; the top has at most 8 cells, and below the base only cells of more than LEAF points are divided.
    Stored are the base and the levels below it."""
    keys = [F.floor(F.col(c) / F.lit(cell)).alias(k) for c, k in zip("xyz", _KEY, strict=True)]
    base = stored(points.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*"xyz")).alias("rep")))
    levels, top = {0: base}, 0
    most, *ends = base.agg(F.max("n"), *[f(k) for k in _KEY for f in (F.min, F.max)]).first()
    while any(hi // RATIO**top - lo // RATIO**top > 1 for lo, hi in zip(ends[::2], ends[1::2], strict=True)):
        top += 1
        levels[top] = base.groupBy(*[F.floor(F.col(k) / F.lit(RATIO**top)).alias(k) for k in _KEY]).agg(F.sum("n").alias("n"), F.min("rep").alias("rep"))
    low = 0
    while low > -DOWN and most > LEAF:
        size = cell / float(RATIO) ** (1 - low)
        keys = [F.floor(F.col(c) / F.lit(size)).alias(k) for c, k in zip("xyz", _KEY, strict=True)]
        parents = levels[low].where(F.col("n") > LEAF).select(*[F.col(k).alias(f"p{k}") for k in _KEY])
        inside = points.withColumns({f"p{k}": F.floor(F.floor(F.col(c) / F.lit(size)) / F.lit(RATIO)) for c, k in zip("xyz", _KEY, strict=True)})
        inside = inside.join(parents, [f"p{k}" for k in _KEY], "left_semi")
        low -= 1
        levels[low] = stored(inside.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*"xyz")).alias("rep")))
        most = levels[low].agg(F.max("n")).first()[0]
    return levels, top, low


def _kept(candidates: DataFrame) -> DataFrame:
    """Cells of each point (id, x, y, z, cell columns, near, known) that are no farther than the nearest point known for it."""
    best = F.min("known").over(Window.partitionBy("id"))
    return candidates.withColumn("known", best).where("near <= known")


def nearest(queries: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """id, distance of the nearest point for every query (id, x, y, z); null where there are no points.

    Exact for any cell; about the spacing of the points is fast. Points and queries with null or infinite coordinates take no
    part (such queries get null); equal points count once. ids should be unique: rows of one id are taken for one query."""
    p = [F.col(c) for c in "xyz"]
    sought = stored(queries.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    finite = _finite(sought).dropDuplicates(["id"])
    unique = stored(_finite(points.select(*[F.col(c).cast("double").alias(c) for c in "xyz"])).distinct())
    if unique.isEmpty():
        return sought.select("id").distinct().withColumn("distance", F.lit(None).cast("double"))
    levels, top, low = _pyramid(unique, cell)
    rep = [F.col(f"rep.{c}") for c in "xyz"]
    shown = lambda df, level: df.withColumns({"near": _to_box(p, cell * float(RATIO) ** level), "known": _square(p, rep)}).drop("rep")
    # the ring around each query's own cell
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip(_KEY, o, strict=True)]) for o in product((-1, 0, 1), repeat=3)]))
    ring = finite.select("id", *"xyz", around.alias("o")).select("id", *"xyz", *[(F.floor(x / F.lit(cell)) + F.col(f"o.{k}")).alias(k) for x, k in zip(p, _KEY, strict=True)])
    ring = stored(_kept(shown(ring.join(levels[0], _KEY), 0)).where(F.col("known") <= cell * cell))
    # all others go down from the top
    far = finite.join(ring.select("id").distinct(), "id", "left_anti")
    open_ = shown(far.crossJoin(F.broadcast(levels[top].drop("n").limit(8))), top)  # at most eight cells
    open_ = _kept(open_)
    for level in range(top - 1, -1, -1):
        children = levels[level].select(*[F.floor(F.col(k) / F.lit(RATIO)).alias(f"p{k}") for k in _KEY], "*")
        open_ = open_.select("id", *"xyz", *[F.col(k).alias(f"p{k}") for k in _KEY], F.col("known").alias("held"))
        found = shown(open_.join(children.drop("n"), [f"p{k}" for k in _KEY]).drop(*[f"p{k}" for k in _KEY]), level)
        open_ = _kept(found.withColumn("known", F.least("known", "held")).drop("held"))
    open_ = open_.join(levels[0].select(*_KEY, "n"), _KEY)
    now = ring.select("id", *"xyz", *_KEY, "n", "near", "known").unionByName(open_.select("id", *"xyz", *_KEY, "n", "near", "known"))
    now = stored(now) if low < 0 else now
    work = [ring, *([now] if low < 0 else [])]
    # cells of few points are compared, the others divided
    distances = []
    for level in range(0, low - 1, -1):
        size = cell * float(RATIO) ** level
        few = unique.select(*[F.floor(F.col(c) / F.lit(size)).alias(k) for c, k in zip("xyz", _KEY, strict=True)], F.struct(*"xyz").alias("q"))
        last = level == -DOWN
        leaf = now if last else now.where(F.col("n") <= LEAF)
        pairs = leaf.select("id", *"xyz", *_KEY).join(few, _KEY)
        distances.append(pairs.groupBy("id").agg(F.min(_square(p, [F.col(f"q.{c}") for c in "xyz"])).alias("d")))
        if level > low:
            children = levels[level - 1].select(*[F.floor(F.col(k) / F.lit(RATIO)).alias(f"p{k}") for k in _KEY], "*")
            down = now.where(F.col("n") > LEAF).select("id", *"xyz", *[F.col(k).alias(f"p{k}") for k in _KEY], F.col("known").alias("held"))
            found = shown(down.join(children, [f"p{k}" for k in _KEY]).drop(*[f"p{k}" for k in _KEY]), level - 1)
            now = stored(_kept(found.withColumn("known", F.least("known", "held")).drop("held")))
            work.append(now)
    every = distances[0]
    for d in distances[1:]:
        every = every.unionByName(d)
    best = stored(every.groupBy("id").agg(F.sqrt(F.min("d")).alias("distance")))
    for table in (*work, *(levels[k] for k in levels if k <= 0), unique):
        discard(table)
    return sought.select("id").distinct().join(best, "id", "left")


def _counted(points: DataFrame) -> DataFrame:
    """id, x, y, z, n: each place once, with the number of its points. Places are as many as the surface has, however often it was seen."""
    places = points.select(*[F.col(c).cast("double").alias(c) for c in "xyz"]).groupBy(*"xyz").agg(F.count("*").alias("n"))
    return stored(places.select(F.monotonically_increasing_id().alias("id"), *"xyz", "n"))


def surface_metrics(found: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], cell: float) -> DataFrame:
    """A row for each threshold: n_found, n_truth, accuracy_m (mean distance of found points (x, y, z; a row a point) to the truth),
    completeness_m (mean distance back), chamfer_m (their mean), precision, recall, f_score. Means and ratios of an empty side are null, f_score is 0
    where precision and recall both are. Each side is read once; points at one place are measured once and count as many."""
    found, truth = _counted(found), _counted(truth)
    sides = []
    for name, a, b in (("found", found, truth), ("truth", truth, found)):
        d = a.join(nearest(a, b, cell), "id")
        known = F.nullif(F.sum(F.when(F.col("distance").isNotNull(), F.col("n"))), F.lit(0)).cast("double")
        within = [(F.sum(F.when(F.col("distance") <= t, F.col("n")).otherwise(0)) / known).alias(f"r{i}") for i, t in enumerate(thresholds)]
        sides.append(d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}"), (F.sum(F.col("n") * F.col("distance")) / known).alias("mean"), *within))
    p, r = (s.withColumn("t", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold_m"), F.col(f"r{i}").alias("share")) for i, t in enumerate(thresholds)]))) for s in sides)
    p = p.select("t.threshold_m", "n_found", F.col("mean").alias("accuracy_m"), F.col("t.share").alias("precision"))
    r = r.select("t.threshold_m", "n_truth", F.col("mean").alias("completeness_m"), F.col("t.share").alias("recall"))
    both = F.col("precision") + F.col("recall")
    f = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))).when(both == 0, F.lit(0.0))
    out = p.join(r, "threshold_m")
    return out.select("threshold_m", "n_found", "n_truth", "accuracy_m", "completeness_m", ((F.col("accuracy_m") + F.col("completeness_m")) / 2).alias("chamfer_m"), "precision", "recall", f.alias("f_score"))
