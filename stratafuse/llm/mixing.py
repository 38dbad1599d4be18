"""Operator 2: mix sources to target weights by hash-threshold histograms.

A document's place in the mix is a hash of its id. Tokens are summed by source and by
the leading hex digits of that hash; the budget's threshold lies in the one bucket of
each source where the running sum passes what the source may give. Only that boundary
bucket is summed again, by the next digits, until it holds a single hash. The mix is
then a filter on the hash, without any sort of the documents. Only histograms (sources x
16^DIGITS rows a level) are grouped; the water filling of the targets runs over one row
a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafuse.llm import common as C

DIGITS, HEX = 3, 15  # hex digits refined a level, digits of the hash in all


def source_targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, cap: float) -> DataFrame:
    """source, source_size, target from (source, source_size). Sources in code point order, null
    last, weigh ``weights`` in turn and share factor * (all sizes); a target stops at cap *
    source_size and the excess is shared again by weight: sources fill in order of
    cap / weight, so one running sum over that order finds the level of the rest."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    top = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy(F.lit(0))
    top = top.withColumn("lambda", (F.sum("source_size").over(whole) * F.lit(float(factor)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source in that order whose cap isn't reached sets the level of all later ones
    top = top.withColumn("open", F.col("lambda") < F.col("ratio")).withColumn("level", F.min_by("lambda", F.when(F.col("open"), F.col("ratio"))).over(whole))
    return top.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


#: Sources up to this many are broadcast with their thresholds; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def id_hash(doc_id: Column) -> Column:
    """A document's place in the mix."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, HEX)


def thresholds(spark: SparkSession, rows: DataFrame, root: str, weights: tuple[float, ...] = (3.0, 1.0, 2.0), factor: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, bool]:
    """(one row a source: g (the source), source_size, target, copies, edge, nearer; whether these
    are few enough to be broadcast) from written ``rows`` (source, size, h)."""
    targets = C.saved(spark, source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, cap), root, "targets")
    few = targets.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    goal = targets.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))

    # level by level: prefix is the boundary bucket, below the words that lie before it
    bound = goal.select("source", "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for i, done in enumerate(range(0, HEX, DIGITS)):
        inside = rows.join(F.broadcast(bound) if few else bound, rows["source"].eqNullSafe(bound["source"]) & (F.substring("h", 1, done) == F.col("prefix")))
        hist = inside.groupBy(rows["source"], "budget", "prefix", "below", F.substring("h", 1, done + DIGITS).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("below") + F.sum("words").over(run)).where(F.col("upto") > F.col("budget"))
        first = hist.groupBy("source").agg(F.min_by(F.struct("budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("words")).alias("below"), "h0", "h1", "upto"), "bucket").alias("x")).select("source", "x.*")
        bound = C.saved(spark, first, root, f"level-{i}")
        if bound.where("h0 <> h1").isEmpty():
            break
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("below")
    edge = bound.select(F.col("source").alias("s"), F.col("h0").alias("edge"), nearer.alias("nearer"))
    out = goal.select(F.col("source").alias("g"), "source_size", "target", "copies").join(edge, F.col("g").eqNullSafe(F.col("s")), "left").drop("s")
    return C.saved(spark, out, root, "thresholds"), few


def times(h: Column, at: str = "") -> Column:
    """How often a document of hash ``h`` is taken, by its source's row of :func:`thresholds` (in the struct ``at``)."""
    edge, nearer, target, copies, size = (F.col(at + x) for x in ("edge", "nearer", "target", "copies", "source_size"))
    all_more = edge.isNull() & (target > copies * size)
    return copies + F.when(all_more | (h < edge) | ((h == edge) & nearer), 1).otherwise(0)


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), id_hash(F.col("doc_id")).alias("h"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), factor: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source, ...).

    size counts the words of the text (null: 0). Each source gives floor(target / size)
    whole copies of all its documents and, of one copy more, the documents whose hash lies
    below its threshold: the longest run in hash order whose sizes fit what is left, so the
    words taken miss the target by half a document at most (the document at the threshold
    comes along if that is nearer). taken is size times the copies.
    The hash is the md5 of the doc_id, so reruns agree; rows of one doc_id (also null)
    share a hash and are taken together or not at all. A source without words has
    target 0; an empty table gives an empty result.
    """
    root = C.work_dir(spark)
    rows = C.saved(spark, sized(docs), root, "sizes")
    per_source, few = thresholds(spark, rows, root, weights, factor, cap)
    joined = rows.join(F.broadcast(per_source) if few else per_source, F.col("source").eqNullSafe(F.col("g")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"))).alias("taken"), times(F.col("h")).alias("times"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, C.documents(spark, sf_dir)).drop("times")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document comes as often as it is taken (0, 1 or 2 times). Texts stay
    where they are read; only the thresholds travel."""
    root = C.work_dir(spark)
    per_source, few = thresholds(spark, C.saved(spark, sized(docs), root, "sizes"), root)
    per_source = per_source.select(F.struct(*per_source.columns).alias("_mix"))
    joined = docs.join(F.broadcast(per_source) if few else per_source, F.col("source").eqNullSafe(F.col("_mix.g")))
    n = joined.select(*docs.columns, times(id_hash(F.col("doc_id")), "_mix.").alias("_times")).where("_times > 0")
    return n.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(docs.columns)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
        - coalesce((SELECT sum(b.cap) FROM r b WHERE (b.ratio, coalesce(b.source, chr(1114111))) < (r.ratio, coalesce(r.source, chr(1114111)))), 0))
        / (SELECT sum(b.w) FROM r b WHERE (b.ratio, coalesce(b.source, chr(1114111))) >= (r.ratio, coalesce(r.source, chr(1114111)))) AS lam FROM r),
v AS (SELECT min_by(lam, ratio) AS level FROM l WHERE lam < ratio),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM v) IS NULL OR ratio <= (SELECT level FROM v) THEN cap ELSE w * (SELECT level FROM v) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS copies FROM t),
c AS (SELECT d.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS same FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN budget > 0 AND (upto <= budget OR (upto - same <= budget AND upto - budget < budget - (upto - same))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
