"""Shared plumbing of the training-data operators: work tables in the cluster's
shared folder, bounded Arrow batches, size-checked semi joins, word hashing and
connected components.

Tables that cut lineage are written under ``spark.checkpoint.dir``; they belong
to one call and can be dropped with :func:`drop_work` once its result is stored.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract: space and 0x09-0x0D, which are also
#: the separators of ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a broadcast list of keys, and of one key in its hash table; longer lists are joined by a shuffle.
BROADCAST_BYTES, KEY_BYTES = 48 << 20, 48
BROADCAST_IDS = BROADCAST_BYTES // KEY_BYTES


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratafuse-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def drop_work(spark: SparkSession, root: str) -> None:
    """Delete a work folder (its results must have been stored before)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a file of a table whose size is known beforehand.
FILE_BYTES = 16 << 20


def keep_only(spark: SparkSession, root: str, *names: str) -> None:
    """Delete the tables of a work folder but for the named ones, which a result still reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        if status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)


def saved(spark: SparkSession, df: DataFrame, root: str, name: str, most_bytes: float | None = None) -> DataFrame:
    """Write ``df`` once below ``root`` and read it back: lineage ends at files that outlive executors.
    A table of at most ``most_bytes`` (uncompressed) gets no more files than that asks for."""
    path = f"{root}/{name}"
    if most_bytes is not None:
        df = df.coalesce(max(1, int(-(-most_bytes // FILE_BYTES))))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Bound what one Arrow batch, and one batch of the Parquet reader, holds, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """``left_semi``/``left_anti`` of a wide table with a written list of distinct ids: the
    list is counted and broadcast up to ``most`` rows, else both sides are shuffled."""
    small = ids.count() <= most
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


#: Columns of :func:`with_row_key`; lists of them are broadcast up to BROADCAST_KEYS rows.
ROW_KEY = ["_id", "_row"]
BROADCAST_KEYS = BROADCAST_IDS // 2


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with _id and _row, which name a row by its doc_id and text: rows of one doc_id (also
    null) with different texts have different keys."""
    doc = F.col("doc_id").cast("long")
    return docs.withColumns({"_id": F.coalesce(doc, F.lit(0).cast("long")), "_row": F.xxhash64(doc, "text")})


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words in numpy

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (shift and multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 1
_powers: dict[str, np.ndarray] = {}


#: Bytes that are hashed at once, and the longest table of powers that a worker keeps.
HASH_BLOCK, KEPT_POWERS = 1 << 20, 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (at least) of the hash base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(max(n, (1 << 20) + 1), base, np.uint64)
        x[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(x, out=x))
    if n <= KEPT_POWERS + 1:
        _powers.update(up=out[0], down=out[1])
    return out[0], out[1]


def _next_separator(a: np.ndarray, at: int) -> int:
    """The first separator from ``at`` on, or the end."""
    step = 1 << 12
    while at < len(a):
        found = np.flatnonzero(_IS_SEPARATOR[a[at : at + step]])
        if len(found):
            return at + int(found[0])
        at, step = at + step, 2 * step
    return len(a)


def word_hashes(blobs: list[bytes], prefix: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (of their first ``prefix`` bytes), and the
    offsets at which each text's words start (one more than texts). Polynomial hashes of random
    byte values, by one running sum for each block of about HASH_BLOCK bytes."""
    ends = np.cumsum([len(x) + 1 for x in blobs]) if blobs else np.zeros(0, np.int64)
    a = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    hashes, words, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(a):
        hi = _next_separator(a, lo + HASH_BLOCK)
        block = a[lo:hi]
        up, down = powers(len(block) + 1)
        edge = np.flatnonzero(np.diff(_IS_SEPARATOR[block], prepend=True, append=True))
        starts, stops = edge[0::2], edge[1::2]
        stops = np.minimum(stops, starts + prefix)
        with np.errstate(over="ignore"):
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTE[block] * up[: len(block)], out=total[1:])
            hashes.append(mix64((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        words.append(starts + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate([[0], np.searchsorted(np.concatenate(words), ends)])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64((out ^ h[j : j + n]) * _M2)
    return out


# ---------------------------------------------------------------- graph


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Each node is the a of at most one edge, and no node is both an a and a b."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(spark: SparkSession, edges: DataFrame, root: str, name: str, most_edges: int | None = None) -> DataFrame:
    """(node, comp) for every node of the undirected ``edges`` (a, b): comp is the smallest
    node reachable. Alternates large-star and small-star rounds (each a groupBy-min and a
    join) until every component is a star around its smallest node; nothing is collected.
    RuntimeError if there still are others after 100 rounds (they halve the longest path, so that takes 2^100 nodes)."""
    size = None if most_edges is None else 64 * most_edges  # no round has more edges than the one before
    now = saved(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), root, f"{name}-0", size)
    for i in range(1, 101):
        if _is_forest_of_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct())
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        now = saved(spark, small.select("e.*").where("a <> b").distinct(), root, f"{name}-{i}", size)
    raise RuntimeError(f"{name}: components are open after {i} rounds")
