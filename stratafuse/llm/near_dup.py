"""Operator 1: near-duplicate documents by MinHash.

One-permutation hashing: the distinct shingle hashes of a text are sorted once; the
top bits name the bin, so the first hash of each bin is its minimum. Empty bins are
filled by optimal densification (each bin probes the others in an order of its own).
Bands of the signature are bucket keys. Within a bucket candidate edges form a star
around the most central member, never all pairs. Texts of buckets that still span
several components after that are bucketed anew, by the rarest shingles of their sets
(two sets above the threshold must share one of those: the prefix filter), which frees
texts that differ from all others by too many shingles of their own. Where even that leaves
very many pairs for each text, as of texts put together from shared passages, open buckets
are split by finer bands: long ones over many more bins, in which few but near copies meet. That is told
from the buckets' sizes before their pairs are made. Buckets
go on in rounds of stars until no untested pair of different components is left; a hub
has been compared with everyone and leaves its bucket, so the loop ends. Every
candidate is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from stratafuse.llm import common as C

BINS, ROWS = 128, 4  # 32 bands: a pair at 0.8 is missed with probability 5e-8, at 0.85 with 6e-11


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (fewer words: the whole
    sequence is the one shingle; no words: empty)."""
    h, at = C.word_hashes([t.encode().lower() if t else b"" for t in texts])
    runs, sets = C.window_hashes(h, k), []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= k:
            sets.append(np.unique(runs[s : e - k + 1]))
        elif e > s:
            sets.append(C.window_hashes(np.append(h[s:e], np.uint64(e - s)), e - s + 1))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


#: Finer bands: bins, bands, and the chance to miss a pair at the threshold that sets their length.
FINE_BINS, FINE_BANDS, FINE_MISS = 4096, 512, 1e-7
#: Pairs for each text of a round above which open buckets are split by finer bands, how many times that the buckets
#: may promise (a pair meets in several), and rounds after which one is an error.
DENSE, REPEATS, ROUNDS = 16, 64, 64
#: Hubs of a bucket in the rounds after the first.
HUBS = 32


def _probes() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_PROBES = _probes()
_BOUNDS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def band_keys(u: np.ndarray) -> np.ndarray:
    """One bucket key for each band of the densified one-permutation signature of a set."""
    at = np.minimum(np.searchsorted(u, _BOUNDS), len(u) - 1)
    sig = u[at]
    full = (sig >> np.uint64(64 - BINS.bit_length() + 1)) == np.arange(BINS, dtype=np.uint64)
    if not full.all():
        empty = np.flatnonzero(~full)
        take = np.argmax(full[_PROBES[empty]], axis=1)
        sig[empty] = sig[_PROBES[empty, take]]
    with np.errstate(over="ignore"):
        key = np.arange(BINS // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(ROWS):
            key = C.mix64(key ^ sig[j::ROWS])
    return key


def fine_rows(percent: int) -> int:
    """Length of the finer bands, so that a pair at the threshold shares none with chance FINE_MISS."""
    shared = 1 - FINE_MISS ** (1 / FINE_BANDS)
    return max(ROWS, int(math.log(shared) / math.log(min(99, percent) / 100)))


def fine_keys(u: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys of a set by FINE_BANDS bands of ``rows`` of FINE_BINS densified bins."""
    shift = np.uint64(64 - FINE_BINS.bit_length() + 1)
    bins = np.arange(FINE_BINS, dtype=np.uint64)
    at = np.minimum(np.searchsorted(u, bins << shift), len(u) - 1)
    sig = u[at]
    full = (sig >> shift) == bins
    empty, probe = np.flatnonzero(~full), 1
    out = sig.copy()
    while len(empty):
        with np.errstate(over="ignore"):
            to = (C.mix64(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(probe)) & np.uint64(FINE_BINS - 1)).astype(np.int64)
        found = full[to]
        out[empty[found]] = sig[to[found]]
        empty, probe = empty[~found], probe + 1
    with np.errstate(over="ignore"):
        key = ~np.arange(FINE_BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        pick = C.mix64(np.arange(FINE_BANDS * rows, dtype=np.uint64) + np.uint64(1 << 40)) & np.uint64(FINE_BINS - 1)
        for j in range(rows):
            key = C.mix64(key ^ out[pick[j::rows].astype(np.int64)])
    return key


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), k)
            prints = [np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), "<i8") for u in sets]
            keys = [band_keys(u).view(np.int64) if len(u) else None for u in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(u) for u in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "hi", "lo", "bands"],
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), k)
            prints = [np.frombuffer(hashlib.blake2b(u.tobytes(), digest_size=16).digest(), "<i8") for u in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())],
                ["node", "hi", "lo", "members"],
            )

    return run


#: Slots of the shingle counts by which the prefix filter orders shingles (4 bytes each when broadcast).
SLOTS_LOG = 18


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOTS_LOG, np.int64)
    for b in batches:
        for x in b.column("members"):
            np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - SLOTS_LOG)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["slot", "n"])


KEYED = "id struct<node:long,hi:long,lo:long>, n long, central long, comp struct<node:long,hi:long,lo:long>, keys array<long>"
_OF_TEXT = ["id", "n", "central", "comp"]


def _keyed(keys_of):
    """Sets with what is known of their texts into bucket keys: ``keys_of`` one sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                keys = [keys_of(np.frombuffer(x.as_buffer(), np.uint64)).view(np.int64) for x in part.column("members")]
                yield pa.RecordBatch.from_arrays([*part.select(_OF_TEXT).columns, pa.array(keys, pa.list_(pa.int64()))], [*_OF_TEXT, "keys"])

    return run


def _prefixes(counts, percent: int):
    """Bucket keys of a set: its shingles that are rarest by ``counts`` (ties by hash), as many
    as leave out fewer than any partner above the threshold must share."""

    def keys_of(u: np.ndarray) -> np.ndarray:
        length = len(u) - (percent * len(u) + 99) // 100 + 1
        order = np.lexsort((u, counts.value[(u >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)]))
        return u[order[:length]]

    return _keyed(keys_of)


def _open(members: DataFrame) -> DataFrame:
    """The members of the buckets that span several components."""
    keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return members.join(keys, "key", "left_semi")


def _rare_buckets(spark: SparkSession, sets: DataFrame, members: DataFrame, percent: int, root: str, size: float) -> DataFrame:
    """The members of open buckets, bucketed by the prefix filter instead: key, id, n, central, comp
    and pos, the shingles of the set that come before this one."""
    info = members.select(*_OF_TEXT).distinct()
    rest = C.saved(spark, sets.join(info, "id"), root, "rest", size)
    found = rest.select("members").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^SLOTS_LOG rows, as columns
    table = np.zeros(1 << SLOTS_LOG, np.int32)
    table[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    counts = spark.sparkContext.broadcast(table)
    keys = rest.mapInArrow(_prefixes(counts, percent), KEYED).select(*_OF_TEXT, F.posexplode("keys").alias("pos", "key"))
    return _open(C.saved(spark, keys, root, "rare-all"))


def _fine_buckets(spark: SparkSession, sets: DataFrame, members: DataFrame, percent: int, root: str) -> DataFrame:
    """The members of open buckets, bucketed by finer bands instead."""
    rows = fine_rows(percent)
    keys = sets.join(members.select(*_OF_TEXT).distinct(), "id").mapInArrow(_keyed(lambda u: fine_keys(u, rows)), KEYED).select(*_OF_TEXT, F.explode("keys").alias("key")).withColumn("pos", F.lit(0))
    return _open(C.saved(spark, keys, root, "fine-all")).select(members.columns)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                u, v = (u, v) if len(u) <= len(v) else (v, u)
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int(np.count_nonzero(v[at] == u))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            ends = ["a", "b", "ca", "cb"]
            yield pa.RecordBatch.from_arrays([*b.select(ends).columns, pa.array(keep, pa.bool_())], [*ends, "linked"])

    return run


def _promised(members: DataFrame, hubs: int) -> int:
    """Pairs of different components that the stars of these buckets have at most, told from the buckets' sizes before any is made: of a
    bucket of m texts, L of them of its largest component, hubs meet the m - L others, and those hubs that aren't of that component its L texts."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("L"))
    rest = F.col("m") - F.col("L")
    most = F.least("m", F.lit(hubs)) * rest + F.least(rest, F.lit(hubs)) * F.col("L")
    return sizes.agg(F.coalesce(F.sum(most), F.lit(0))).first()[0]


def _moved(df: DataFrame, moves: DataFrame | None) -> DataFrame:
    """df with the component that comp has become part of."""
    if moves is None:
        return df
    return df.join(moves.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left").withColumn("comp", F.coalesce("_to", "comp")).drop("_to")


def _stars(members: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the most central members of each bucket, pairs of them with the other members that are in another
    component and not too different in size)."""
    first = Window.partitionBy("key").orderBy(F.desc("central"), "id")
    top = members.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= hubs)
    top = top.select("key", F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"), F.col("comp").alias("hub_comp"))
    # what follows their first shared shingle in both sets must hold all that they have to share
    fits = (F.least(F.col("n") - F.col("pos"), F.col("hub_n") - F.col("hub_pos")) * (100 + percent) >= (F.col("n") + F.col("hub_n")) * percent) & (F.col("comp") != F.col("hub_comp"))
    return top, members.join(top, "key").where(fits)


PAIRS = ", ".join(f"{c} struct<node:long,hi:long,lo:long>" for c in ("a", "b", "ca", "cb")) + ", linked boolean"


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links for each row of ``docs`` (doc_id, text, ...).

    Two texts are linked if 100 * |A n B| >= percent * |A u B| over distinct ``words``-word
    shingles. component_id is the smallest doc_id reachable; n_links counts the confirmed
    links of the row's text to other texts that were needed to connect it, plus 1 if the
    very same set occurs elsewhere. Equal sets are one class from the start, so groups of
    copies cost one comparison. Texts without words have an empty set and stay alone. Rows
    with a null doc_id can't be named: they get a null component_id, are kept and link
    nothing. Rows of equal doc_id are judged by their own texts. Other columns are ignored;
    an empty table gives an empty result.
    """
    C.bounded_batches(spark)
    root = C.work_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    sketch = C.saved(spark, docs.mapInArrow(_sketches(words), "doc_id long, n_shingles long, hi long, lo long, bands array<long>"), root, "sketch")
    n_rows, shingles = sketch.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    bands = BINS // ROWS
    named = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = C.saved(spark, named.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"), F.min_by("bands", "doc_id").alias("bands")), root, "classes", n_rows * (40 + 8 * bands))

    # A doc_id with several texts would give several classes one name: such later classes are
    # numbered by (node, hi, lo) through their sets' identity, so the class key is (hi, lo).
    exploded = classes.select("hi", "lo", "node", "n", F.explode("bands").alias("key"))
    sizes = exploded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    of_text = Window.partitionBy("hi", "lo")  # at most one row a band
    members = exploded.join(sizes, "key").withColumn("central", F.sum("members").over(of_text))
    members = members.select("key", "n", "central", F.struct("node", "hi", "lo").alias("id"), F.lit(0).alias("pos")).withColumn("comp", F.col("id"))
    members = C.saved(spark, members, root, "buckets", n_rows * bands * 40)

    wanted = C.saved(spark, members.select("id.node").distinct(), root, "wanted", n_rows * 8)
    sets = C.by_ids(docs.withColumnRenamed("doc_id", "node"), wanted, "node", "left_semi").select(F.col("node").alias("doc_id"), "text").mapInArrow(_full_sets(words), "node long, hi long, lo long, members binary")
    in_bucket = members.select("id.*").distinct()
    sets = C.saved(spark, sets.join(in_bucket, ["node", "hi", "lo"], "left_semi").dropDuplicates(["node", "hi", "lo"]).select(F.struct("node", "hi", "lo").alias("id"), "members"), root, "sets", shingles * 8)

    links, moves, tested = None, [], None
    hubs, dense = 1, False
    for i in range(ROUNDS):
        if i:
            members = _moved(members, moves[-1])
        members = C.saved(spark, _open(members), root, f"open-{i}", n_rows * bands * 40 if i < 2 else None)
        if members.isEmpty():
            break
        if i == 1:
            hubs, texts = HUBS, members.select("id").distinct().count()
            rare = C.saved(spark, _rare_buckets(spark, sets, members, percent, root, shingles * 8), root, "rare")
            if _promised(rare, hubs) > REPEATS * DENSE * texts:
                rare = C.saved(spark, _fine_buckets(spark, sets, rare, percent, root), root, "fine")
            members = rare
        elif i == 2 and dense:
            members = C.saved(spark, _fine_buckets(spark, sets, members, percent, root), root, "fine")
        top, met = _stars(members, hubs, percent)
        swap = F.col("hub") < F.col("id")
        ends = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("hub", "id", "a"), ("id", "hub", "b"), ("hub_comp", "comp", "ca"), ("comp", "hub_comp", "cb"))]
        star = met.select(*ends).distinct()
        if tested is not None:
            star = star.join(tested, ["a", "b"], "left_anti")
        star = C.saved(spark, star, root, f"star-{i}")
        pairs = star.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        found = pairs.select("a", "b", "ca", "cb", "x", "y").mapInArrow(_confirm(percent), PAIRS).where("linked").drop("linked")
        n_star = star.count()
        dense = i == 1 and n_star > DENSE * members.select("id").distinct().count()
        found = C.saved(spark, found, root, f"found-{i}", n_star * (96 + 16 * shingles / max(1, n_rows)))  # what it reads, not what it writes
        tested = star.select("a", "b") if tested is None else tested.union(star.select("a", "b"))
        links = found if links is None else links.union(found)
        # components of components: only what is new is connected
        moves.append(C.components(spark, found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), root, f"comps-{i}", n_star))
        members = members.join(top.select("key", F.col("hub").alias("id")), ["key", "id"], "left_anti")
        hubs *= 32
    else:
        raise RuntimeError(f"near_duplicates: buckets are open after {ROUNDS} rounds")

    out = classes.select("hi", "lo", "copies", F.struct("node", "hi", "lo").alias("id")).withColumn("comp", F.col("id"))
    for m in moves:
        out = _moved(out, m)
    if links is not None:
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
        out = out.join(degree, "id", "left")
    else:
        out = out.withColumn("degree", F.lit(0))
    out = out.select("hi", "lo", F.col("comp.node").alias("comp"), (F.coalesce("degree", F.lit(0)) + F.when(F.col("copies") > 1, 1).otherwise(0)).cast("long").alias("n_links"))
    out = C.saved(spark, out, root, "labels", n_rows * 40)
    C.keep_only(spark, root, "sketch", "labels")
    rows = sketch.select("doc_id", "n_shingles", "hi", "lo")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return (
        rows.join(out, ["hi", "lo"], "left")
        .select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("comp")).alias("component_id"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"))
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "n_links")
    )


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, C.documents(spark, sf_dir), words=3, percent=85)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group (five-word shingles, similarity 0.8 or more): that of the
    smallest doc_id, null ids last, then of the smallest hash. Rows are judged by their own
    texts and named by doc_id and text, so rows of null or repeated doc_ids group like all others,
    and of rows that agree in both one stays. Texts without words (null ones too) are no copies of each other: all
    stay. Other columns stay as they are, and an empty table gives an empty one."""
    root = C.work_dir(spark)
    keyed = C.with_row_key(docs)
    judged = near_duplicates(spark, keyed.select(F.col("_row").alias("doc_id"), "text"))
    judged = C.saved(spark, judged.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("comp")), root, "judged")
    groups = judged.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
    members = C.saved(spark, judged.join(groups, "comp", "left_semi").distinct(), root, "members")
    rows = C.by_ids(keyed.select("doc_id", *C.ROW_KEY), members, "_row", "inner", C.BROADCAST_KEYS)
    rows = C.saved(spark, rows.groupBy("comp", F.col("doc_id").isNull().alias("nameless"), *C.ROW_KEY).agg(F.count("*").alias("n")), root, "rows")
    first = rows.groupBy("comp").agg(F.min(F.struct("nameless", *C.ROW_KEY)).alias("first"))
    rows = C.saved(spark, rows.join(first, "comp").select(*C.ROW_KEY, "n", (F.struct("nameless", *C.ROW_KEY) == F.col("first")).alias("kept")), root, "choice")
    gone = C.saved(spark, rows.where("not kept").select(*C.ROW_KEY).distinct(), root, "gone")
    kept = C.by_ids(keyed, gone, C.ROW_KEY, "left_anti", C.BROADCAST_KEYS)
    again = C.saved(spark, rows.where("kept and n > 1").select(*C.ROW_KEY).distinct(), root, "again")
    if again.isEmpty():
        return kept.select(docs.columns)
    one = C.by_ids(keyed, again, C.ROW_KEY, "left_semi", C.BROADCAST_KEYS).groupBy(*C.ROW_KEY).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x"))
    return C.by_ids(kept, again, C.ROW_KEY, "left_anti", C.BROADCAST_KEYS).select(docs.columns).union(one.select("x.*"))


# ---------------------------------------------------------------- reference for tests


def brute_force(rows: list[tuple[int, str | None]], words: int, percent: int) -> dict[int, int]:
    """component_id of each doc_id by comparing all pairs; for small fixtures only."""
    sets = {i: set(shingle_sets([t], words)[0].tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
