"""Operator 5: benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (runs of MIN_TILE words). For each
such pair the longest common runs of words are marked again and again, longest first and
without overlap, by running Karp-Rabin: hashes of all windows of a length are looked
up, matches confirmed word by word and marked, and the length shrinks. A pair is a leak if
the tiles cover enough of the item, wherever and in whatever order they stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C

MIN_TILE = 4
#: Pairs of equal windows of an item and a text that are held at once.
MOST_PAIRS = 1 << 20
#: Share of an item's words, in percent, that tiles must cover.
COVER = 60
#: Benchmarks of at most this many bytes of text are broadcast; larger ones are joined on their seeds by a shuffle.
BROADCAST_BYTES = 32 << 20
_PUNCTUATION = bytes(32 if not chr(i).isalnum() and i < 128 else i for i in range(256))
LEAKS = "doc_id long, item_id long, n_item_words long, covered long, n_tiles long"


def normal(text: str | None) -> bytes:
    """The text in lower case; ASCII punctuation separates like white space."""
    return text.lower().encode().translate(_PUNCTUATION) if text else b""


def _runs(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, item start, doc start) of the maximal common runs of ``size`` unmarked words or more."""
    if min(len(item), len(doc)) < size:
        return []
    ok_i = np.flatnonzero(np.convolve(free_i, np.ones(size, np.int64), "valid") == size)
    ok_d = np.flatnonzero(np.convolve(free_d, np.ones(size, np.int64), "valid") == size)
    hi, hd = C.window_hashes(item, size)[ok_i], C.window_hashes(doc, size)[ok_d]
    order = np.argsort(hd, kind="stable")
    lo, hi_end = np.searchsorted(hd[order], hi), np.searchsorted(hd[order], hi, "right")
    n = hi_end - lo

    def pairs(rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(item start, doc start) of all equal windows of some rows of ok_i."""
        m, first = n[rows], lo[rows]
        return np.repeat(ok_i[rows], m), ok_d[order[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())]] if m.sum() else np.zeros(0, np.int64)

    if n.sum() <= MOST_PAIRS:
        i, d = pairs(slice(None))
        by = np.lexsort((i, d - i))
        i, d = i[by], d[by]
        new = np.flatnonzero(np.diff(i, prepend=-9) + 1000003 * np.abs(np.diff(d - i, prepend=1 << 40)) != 1)
        lengths = np.diff(np.append(new, len(i))) + size - 1
        i, d = i[new], d[new]
    else:  # texts that repeat the same words: a part of the pairs at a time, of which only the starts of runs are kept
        starts = []
        edges = np.searchsorted(np.cumsum(n), np.arange(MOST_PAIRS, n.sum() + MOST_PAIRS, MOST_PAIRS), "right") + 1
        for a, b in zip(np.concatenate([[0], edges]), edges, strict=False):
            i, d = pairs(slice(int(a), int(b)))
            before = (i > 0) & (d > 0)
            before[before] = (item[i[before] - 1] == doc[d[before] - 1]) & free_i[i[before] - 1] & free_d[d[before] - 1]
            starts.append((i[~before], d[~before]))
        i, d = (np.concatenate([x[k] for x in starts]) for k in (0, 1))
        lengths, live = np.full(len(i), size), np.arange(len(i))
        while len(live):
            x, y = i[live] + lengths[live], d[live] + lengths[live]
            ok = (x < len(item)) & (y < len(doc))
            x, y = np.minimum(x, len(item) - 1), np.minimum(y, len(doc) - 1)
            live = live[ok & (item[x] == doc[y]) & free_i[x] & free_d[y]]
            lengths[live] += 1
    return [(k, x, y) for k, x, y in zip(lengths.tolist(), i.tolist(), d.tolist(), strict=True) if np.array_equal(item[x : x + k], doc[y : y + k])]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of the greedy tiling of two sequences of word hashes:
    longest first (then first in the item, then in the document), without overlap. The search
    length halves from pass to pass, as in running Karp-Rabin matching."""
    free_i, free_d, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    size = max(least, len(item))
    while True:
        heap = [(-k, i, d) for k, i, d in _runs(item, doc, free_i, free_d, size)]
        heapq.heapify(heap)
        while heap:
            k, i, d = heapq.heappop(heap)
            free = free_i[i : i - k] & free_d[d : d - k]
            if free.all():
                free_i[i : i - k] = free_d[d : d - k] = False
                out.append((i, d, -k))
            else:  # what is left of it goes back
                edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
                for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    if e - s >= size:
                        heapq.heappush(heap, (s - e, i + s, d + s))
        if size == least:
            return out
        size = max(least, size // 2)


class Index:
    """Benchmark items in arrays: sorted seed hashes, their items, and each item's word hashes."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int = MIN_TILE):
        rows = [(i, t) for i, t in rows if i is not None]
        h, at = C.word_hashes([normal(t) for _, t in rows])
        kept = [(i, h[a:b]) for (i, _), a, b in zip(rows, at[:-1], at[1:], strict=True) if b > a]
        self.least, self.ids, self.words = least, [i for i, _ in kept], [w for _, w in kept]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {min(least, len(w)) for w in self.words}:
            owners = [n for n, w in enumerate(self.words) if min(least, len(w)) == size]
            sets = [np.unique(C.window_hashes(self.words[n], size)) for n in owners]
            flat, owner = np.concatenate(sets), np.repeat(owners, [len(x) for x in sets])
            order = np.argsort(flat, kind="stable")
            self.seeds[size] = flat[order], owner[order]

    def candidates(self, h: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a seed; text n has the words h[at[n]:at[n + 1]]."""
        out: set[tuple[int, int]] = set()
        for size, (seeds, owner) in self.seeds.items():
            w = C.window_hashes(h, size)
            lo = np.searchsorted(seeds, w)
            hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == w)
            text = np.searchsorted(at, hit, "right") - 1
            inside = hit + size <= at[text + 1]
            hit, text = hit[inside], text[inside]
            end = np.searchsorted(seeds, w[hit], "right")
            for t, a, b in zip(text.tolist(), lo[hit].tolist(), end.tolist(), strict=True):
                out.update((t, n) for n in owner[a:b].tolist())
        return out


def leak_of(item: np.ndarray, doc: np.ndarray, cover: int = COVER, least: int = MIN_TILE) -> tuple[int, int] | None:
    """(covered words, tiles) if the tiling covers ``cover`` percent of the item, else None."""
    least = min(least, len(item))
    seen = np.flatnonzero(np.isin(C.window_hashes(item, least), C.window_hashes(doc, least)))
    reach = np.zeros(len(item) + 1, np.int64)
    np.add.at(reach, seen, 1)
    np.add.at(reach, seen + least, -1)
    if 100 * np.count_nonzero(np.cumsum(reach)[:-1]) < cover * len(item):
        return None  # even overlapping seeds cover too little
    found = tiles(item, doc, least)
    covered = sum(n for *_, n in found)
    return (covered, len(found)) if 100 * covered >= cover * len(item) else None


def _leaks_of(pairs: list[tuple[int, int, int, int, int]], ids: pa.DataType = pa.int64()) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], ids) for i in range(5)], ["doc_id", "item_id", "n_item_words", "covered", "n_tiles"])


def _against(index, cover: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: Index = index.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            h, at = C.word_hashes([normal(t) for t in b.column("text").to_pylist()])
            out = []
            for t, i in sorted(idx.candidates(h, at)):
                if got := leak_of(idx.words[i], h[at[t] : at[t + 1]], cover, idx.least):
                    out.append((ids[t], idx.ids[i], len(idx.words[i]), *got))
            yield _leaks_of(out)

    return run


def _free_of(index, cover: int):
    """The rows that no item leaks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: Index = index.value
        for b in batches:
            h, at = C.word_hashes([normal(t) for t in b.column("text").to_pylist()])
            free = np.ones(b.num_rows, bool)
            for t, i in sorted(idx.candidates(h, at)):
                if free[t] and leak_of(idx.words[i], h[at[t] : at[t + 1]], cover, idx.least):
                    free[t] = False
            yield b.filter(pa.array(free))

    return run


def _seeds(sizes: tuple[int, ...] | None):
    """Seed hashes of texts: runs of each of ``sizes`` words; None: of a tile, or of the whole text if it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for t in b.column("text").to_pylist():
                h = C.word_hashes([normal(t)])[0]
                own = sizes or ((min(MIN_TILE, len(h)),) if len(h) else ())
                keys.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *[C.window_hashes(h, k) ^ np.uint64(k) for k in own]])).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in keys], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "seeds"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = {min(MIN_TILE, n) for n in np.diff(C.word_hashes([normal(t) for t in b.column("text").to_pylist()])[1]).tolist() if n}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(counts), pa.int64())], ["size"])


def _tile_pairs(cover: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, i, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "item")), strict=True):
                item, doc = C.word_hashes([normal(y)])[0], C.word_hashes([normal(x)])[0]
                if got := leak_of(item, doc, cover):
                    out.append((d, i, len(item), *got))
            yield _leaks_of(out)

    return run


def _index(spark: SparkSession, bench: DataFrame, broadcast_bytes: int):
    """The broadcast index of a benchmark of at most so many bytes, else None."""
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return spark.sparkContext.broadcast(Index([tuple(r) for r in bench.collect()])) if total <= broadcast_bytes else None


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cover: int = COVER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_words, covered, n_tiles): the leaks of benchmark items
    (item_id, text) in ``docs`` (doc_id, text, ...), one row for each pair whose tiles cover
    ``cover`` percent of the item's words.

    Null and empty texts on either side leak nothing, nor do items with a null item_id; a
    null doc_id is reported as such, and repeated rows are reported once for each. Items
    with fewer than MIN_TILE words must occur whole. Other columns are ignored; empty
    tables give an empty result. A benchmark within ``broadcast_bytes`` goes to the
    executors; beyond that both sides meet by a shuffle on their seeds, and texts join the
    candidate pairs afterwards.
    """
    C.bounded_batches(spark)
    docs, bench = docs.select(F.col("doc_id").cast("long"), "text"), benchmark.select(F.col("item_id").cast("long"), "text")
    index = _index(spark, bench, broadcast_bytes)
    if index:
        return docs.mapInArrow(_against(index, cover), LEAKS)
    root = C.work_dir(spark)
    # rows meet their pairs by a digest of id and text, so null and repeated ids are kept apart
    docs = docs.where("text is not null").withColumn("uid", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")))
    bench = bench.where("item_id is not null")
    # only items shorter than a tile ask for shorter seeds: at most MIN_TILE lengths
    lengths = tuple(sorted(r[0] for r in bench.select("text").mapInArrow(_sizes, "size long").distinct().collect()))
    have = docs.select(F.col("uid").alias("id"), "text").mapInArrow(_seeds(lengths or (MIN_TILE,)), "id string, n long, seeds array<long>").select(F.col("id").alias("uid"), F.explode("seeds").alias("seed"))
    want = bench.select(F.col("item_id").alias("id"), "text").mapInArrow(_seeds(None), "id long, n long, seeds array<long>").select(F.col("id").alias("item_id"), F.explode("seeds").alias("seed"))
    pairs = C.saved(spark, have.join(want, "seed").select("uid", "item_id").distinct(), root, "pairs")
    both = pairs.join(docs, "uid").join(bench.withColumnRenamed("text", "item"), "item_id")
    return both.select("doc_id", "item_id", "text", "item").mapInArrow(_tile_pairs(cover), LEAKS)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, C.documents(spark, sf_dir), C.documents(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents without a leak of any benchmark item. Each row is judged by its own text,
    whether its doc_id is null, repeated or neither. Null and empty texts leak nothing and stay, as everything does
    without items; other columns stay as they are, and an empty table gives an empty one."""
    bench = C.documents(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    C.bounded_batches(spark)
    index = _index(spark, bench, broadcast_bytes)
    if index:
        return docs.mapInArrow(_free_of(index, COVER), docs.schema)
    keyed = C.with_row_key(docs)
    # leaks come back by the hash of doc_id and text
    leaks = find_leaks(spark, keyed.select(F.col("_row").alias("doc_id"), "text"), bench, COVER, broadcast_bytes)
    gone = C.saved(spark, leaks.select(F.col("doc_id").alias("_row")).distinct(), C.work_dir(spark), "leaks")
    return C.by_ids(keyed, gone, "_row", "left_anti").select(docs.columns)
