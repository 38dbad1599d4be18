"""Operator 10: long repeated strings by run-length indexes.

A byte is removed if a LENGTH-byte string that covers it also starts anywhere else. Each such
window is assigned to an anchor, the CONTEXT-byte string inside it of lowest hash
(leftmost on ties), so equal windows have equal anchors and meet under one key. Runs of
windows of one anchor form a piece of text; pieces that are equal as a whole are settled by
counting. What is left, different pieces around one anchor, is indexed: per block of
anchors a Burrows-Wheeler transform is built and run-compressed, with suffix-array
samples at the run ends, and matching statistics stream over the text: inside a run
the match of the previous position just loses a byte, so only run heads are compared.
Crowded anchors get longer contexts first: their windows are taken in ranges, and
what all windows of a range share is the range's own anchor. Ranges are split until few
enough pieces meet around one, which are then indexed like all others.

What is removed is a matter of bytes. Whether a text shares a passage of PASSAGE words with
another row, which often has fewer bytes than LENGTH, is told in a column of its own: the same
pieces, cut from words, are counted, and windows are counted only for rows that no whole piece settles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C

LENGTH, CONTEXT = 400, 200
#: Pieces of one anchor above which it gets longer contexts; bytes of text of an index block.
CROWD, BLOCK = 500, 1 << 20
#: Words of a passage that shares_passage looks for (over 50), and of its anchors.
PASSAGE, PASSAGE_CONTEXT = 51, 16


class Rolled:
    """Hashes of any substrings of an array of bytes, or of hashes of words."""

    def __init__(self, a: np.ndarray):
        up, self.down = C.powers(len(a) + 1)
        self.total = np.zeros(len(a) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((C._BYTE[a] if a.dtype == np.uint8 else a) * up[: len(a)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return C.mix64((self.total[stop] - self.total[start]) * self.down[start])


def _window_minima(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i:i+k]) for each i, by block-wise running minima."""
    n = len(x)
    pad = np.full(-n % k, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, k)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - k + 1], left[k - 1 : n])


def _runs(r: Rolled, starts: np.ndarray, ends: np.ndarray, length: int, context: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor's place in the piece, anchor hash) of all runs of windows of one
    anchor, in texts that lie at starts..ends of what is hashed."""
    n = len(r.total) - 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    at = np.arange(n - context + 1)
    h = r.of(at, at + context)
    low = _window_minima((h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - context + 1)
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (ends - length + 1)[long], -1)
    s = np.flatnonzero(np.cumsum(inside)[: len(low)] > 0)
    if not len(s):
        return none
    p = (low[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
    s0, p0 = s[first], p[first]
    return s0, np.diff(np.append(first, len(s))), p0 - s0, h[p0]


def pieces(texts: list[bytes], length: int, context: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor's place in the piece, anchor hash, piece hash) of
    all runs of windows of one anchor."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    s0, count, lead, anchor = _runs(Rolled(np.frombuffer(data, np.uint8)), starts, ends, length, context)
    view, own = memoryview(data), (lead << 32 | count).tolist()
    # pieces are named by what they hold: a hash of their bytes, and the anchor's place in them
    piece = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e], o) for s, e, o in zip(s0.tolist(), (s0 + count - 1 + length).tolist(), own, strict=True)), np.uint64, len(s0))
    text = np.searchsorted(ends, s0, "right")
    return text, s0 - starts[text], count, lead, anchor, piece


PIECES = "rid long, uid long, first int, windows int, lead int, anchor long, piece long"


def _pieces(length: int, context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, first, count, lead, anchor, piece = pieces([t.encode() if t else b"" for t in b.column("text").to_pylist()], length, context)
            row = pa.array(text, pa.int64())
            cols = [b.column(c).take(row) for c in ("rid", "uid")] + [pa.array(x, pa.int32()) for x in (first, count, lead)] + [pa.array(x.view(np.int64), pa.int64()) for x in (anchor, piece)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PIECES.split(", ")])

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a few strings, with sampled run ends."""

    def __init__(self, strings: list[bytes]):
        """No match crosses a string's end: ends sort before all bytes and are all different."""
        a = np.frombuffer(b"".join(x + b"\0" for x in strings), np.uint8).astype(np.int64) + 1
        stops = np.cumsum([len(x) + 1 for x in strings]) - 1
        n = len(a)
        a[stops] = 0
        self.text, self.n = a, n
        self.left = np.repeat(stops, np.diff(np.concatenate([[-1], stops]))) - np.arange(n)  # bytes to the string's end
        # prefix doubling from the first seven symbols on; what runs past an end differs by that end
        own_end = -np.repeat(np.arange(len(stops)), np.diff(np.concatenate([[-1], stops]))) - 1
        at, k, rank = np.arange(n), 7, np.zeros(n, np.int64)
        for j in range(k):
            rank = rank * 257 + np.where(self.left >= j, a[np.minimum(at + j, n - 1)], 0)
        rank = np.unique(rank, return_inverse=True)[1]
        while True:
            after = np.where(self.left >= k, rank[np.minimum(at + k, n - 1)], own_end)
            both = rank * (n + len(stops) + 1) + after + len(stops)
            order = np.argsort(both)
            ranked = both[order]
            new = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            k *= 2
            if new[-1] == n - 1:
                break
        symbol = a[order - 1]  # the transform; position 0 is preceded by the last end
        heads = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]) | (symbol == 0))
        self.runs = len(heads)
        # samples: each run's first suffix, and the suffix above it, which is the last of the run before
        self.head = order[heads]
        self.above = np.where(heads > 0, order[heads - 1], -1)

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position, the suffix above its own in sorted order (-1: none) and the
        length of their match, streamed in text order from the run heads."""
        by = np.argsort(self.head)
        head, above = self.head[by], self.above[by]
        r = Rolled((self.text % 256).astype(np.uint8))
        lo, hi = np.zeros(len(head), np.int64), np.where(above >= 0, np.minimum(self.left[head], self.left[np.maximum(above, 0)]), 0)
        other = np.maximum(above, 0)
        while (lo < hi).any():  # longest common prefix of each head and its sample
            mid = (lo + hi + 1) // 2
            same = r.of(head, head + mid) == r.of(other, other + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        at = np.arange(self.n)
        last = np.searchsorted(head, at, "right") - 1
        gone = at - head[np.maximum(last, 0)]
        ok = (last >= 0) & (above[np.maximum(last, 0)] >= 0)
        length = np.where(ok, np.maximum(lo[np.maximum(last, 0)] - gone, 0), 0)
        return np.where(ok & (length > 0), above[np.maximum(last, 0)] + gone, -1), length


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes start elsewhere in the strings too."""
    index = RunLengthIndex(strings)
    above, match = index.matches()
    hit = np.flatnonzero(match >= length)
    again = np.zeros(index.n, bool)
    again[hit] = True
    again[above[hit]] = True
    out, at = [], 0
    for x in strings:
        out.append(again[at : at + max(0, len(x) - length + 1)])
        at += len(x) + 1
    return out


def _spans(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist()


def _cut_out(length: int):
    """Texts and the pieces wanted of them (first, windows, ...) into rows with the piece's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                data = text.encode()
                rows += [(w["anchor"], w["piece"], w["lead"], data[w["first"] : w["first"] + w["windows"] - 1 + length]) for w in wanted]
                if len(rows) > 2000:
                    yield _cut_rows(rows)
                    rows = []
            yield _cut_rows(rows)

    return run


CUT = "anchor long, piece long, lead int, data binary"


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.binary()])], ["anchor", "piece", "lead", "data"])


SETTLED = "anchor long, piece long, spans array<int>"
FOUND = "at struct<anchor:long,piece:long,first:int>, spans array<int>"


def _index(length: int):
    """Rows (group, at, data) sorted by group, in blocks of whole groups, through run-length indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            found = [(p, _spans(f)) for (_, p, _), f in zip(held, repeated_starts([x for *_, x in held], length), strict=True) if f.any()]
            kind = pa.struct([("anchor", pa.int64()), ("piece", pa.int64()), ("first", pa.int32())])
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], kind), pa.array([r[1] for r in found], pa.list_(pa.int32()))], ["at", "spans"])

        for b in batches:
            for group, piece, data in zip(*(b.column(c).to_pylist() for c in ("group", "at", "data")), strict=True):
                if size >= BLOCK and held[-1][0] != group:
                    yield settle()
                    held, size = [], 0
                held.append((group, piece, data))
                size += len(data)
        if held:
            yield settle()

    return run


#: Parts into which a range of windows is split a round, and rounds after which one of many would hold a window.
PARTS, ROUNDS = 4, 32
RANGE = "anchor long, piece long, low int, high int, first int, last int, core long, span long, data binary"


def _split_ranges(length: int):
    """Pieces with a range of windows (low..high, counted from the anchor) into its parts, with a hash
    of the bytes that all windows of a part share, one of the bytes that they span, and these bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            out = []
            for anchor, piece, lead, data, ranges in zip(*(b.column(c).to_pylist() for c in ("anchor", "piece", "lead", "data", "ranges")), strict=True):
                n = len(data) - length + 1
                for x in ranges:
                    low, high = x["low"], x["high"]
                    step = max(1, -(-(high - low + 1) // PARTS))
                    for lo in range(low, high + 1, step):
                        hi = min(high, lo + step - 1)
                        first, last = max(lo + lead, 0), min(hi + lead, n - 1)  # windows of the piece in the part
                        if first <= last:
                            held = data[first : last + length]
                            core, span = (xxhash.xxh3_64_intdigest(y) - (1 << 63) for y in (data[hi + lead : lo + lead + length], held))
                            out.append((anchor, piece, lo, hi, first, last, core, span, held))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], [x.split()[0] for x in RANGE.split(", ")])

    return run


def _crowded_groups(spark: SparkSession, cut: DataFrame, length: int, context: int, crowd: int, root: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(settled, groups) of the pieces of crowded anchors: spans of windows that repeat (anchor, piece,
    first, last), and smaller groups (group, at, data) for the index.

    Windows are taken in ranges. What all windows of a range share must occur in two pieces, else
    none of them repeats; if all that they span does, all of them repeat. Where few pieces
    share it, they are a group of their own; other ranges are split."""
    cut = C.saved(spark, cut, root, "crowd")
    live = cut.select("anchor", "piece", F.array(F.struct(F.lit(context - length).alias("low"), F.lit(0).alias("high"))).alias("ranges"))
    settled = groups = None
    part = ["anchor", "low", "high", "core"]
    for i in range(ROUNDS):
        if live.isEmpty():
            return settled, groups
        parts = C.saved(spark, cut.join(live, ["anchor", "piece"]).select("anchor", "piece", "lead", "data", "ranges").mapInArrow(_split_ranges(length), RANGE), root, f"parts-{i}")
        spans = parts.groupBy(*part, "span").agg(F.count("*").alias("same"), F.min("piece").alias("witness"))
        cores = spans.groupBy(*part).agg(F.sum("same").alias("n"), F.count("*").alias("kinds")).where("n > 1").drop("n")
        spans = spans.join(cores, part)
        parts = C.saved(spark, parts.join(spans, [*part, "span"]), root, f"judged-{i}")
        done = parts.where("same > 1 or low = high").select("anchor", "piece", "first", "last")
        settled = done if settled is None else settled.union(done)
        # of settled pieces one goes on for the others to be compared with
        others = parts.where("kinds > 1 and low < high and (same = 1 or piece = witness)")
        small = others.where(F.col("kinds") <= crowd).select(F.xxhash64(*part).alias("group"), F.struct("anchor", "piece", "first").alias("at"), "data")
        groups = small if groups is None else groups.union(small)
        live = others.where(F.col("kinds") > crowd).groupBy("anchor", "piece").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    raise RuntimeError(f"repeats: ranges of windows are open after {ROUNDS} rounds")


WORD_PIECES = "rid long, uid long, first int, windows int, anchor long, piece long"
WINDOWS = "rid long, uid long, window long, weight int"


def _word_pieces(words: int, context: int):
    """Pieces of windows of so many words, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = C.word_hashes([t.encode() for t in b.column("text").to_pylist()])
            r = Rolled(h)
            s0, count, lead, anchor = _runs(r, at[:-1], at[1:], words, context)
            with np.errstate(over="ignore"):
                piece = C.mix64(r.of(s0, s0 + count - 1 + words) + (lead << 32 | count).astype(np.uint64))
            text = np.searchsorted(at[1:], s0, "right")
            by = np.lexsort((piece, text))
            by = by[(np.diff(text[by], prepend=-1) != 0) | (piece[by] != np.roll(piece[by], 1))]
            row = pa.array(text[by], pa.int64())
            cols = [b.column(c).take(row) for c in ("rid", "uid")] + [pa.array(x[by], pa.int32()) for x in (s0 - at[text], count)] + [pa.array(x[by].view(np.int64), pa.int64()) for x in (anchor, piece)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in WORD_PIECES.split(", ")])

    return run


def _word_windows(words: int):
    """All windows of the pieces wanted of a text, each once a row; weight: rows that hold it, 2 if more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, uid, text, wanted in zip(*(b.column(c).to_pylist() for c in ("rid", "uid", "text", "wanted")), strict=True):
                r = Rolled(C.word_hashes([text.encode()])[0])
                at = np.concatenate([np.arange(w["first"], w["first"] + w["windows"]) for w in wanted])
                weight = np.repeat([w["weight"] for w in wanted], [w["windows"] for w in wanted])
                window, which = np.unique(r.of(at, at + words), return_inverse=True)
                most = np.zeros(len(window), np.int32)
                np.maximum.at(most, which, weight)
                n = len(window)
                yield pa.RecordBatch.from_arrays([pa.array([rid] * n, pa.int64()), pa.array([uid] * n, pa.int64()), pa.array(window.view(np.int64), pa.int64()), pa.array(most, pa.int32())], [x.split()[0] for x in WINDOWS.split(", ")])

    return run


def passage_rows(spark: SparkSession, docs: DataFrame, words: int, context: int, root: str) -> DataFrame:
    """(rid, uid) of the ``docs`` (rid, uid, text) that share a run of ``words`` words with another row.

    Equal windows have equal anchors, so only pieces around one anchor can share one. Pieces
    that two rows hold settle both; of the anchors of rows that none settles, one copy of each
    piece gives its windows, which are counted. Both are sums: no pairs are made, however many rows meet."""
    row, key = ["rid", "uid"], ["anchor", "piece"]
    found = docs.where(F.octet_length("text") >= 2 * words - 1).select(*row, "text").mapInArrow(_word_pieces(words, context), WORD_PIECES)
    found = C.saved(spark, found, root, "word-pieces")
    # most anchors occur once: what is wide goes on without them
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    found = C.saved(spark, found.join(often, "anchor", "left_semi").select(found.columns), root, "word-often")
    classes = found.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*row, "first", "windows")).alias("at"))
    classes = C.saved(spark, classes, root, "word-classes")
    several = classes.join(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchor")
    several = C.saved(spark, several.select("anchor", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"), "at.*"), root, "word-kinds")
    whole = C.saved(spark, found.join(classes.where("n > 1").select(*key), key, "left_semi").select(*row).distinct(), root, "word-whole")

    anchors = several.where("weight = 1").join(whole, row, "left_anti").select("anchor").distinct()
    wanted = several.join(anchors, "anchor", "left_semi").groupBy(*row).agg(F.collect_list(F.struct("first", "windows", "weight")).alias("wanted"))
    wanted = C.saved(spark, wanted, root, "word-wanted")
    texts = C.by_ids(docs.select(*row, "text"), wanted.select(*row), row, "left_semi", C.BROADCAST_KEYS).dropDuplicates(row)
    windows = C.saved(spark, texts.join(wanted, row).select(*row, "text", "wanted").mapInArrow(_word_windows(words), WINDOWS), root, "word-windows")
    shared = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    partly = windows.join(shared, "window", "left_semi").select(*row)
    return C.saved(spark, whole.union(partly).distinct(), root, "passages")


DIGEST = "rid long, uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean, kept binary"


def _remove(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, uid, doc, text, marks in zip(*(b.column(c).to_pylist() for c in ("rid", "uid", "doc_id", "text", "marks")), strict=True):
                data = text.encode()
                edge = np.zeros(len(data) + 1, np.int32)
                for m in marks:
                    s = np.asarray(m["spans"], np.int64) + m["first"]
                    np.add.at(edge, s[0::2], 1)
                    np.add.at(edge, s[1::2] - 1 + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((rid, uid, doc, len(data), int(gone.sum()), len(_spans(gone)) // 2, hashlib.sha256(kept).hexdigest(), bool(gone.any()), kept if keep else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*[pa.int64()] * 6, pa.string(), pa.bool_(), pa.binary()])], [x.split()[0] for x in DIGEST.split(", ")])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, context: int = CONTEXT, keep_bytes: bool = False, crowd: int = CROWD, passage: int = PASSAGE, passage_context: int = PASSAGE_CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, kept, shares_passage for each row of ``docs`` (doc_id, text, ...).

    Texts are UTF-8 bytes (null: empty); every byte covered by a ``length``-byte string that also
    starts elsewhere (in another row or the same text) is removed, n_spans counts the
    maximal removed runs, kept_sha256 is of the bytes that remain, repeated says whether any
    were removed, and kept holds the rest if ``keep_bytes`` is set (a run may end inside a
    character). shares_passage says whether ``passage`` words in a row, whatever separates them, also
    are in another row; it doesn't change what is removed. Repeated rows repeat each other; a null doc_id is an id like all others. Other
    columns are ignored; an empty table gives an empty result.
    """
    C.bounded_batches(spark, 1000, 2)
    root = C.work_dir(spark)
    row, key = ["rid", "uid"], ["anchor", "piece"]
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"rid": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "uid": F.xxhash64("doc_id", "text")})
    found = C.saved(spark, docs.where(F.octet_length("text") >= length).select(*row, "text").mapInArrow(_pieces(length, context), PIECES), root, "pieces")
    classes = found.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*row, "first", "windows", "lead")).alias("at"))
    classes = C.saved(spark, classes, root, "all-classes")
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    classes = classes.join(kinds, "anchor", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))).where("kinds > 1 or n > 1")
    classes = C.saved(spark, classes.select(*key, "n", "kinds", "at.*"), root, "classes")

    # pieces that differ around one anchor: one copy of each is cut out of its text
    several = classes.where("kinds > 1")
    wanted = C.saved(spark, several.groupBy(*row).agg(F.collect_list(F.struct(*key, "first", "windows", "lead")).alias("wanted")), root, "wanted")
    texts = C.by_ids(docs.select(*row, "text"), wanted.select(*row), row, "left_semi", C.BROADCAST_KEYS).dropDuplicates(row)
    cut = C.saved(spark, texts.join(wanted, row).select("text", "wanted").mapInArrow(_cut_out(length), CUT), root, "cut")
    crowded = C.saved(spark, several.where(F.col("kinds") > crowd).select("anchor").distinct(), root, "crowded")
    groups = cut.join(crowded, "anchor", "left_anti").select(F.col("anchor").alias("group"), F.struct("anchor", "piece", F.lit(0).alias("first")).alias("at"), "data")
    counted, more = _crowded_groups(spark, cut.join(crowded, "anchor", "left_semi"), length, context, crowd, root)
    if more is not None:
        groups = groups.union(more)
    indexed = groups.repartition("group").sortWithinPartitions("group", "at").mapInArrow(_index(length), FOUND)
    spans = indexed.select("at.anchor", "at.piece", F.transform("spans", lambda x: x + F.col("at.first")).alias("spans"))
    if counted is not None:
        spans = spans.union(counted.select(*key, F.array("first", F.col("last") + 1)))
    partly = C.saved(spark, spans.groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans")), root, "settled")

    # all windows of a piece with several copies repeat; of the others those that were found
    whole = classes.where("n > 1").select(*key, F.array(F.lit(0), F.col("windows")).alias("spans"))
    single_copy = partly.join(classes.where("n > 1"), key, "left_anti")
    marks = found.join(whole.union(single_copy), key).groupBy(*row).agg(F.collect_set(F.struct("first", "spans")).alias("marks"))
    marks = C.saved(spark, marks, root, "marks")
    passages = passage_rows(spark, docs, passage, passage_context, root)
    C.keep_only(spark, root, "marks", "passages")
    ids = marks.select(*row)
    touched = C.by_ids(docs, ids, row, "left_semi", C.BROADCAST_KEYS).join(marks, row).select(*row, "doc_id", "text", "marks").mapInArrow(_remove(length, keep_bytes), DIGEST)
    clean = C.by_ids(docs, ids, row, "left_anti", C.BROADCAST_KEYS)
    data = F.encode("text", "UTF-8")
    clean = clean.select(*row, "doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), F.lit(False).alias("repeated"), (data if keep_bytes else F.lit(None).cast("binary")).alias("kept"))
    few = passages.count() <= C.BROADCAST_KEYS
    passages = passages.withColumn("shares_passage", F.lit(True))
    out = touched.union(clean).join(F.broadcast(passages) if few else passages.hint("merge"), row, "left")
    return out.drop(*row).withColumn("shares_passage", F.coalesce("shares_passage", F.lit(False)))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, C.documents(spark, sf_dir)).drop("kept")


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 by counting all windows; for small fixtures."""
    data = {i: (t or "").encode() for i, t in rows}
    count: dict[bytes, int] = {}
    for d in data.values():
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            count[w] = count.get(w, 0) + 1
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out[i] = (len(d), int(gone.sum()), len(_spans(gone)) // 2, hashlib.sha256(kept).hexdigest())
    return out
