"""Operator 13: the tokens of two vocabularies aligned by the bytes that they cover.

Both vocabularies cut the same bytes (a space and the text). The union of both arrays of token
ends cuts these bytes into elementary intervals; searchsorted finds the one token of each side that owns an
interval, and as no token ends inside an interval each is exactly one overlap of two tokens. Ends on both sides
close a group, the smallest parts that both vocabularies cut alike. Groups aren't multiplied out: tokens of a
group that share no byte are no link.

How often an id pair is linked in the whole corpus is counted within the tasks first. A second pass looks up
the stored links of each document in slices of that table, which tasks read from the shared folder; a slice
is bounded, so a table of any size needs more slices and no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C
from stratafuse.llm import files, pretokens
from stratafuse.llm.token_store import tokenizer_path

#: A pair is a * 2^20 + b, for vocabularies of up to 2^20 ids.
SHIFT = 20
#: Bytes of text that are aligned at once, pairs that a task counts before it passes them on, and pairs of a slice.
BLOCK, HELD, SLICE = 1 << 20, 1 << 20, 8 << 20
LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>, pair long, count long"
_vocabularies: dict[tuple[str, str], Vocabularies] = {}


class Table:
    """Byte strings by number, in one array."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.array([len(x) for x in items], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return pretokens.gather(self.flat, self.at[ids], self.size[ids])


class Vocabularies:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = pretokens.Encoder(path_a, plain=True), pretokens.PieceEncoder(path_b)
        self.bytes_a, self.bytes_b = Table(pretokens.byte_level_bytes(self.a)), Table(self.b.token_bytes())
        n = max(len(self.bytes_a.size), len(self.bytes_b.size))
        if n > 1 << SHIFT:
            raise ValueError(f"vocabulary: {n} ids are more than {1 << SHIFT}")
        self.digits = Table([f"{i},".encode() for i in range(n)])


def _loaded(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _vocabularies:
        _vocabularies[path_a, path_b] = Vocabularies(path_a, path_b)
    return _vocabularies[path_a, path_b]


def _covering(data: np.ndarray, at: np.ndarray, ids: np.ndarray, id_at: np.ndarray, table: Table) -> np.ndarray:
    """Which documents (data[at[i]:at[i + 1]]) their tokens' bytes give back."""
    size = np.diff(at)
    total = np.concatenate([[0], np.cumsum(table.size[ids])])[id_at]
    same = np.diff(total) == size
    joined = table.joined(ids)
    for i in np.flatnonzero(same & (size > 0)).tolist():
        same[i] = np.array_equal(joined[total[i] : total[i + 1]], data[at[i] : at[i + 1]])
    return same


def _chosen(ids: np.ndarray, id_at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the documents to keep, and how many each document has then."""
    count = np.where(keep, np.diff(id_at), 0)
    return ids[np.repeat(keep, np.diff(id_at))].astype(np.int64), count


def owners(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, the token of each side that owns each, and whether the end is shared."""
    ends = np.union1d(ends_a, ends_b)
    ia, ib = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, ia, ib, (ends_a[ia] == ends) & (ends_b[ib] == ends)


def _group_texts(v: Vocabularies, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each document; groups are numbered through all documents."""
    ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, np.concatenate([group_a, group_b])))  # stable: tokens stay in their order
    ids, side = ids[order], side[order]
    text = v.digits.joined(ids).copy()
    ends = np.cumsum(v.digits.size[ids])
    text[ends[:-1][side[:-1] < side[1:]] - 1] = ord("|")
    text[ends[:-1][side[:-1] > side[1:]] - 1] = ord(";")
    whole, at, out = text.tobytes(), 0, []
    for n in (count_a + count_b).cumsum().tolist():
        stop = int(ends[n - 1]) if n else 0
        out.append(whole[at : stop - 1].decode() if stop > at else "")
        at = stop
    return out


def _links(path_a: str, path_b: str):
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in LINKS.split(", ")]

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(path_a, path_b)
        pairs, counts, held = [], [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            pair, group = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.bincount(group, np.concatenate(counts)).astype(np.int64)
            for i in range(0, len(pair), 50_000):
                yield batch({"pair": pa.array(pair[i : i + 50_000]), "count": pa.array(n[i : i + 50_000])}, len(pair[i : i + 50_000]))

        for whole in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0)).astype(np.int64)
            for lo, hi in pretokens.blocks(np.cumsum(size) - size, BLOCK):
                part = whole.slice(lo, hi - lo)
                n, text = len(part), part.column("text")
                text = pc.binary_join_element_wise(pa.scalar(""), pc.fill_null(text, ""), " ")
                data, at = pretokens.utf8(text)
                (a, at_a), (b, at_b) = v.a.encode(text), v.b.encode(text)
                keep = (size[lo:hi] > 0) & _covering(data, at, a, at_a, v.bytes_a) & _covering(data, at, b, at_b, v.bytes_b)
                (a, n_a), (b, n_b) = _chosen(a, at_a, keep), _chosen(b, at_b, keep)
                ends, ia, ib, shared = owners(np.cumsum(v.bytes_a.size[a]), np.cumsum(v.bytes_b.size[b]))
                doc_ends = np.cumsum(np.where(keep, np.diff(at), 0))
                doc = np.searchsorted(doc_ends, ends)
                group = np.cumsum(shared) - shared
                first_a, first_b = np.searchsorted(ia, np.arange(len(a))), np.searchsorted(ib, np.arange(len(b)))
                texts = _group_texts(v, a, b, group[first_a], group[first_b], n_a, n_b)
                pair = (a[ia] << SHIFT) | b[ib]
                order = np.lexsort((pair, doc))
                sorted_pair, sorted_doc = pair[order], doc[order]
                new = np.ones(len(pair), bool)
                new[1:] = (sorted_pair[1:] != sorted_pair[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
                where = np.flatnonzero(new)
                distinct, times = sorted_pair[where], np.diff(where, append=len(pair))
                offsets = pa.array(np.searchsorted(sorted_doc[where], np.arange(n + 1)), pa.int32())
                out = {"row": part.column("row"), "doc_id": part.column("doc_id"), "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64())}
                out |= {"n_groups": pa.array(np.bincount(doc[shared], minlength=n), pa.int64()), "n_links": pa.array(np.bincount(doc, minlength=n), pa.int64()), "groups": pa.array(texts, pa.string())}
                out |= {"pairs": pa.ListArray.from_arrays(offsets, pa.array(distinct, pa.int64())), "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))}
                yield batch(out, n)
                pairs.append(distinct)
                counts.append(times)
                held += len(distinct)
                if held >= HELD:
                    yield from counted()
                    pairs, counts, held = [], [], 0
        if pairs:
            yield from counted()

    return run


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, ...): row (its number), doc_id, n_a, n_b, n_groups, n_links, groups (as
    `a1,a2|b1;a3|b2,b3`), pairs (distinct linked ids, a * 2^20 + b) and times (links of each); and rows of pair, count, which sum
    up to the links of an id pair in all documents.

    A text that is null or empty, or whose tokens' bytes differ from space and text, has no tokens: zeros and ''.
    Null and repeated doc_ids are rows like all others; other columns are ignored."""
    C.bounded_batches(docs.sparkSession, 500, 4)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_links(path_a, path_b), LINKS)


#: A slice without pairs has no folder.
_NO_PAIRS = pa.table({"pair": pa.array([], pa.int64()), "count": pa.array([], pa.int64()), "best": pa.array([], pa.bool_())})
_slices: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _slice(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a slice in order, their counts, and whether each is its b's highest; a worker keeps one slice."""
    if uri not in _slices:
        fs, path = files.open_fs(uri)
        t = pq.read_table(path, filesystem=fs, columns=["pair", "count", "best"], partitioning=None).sort_by("pair") if fs.get_file_info(path).type == pafs.FileType.Directory else _NO_PAIRS
        _slices.clear()
        _slices[uri] = (np.asarray(t.column("pair")), np.asarray(t.column("count")), np.asarray(t.column("best")))
    return _slices[uri]


def _looked_up(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = _slice(uri)
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            n = np.asarray(pc.list_value_length(pairs)).astype(np.int64)
            flat, k = np.asarray(pairs.flatten()), np.asarray(times.flatten()).astype(np.int64)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            found = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            k = np.where(found, k, 0)
            doc = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((k * best[at], k * count[at]) if len(pair) else (k, k))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(s[doc[1:]] - s[doc[:-1]], pa.int64()) for s in sums)], ["row", "n_best", "count_sum"])

    return run


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, slice_pairs: int = SLICE, digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (with ``digest``; else groups) of each row.

    n_best counts the links whose pair has the highest count of all pairs of its b id in the corpus, ties
    included; count_sum sums the counts of all links. Documents without tokens are in no count and have zeros; for the
    other cases see :func:`links`. An empty table gives no rows."""
    root = C.work_dir(spark)
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256") if digest else F.col("groups")
    made = links(docs, path_a, path_b)
    made = C.saved(spark, made.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", groups, "pairs", "times", "pair", "count"), root, "links")
    counts = made.where("pair is not null").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = C.saved(spark, counts.withColumn("b", F.col("pair") % (1 << SHIFT)), root, "counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    n = counts.count()
    slices = max(1, -(-n // slice_pairs))
    marked = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"), F.pmod(F.xxhash64("pair"), F.lit(slices)).alias("slice"))
    marked.repartition(slices, "slice").write.partitionBy("slice").parquet(f"{root}/slices")
    rows = made.where("row is not null")
    found = None
    for i in range(slices):
        part = rows.select("row", "pairs", "times").mapInArrow(_looked_up(f"{root}/slices/slice={i}"), "row long, n_best long, count_sum long")
        found = part if found is None else found.union(part)
    kept = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", made.columns[6])
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return kept.join(found, "row").drop("row")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, C.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
