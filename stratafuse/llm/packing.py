"""Operator 11: documents packed into sequences of a fixed capacity, by harmonic classes.

A piece of length n belongs to the reciprocal-capacity class k = capacity // n, so k of its class always
fit, and each bin of the class gets exactly k pieces. That needs no search and no knowledge of
other workers: each task fills its own bins, class by class, and nothing is shuffled.

Documents may be cut. Whole capacities come off first; with ``cut`` the rest is taken apart into
lengths of capacity / k for powers of two k, so that bins of their classes are full to the last token. The
few pieces that are left in a task's last bin of a class form sequences of a power of two pieces,
whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C
from stratafuse.llm import pretokens
from stratafuse.llm.token_store import tokenizer_path

CAPACITY = 4096
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequences that one task can number.
TASK_SEQUENCES = 1 << 40
_encoders: dict[str, pretokens.WordEncoder] = {}


def _encoder(path: str) -> pretokens.WordEncoder:
    if path not in _encoders:
        _encoders[path] = pretokens.WordEncoder(path)
    return _encoders[path]


def cut_lengths(n: np.ndarray, capacity: int, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n tokens, in order: whole capacities, then
    the rest, with ``cut`` by falling powers of two."""
    whole, rest = n // capacity, n % capacity
    doc = [np.repeat(np.arange(len(n)), whole)]
    length = [np.full(int(whole.sum()), capacity)]
    if cut:
        size = capacity >> 1
        while size:
            has = np.flatnonzero(rest & size)
            doc.append(has)
            length.append(np.full(len(has), size))
            size >>= 1
    else:
        has = np.flatnonzero(rest)
        doc.append(has)
        length.append(rest[has])
    d, k = np.concatenate(doc), np.concatenate(length)
    order = np.argsort(d, kind="stable")
    d, k = d[order], k[order]
    total = np.cumsum(k) - k
    first = np.searchsorted(d, np.arange(len(n)))
    return d, total - total[first[d]] if len(d) else total, k


class Bins:
    """Open bins of one worker: for each class the pieces that don't fill a bin yet."""

    def __init__(self, capacity: int, cut: bool, first_id: int):
        self.capacity, self.cut, self.next = capacity, cut, first_id
        self.open: dict[int, pa.Table] = {}

    def _placed(self, pieces: pa.Table, counts: np.ndarray) -> pa.Table:
        """The pieces in sequences of ``counts`` pieces each, gapless from offset 0."""
        length = np.asarray(pieces.column("length"))
        total = np.cumsum(length) - length
        first = np.repeat(total[np.cumsum(counts) - counts], counts)
        ids = np.repeat(self.next + np.arange(len(counts)), counts)
        self.next += len(counts)
        return pieces.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(total - first, pa.int64()))

    def add(self, pieces: pa.Table) -> Iterator[pa.Table]:
        """Pieces of all bins that are full now."""
        of = self.capacity // np.asarray(pieces.column("length"))
        order = np.argsort(of, kind="stable")
        classes, at = np.unique(of[order], return_index=True)
        for k, lo, hi in zip(classes.tolist(), at.tolist(), [*at[1:].tolist(), len(of)], strict=True):
            part = pieces.take(pa.array(order[lo:hi]))
            if k in self.open:
                part = pa.concat_tables([self.open.pop(k), part]).combine_chunks()
            full = len(part) // k
            if full:
                yield self._placed(part.slice(0, full * k), np.full(full, k))
            if len(part) > full * k:
                self.open[k] = part.slice(full * k).take(pa.array(np.arange(len(part) - full * k)))  # its own memory

    def close(self) -> Iterator[pa.Table]:
        """Pieces of the bins that stay open: groups of powers of two equal pieces, or else one bin a class."""
        for _, part in sorted(self.open.items()):
            m = len(part)
            counts = np.array([1 << j for j in range(m.bit_length() - 1, -1, -1) if m >> j & 1] if self.cut else [m])
            yield self._placed(part, counts)
        self.open = {}


def _pack(encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], end_id: int, capacity: int, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bins = Bins(capacity, cut, (context.partitionId() if context else 0) * TASK_SEQUENCES)
        for b in batches:
            flat, at = encode(b.column("text"))
            ids = np.insert(flat.astype("<u4"), at[1:], end_id)
            at = at + np.arange(len(at))
            doc, start, length = cut_lengths(np.diff(at), capacity, cut)
            # pieces lie side by side in the ids, in this order
            edges = np.concatenate([[0], np.cumsum(length)]) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids.tobytes())])
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data, pa.array(np.diff(at)[doc], pa.int64())]
            for t in bins.add(pa.table(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])):
                yield from _batches(t)
        for t in bins.close():
            yield from _batches(t)

    return run


def _batches(t: pa.Table) -> Iterator[pa.RecordBatch]:
    narrow = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in t.schema.names])
    for i in range(0, len(t), 2000):
        yield from t.slice(i, 2000).cast(narrow).combine_chunks().to_batches()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, cut: bool = True) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text, ...) with their place: doc_id, start (ids of the document
    before the piece), length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset. A sequence has at
    most ``capacity`` ids, gapless from offset 0.

    With ``cut`` (for a capacity that is a power of two) every sequence is full or has a power of two ids. Without it only
    documents above the capacity are cut, and the bins of class k hold k pieces, the last of each task fewer.

    Every row is a document that ends with ``end_id``; a null or empty text is that id alone. Null and
    repeated doc_ids and repeated rows are packed like all others; very long texts fill sequences of their own. Other columns
    are ignored; an empty table gives no rows. sequence_ids are unique in one evaluation; store the result before it is used twice
    if its input isn't stored.
    """
    if cut and capacity & (capacity - 1):
        raise ValueError("capacity: must be a power of two where documents are cut")
    C.bounded_batches(docs.sparkSession, 500, 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(lambda column: _encoder(tokenizer).encode(column), end_id, capacity, cut), PACKED)


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(C.documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
