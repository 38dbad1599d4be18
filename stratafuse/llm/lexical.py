"""Operator 12: ranked lexical search over term-bucketed postings.

Terms are cut from whole texts by array operations on their bytes; a posting is a row of term, its bucket,
document, the document's terms and the term's occurrences. Postings stay beside the others of their document, so
that the sums of a search meet within their task before anything is shuffled. Weights and scores are integers: they don't
depend on the order of sums.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafuse.llm import common as C
from stratafuse.llm import pretokens

TOP = 20
#: Buckets of terms; the bucket and the term are the key of every join.
BUCKETS = 256
#: Terms of a search that are broadcast at most; beyond, postings and terms are joined by a shuffle on their buckets.
BROADCAST_TERMS = C.BROADCAST_BYTES // 128
#: Bytes of text whose terms are counted at once.
BLOCK = 1 << 20
POSTINGS = "row long, doc_id long, n long, term string, tf long, documents long"

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _plain_counts(a: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, document and occurrences of each term of each document, by a dictionary."""
    data, first = a.tobytes(), {}
    count: Counter = Counter()
    for i, (s, k, d) in enumerate(zip(start.tolist(), size.tolist(), doc.tolist(), strict=True)):
        key = (d, data[s : s + k])
        first.setdefault(key, i)
        count[key] += 1
    where = np.fromiter(first.values(), np.int64, len(first))
    return where, doc[where], np.fromiter((count[k] for k in first), np.int64, len(first))


def term_counts(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts a[at[i]:at[i + 1]] (lower-cased bytes): start and size of each distinct term of each text, its text, its
    occurrences there; and the terms of each text with repeats."""
    inside = _IS_TERM[a]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = np.flatnonzero(np.diff(at))  # terms don't go on from one text to the next
    begin[at[some]], end[at[some + 1] - 1] = inside[at[some]], inside[at[some + 1] - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size = stop - start
    doc = np.searchsorted(at, start, "right") - 1
    n = np.bincount(doc, minlength=len(at) - 1)
    if not len(start):
        return start, size, doc, size, n
    lo, hi = pretokens.keys(a, start, size)
    h = C.mix64(lo ^ C.mix64(hi + size.astype(np.uint64)))
    long = np.flatnonzero(size > 16)
    if len(long):
        h[long] = [int.from_bytes(hashlib.blake2b(a[s : s + k].tobytes(), digest_size=8).digest(), "little") for s, k in zip(start[long].tolist(), size[long].tolist(), strict=True)]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if (same & ((lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]) | (size[order][1:] != size[order][:-1]))).any():
        where, of, tf = _plain_counts(a, start, size, doc)  # two terms share a hash
    else:
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        where, tf = order[heads], np.diff(heads, append=len(order))
        of = doc[where]
    return start[where], size[where], of, tf, n


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = pretokens.utf8(b.column("text"))
        for lo, hi in pretokens.blocks(at[:-1], BLOCK):
            a = _LOWER[data[at[lo] : at[hi]]]
            start, size, of, tf, n = term_counts(a, at[lo : hi + 1] - at[lo])
            rows = b.slice(lo, hi - lo)
            # terms are copied out one after the other
            edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            terms = pa.StringArray.from_buffers(len(size), pa.py_buffer(edges), pa.py_buffer(pretokens.gather(a, start, size).tobytes()))
            take = pa.array(of)
            names = ["row", "doc_id", "n", "term", "tf", "documents"]
            yield pa.RecordBatch.from_arrays([rows.column("row").take(take), rows.column("doc_id").take(take), pa.array(n[of], pa.int64()), terms, pa.array(tf, pa.int64()), pa.nulls(len(of), pa.int64())], names)
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array([int(n.sum())], pa.int64()), none[2], none[3], pa.array([int((n > 0).sum())], pa.int64())], names)


def postings(docs: DataFrame) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text, ...) a row a distinct term: bucket, term, row (its number), doc_id, n (terms of the
    document, with repeats), tf. Rows without a term hold, for many documents at once, the documents with a term
    (``documents``) and all their terms (n).

    Null and empty texts have no term; null and repeated doc_ids are documents of their own; other columns are
    ignored. An empty table gives no rows."""
    C.bounded_batches(docs.sparkSession, 500, 4)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_postings, POSTINGS).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """The ``top`` highest-scoring documents for each row of ``items`` (item_id, text, ...): item_id, rank (from 1), doc_id,
    score; only scores above 0, equal ones by ascending doc_id (null first; rows of one doc_id by their place).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums weight * ((10^9 tf) div (1000 tf + 12 m))
    over the item's terms with repeats, m = 75 + (25 n N) div L. Items without terms find nothing; rows of equal
    item_id are ranked each by itself. Empty tables give no rows."""
    root = C.work_dir(spark)
    wanted = postings(items.select(F.col("item_id").alias("doc_id"), "text"))
    wanted = wanted.where("term is not null").select("bucket", "term", F.col("row").alias("item"), F.col("doc_id").alias("item_id"), F.col("tf").alias("times"))
    wanted = C.saved(spark, wanted, root, "items")
    vocabulary = wanted.select("bucket", "term").distinct().withColumn("known", F.lit(True))
    few = vocabulary.count() <= broadcast_terms
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    # the summary rows have no term and pass the join
    hits = postings(docs).join(vocabulary, ["bucket", "term"], "left").where("known or term is null").drop("known")
    hits = C.saved(spark, hits, root, "hits")
    whole = hits.where("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    hits = hits.where("term is not null")
    if not whole["N"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    count, total = F.lit(whole["N"]).cast("long"), F.lit(whole["L"]).cast("long")
    df = hits.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * count + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = C.saved(spark, wanted.join(df, ["bucket", "term"]).withColumn("gain", F.col("times") * weight), root, "terms")
    # item terms of a term, side by side, so that a hit meets one row
    by_term = terms.where("gain <> 0").groupBy("bucket", "term").agg(F.collect_list(F.struct("item", "item_id", "gain")).alias("of"))
    by_term = F.broadcast(by_term) if few and terms.count() <= broadcast_terms else by_term
    m = F.lit(75) + F.expr(f"(25 * n * {whole['N']}L) div {whole['L']}L")
    part = hits.withColumn("m", m).withColumn("part", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).select("bucket", "term", "row", "doc_id", "part")
    met = part.join(by_term, ["bucket", "term"]).select("row", "doc_id", "part", F.explode("of").alias("o"))
    scores = met.groupBy("o.item", "o.item_id", "row", "doc_id").agg(F.sum(F.col("o.gain") * F.col("part")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "row"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, C.documents(spark, sf_dir), C.documents(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
docs AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM docs),
posts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY ALL),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
wanted AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * cn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM posts, whole GROUP BY term, cn),
scores AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * cn) // cl)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN posts USING (term) JOIN docs USING (r), whole GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
