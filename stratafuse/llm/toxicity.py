"""Operator 8: toxicity scores by a convolutional text classifier in numpy.

A word's embedding is the sum of three hashed rows (two hashes of the word, one of its
prefix). Filters of several widths run over the words, each is max-pooled over the whole
text, and a logistic layer scores the pooled values. Max pooling lets texts of any
length be scored in chunks. Training is AdaGrad in one task over a bounded sample
of labelled rows; only argmax positions receive gradients. Decision thresholds are
calibrated by language on labelled rows that training did not see.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C

SLOTS, DIM, FILTERS, WIDTHS, PREFIX = 1 << 15, 12, 8, (1, 2, 3), 5
#: Bounds of the labelled sample that is collected for training and calibration.
MAX_POSITIVE, MAX_NEGATIVE = 2000, 4000
#: Bytes of text of that sample, half of them for each label: in the order of the hash, rows that don't fit any more are left out.
MAX_BYTES = 64 << 20
#: The score of every text where labels of both kinds are wanting: nothing is rejected without having been learnt.
PRIOR = 0.01
CHUNK = 1 << 15
_LOWER_AND_PUNCTUATION = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(3, words) slots of all words and the offsets of the texts; case and ASCII punctuation don't matter."""
    parts, counts, at = [np.zeros((3, 0), np.int32)], [np.zeros(1, np.int64)], 0
    while at < len(texts):  # a megabyte at a time: hashing needs tens of bytes for each byte
        blobs, size = [], 0
        while at < len(texts) and size < 1 << 20:
            t = texts[at]
            blobs.append(t.lower().encode().translate(_LOWER_AND_PUNCTUATION) if t else b"")
            size += len(blobs[-1])
            at += 1
        h, ends = C.word_hashes(blobs)
        p, _ = C.word_hashes(blobs, PREFIX)
        mask = np.uint64(SLOTS - 1)
        parts.append(np.stack([h & mask, (h >> np.uint64(24)) & mask, (p >> np.uint64(9)) & mask]).astype(np.int32))
        counts.append(np.diff(ends))
    return np.concatenate(parts, axis=1), np.cumsum(np.concatenate(counts))


@dataclass
class Model:
    tables: np.ndarray  # (3, SLOTS, DIM)
    filters: np.ndarray  # (offsets, DIM, FILTERS): widths in turn, each with an entry a position
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5

    def _maps(self, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(index, width, responses at each start) of each width over one run of words."""
        k = 0
        for i, w in enumerate(WIDTHS):
            n = x.shape[0] - w + 1
            if n > 0:
                z = x[:n] @ self.filters[k]
                for j in range(1, w):
                    z += x[j : j + n] @ self.filters[k + j]
                yield i, w, z
            k += w

    def pooled(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Max over each text of each filter's response, at least 0 (also for empty texts)."""
        out = np.zeros((len(at) - 1, len(self.bias)), np.float32)
        for s in range(0, ids.shape[1], CHUNK):
            part = ids[:, s : s + CHUNK + max(WIDTHS) - 1]
            x = self.tables[0][part[0]] + self.tables[1][part[1]] + self.tables[2][part[2]]
            for i, w, z in self._maps(part, x):
                z = z[:CHUNK]
                first = np.searchsorted(at, s, "right") - 1
                last = np.searchsorted(at, s + len(z), "left")
                texts = np.arange(first, last)
                lo, hi = np.maximum(at[texts], s) - s, np.minimum(at[texts + 1] - w + 1, s + len(z)) - s
                texts, lo, hi = texts[hi > lo], lo[hi > lo], hi[hi > lo]
                if len(texts):
                    cut = np.stack([lo, hi], 1).ravel()
                    best = np.maximum.reduceat(np.concatenate([z, np.full((1, FILTERS), -np.inf, np.float32)]), cut)[::2]
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    out[texts, cols] = np.maximum(out[texts, cols], best + self.bias[cols])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        ids, at = word_ids(texts)
        z = self.pooled(ids, at) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(texts: list[str | None], labels: np.ndarray, epochs: int | None = None, batch: int = 32, rate: float = 0.08, seed: int = 7) -> Model:
    """Fit a model; equal input gives an equal model. Small samples get more epochs (8 to 60). Without texts of both labels
    every score is PRIOR."""
    epochs = epochs or int(np.clip(60_000 // max(1, len(texts)), 8, 60))
    rng = np.random.default_rng(seed)
    n_off, width = sum(WIDTHS), len(WIDTHS) * FILTERS
    m = Model(rng.normal(0, 0.1, (3, SLOTS, DIM)).astype(np.float32), rng.normal(0, 0.3, (n_off, DIM, FILTERS)).astype(np.float32), np.zeros(width, np.float32), rng.normal(0, 0.3, width).astype(np.float32), 0.0)
    if len(texts) == 0 or labels.min() == labels.max():
        m.out[:] = 0
        m.out_bias = float(np.log(PRIOR / (1 - PRIOR)))
        return m
    ids, at = word_ids(texts)
    rate_of = labels.mean()
    m.out_bias = float(np.log(rate_of / (1 - rate_of)))
    g_tab, g_fil, g_bias, g_out, g_ob = (np.full(x.shape, 1e-2, np.float32) for x in (m.tables, m.filters, m.bias, m.out, np.zeros(1)))
    starts = np.concatenate([[0], np.cumsum(WIDTHS)])
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            take = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
            own = np.concatenate([[0], np.cumsum(at[rows + 1] - at[rows])])
            part = ids[:, take]
            x = m.tables[0][part[0]] + m.tables[1][part[1]] + m.tables[2][part[2]]
            pool, where = np.zeros((len(rows), width), np.float32), np.full((len(rows), width), -1)
            for i, w, z in m._maps(part, x):
                for r in range(len(rows)):
                    seg = z[own[r] : own[r + 1] - w + 1]
                    if len(seg):
                        best = seg.argmax(0)
                        v = seg[best, np.arange(FILTERS)] + m.bias[i * FILTERS : (i + 1) * FILTERS]
                        pool[r, i * FILTERS : (i + 1) * FILTERS] = np.maximum(v, 0)
                        where[r, i * FILTERS : (i + 1) * FILTERS] = np.where(v > 0, own[r] + best, -1)
            p = 1 / (1 + np.exp(-np.clip(pool @ m.out + m.out_bias, -30, 30)))
            d = ((p - labels[rows]) / len(rows)).astype(np.float32)
            g = d[:, None] * m.out * (where >= 0)
            grads = [(m.out, g_out, pool.T @ d + 1e-5 * m.out), (m.bias, g_bias, g.sum(0))]
            r, c = np.nonzero(where >= 0)
            gf = np.zeros_like(m.filters)
            dx: dict[int, np.ndarray] = {}
            for i, w in enumerate(WIDTHS):
                sel = (c // FILTERS) == i
                rr, cc = r[sel], c[sel]
                pos, gv, ff = where[rr, cc], g[rr, cc], cc % FILTERS
                for j in range(w):
                    k = starts[i] + j
                    np.add.at(gf[k].T, ff, gv[:, None] * x[pos + j])
                    for q, v in zip((pos + j).tolist(), gv[:, None] * m.filters[k].T[ff], strict=True):
                        dx[q] = dx[q] + v if q in dx else v
            grads.append((m.filters, g_fil, gf))
            for value, seen, grad in grads:
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
            go = float(d.sum())
            g_ob += go * go
            m.out_bias -= rate * go / float(np.sqrt(g_ob[0]))
            if dx:
                at_pos, val = np.fromiter(dx, np.int64), np.stack(list(dx.values()))
                for t in range(3):
                    slot, inv = np.unique(part[t][at_pos], return_inverse=True)
                    grad = np.zeros((len(slot), DIM), np.float32)
                    np.add.at(grad, inv, val)
                    g_tab[t][slot] += grad * grad
                    m.tables[t][slot] -= rate * grad / np.sqrt(g_tab[t][slot])
    return m


def calibrate(model: Model, texts: list[str | None], labels: np.ndarray, langs: list[str | None], least: int = 5) -> None:
    """Set the threshold of each language (and of all together, for the rest) to the one of highest F1."""
    scores = model.score(texts) if texts else np.zeros(0)

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s)
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        k = int(np.argmax(f1))
        below = s[order][k + 1] if k + 1 < len(s) else 0.0
        return float(np.clip((s[order][k] + below) / 2, 0.2, 0.8))

    labels = np.asarray(labels)
    if not model.out.any():
        return  # nothing was learnt, and the thresholds stay above the prior
    if labels.sum() >= least:
        model.default = best(scores, labels)
    for lang in {x for x in langs if x is not None}:
        sel = np.array([x == lang for x in langs])
        if labels[sel].sum() >= least and (1 - labels[sel]).sum() >= least:
            model.thresholds[lang] = best(scores[sel], labels[sel])


def _remainder() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVE, negatives: int = MAX_NEGATIVE, most_bytes: int = MAX_BYTES) -> Model:
    """A calibrated model from at most ``positives`` + ``negatives`` labelled rows, those of
    lowest hash of the id, whose crc32(doc_id) mod 4 is not 2, and at most ``most_bytes`` of text, half of it for either
    label: a text that is larger than what is left of its half is passed over, so it takes no other's place. Conflicting labels of an id
    count as toxic; of rows that share an id the text of lowest hash counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(_remainder() != 2)
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.where("toxic = 1").orderBy(order).limit(positives).union(known.where("toxic = 0").orderBy(order).limit(negatives))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("n").alias("n"), F.max("toxic").alias("toxic")).orderBy(order, "doc_id").collect()
    taken, left = [], {0: most_bytes // 2, 1: most_bytes // 2}
    for r in sizes:
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            taken.append((r["doc_id"], r["toxic"]))
    chosen = spark.createDataFrame(taken, "doc_id long, toxic int")
    text = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    rows = text.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("x"), F.max("toxic").alias("toxic")).select("doc_id", "x.text", "x.lang", "toxic")
    # one task trains on the bounded sample: its texts never come to the driver, the weights do
    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit_rows, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, np.int64))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of a sample (doc_id, text, lang, toxic): a seventh of it calibrates the thresholds."""
    ids, texts, langs, y = [], [], [], []
    for b in batches:
        for column, to in (("doc_id", ids), ("text", texts), ("lang", langs), ("toxic", y)):
            to += b.column(column).to_pylist()
    labels = np.array(y, np.int64)
    held = np.array([C.mix64(np.array([i], np.uint64))[0] % np.uint64(7) == 0 for i in ids], bool)
    model = train([t for t, h in zip(texts, held, strict=True) if not h], labels[~held])
    calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], labels[held], [x for x, h in zip(langs, held, strict=True) if h])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            s = m.score(b.column("text").to_pylist())
            cut = np.array([m.thresholds.get(x, m.default) for x in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array(s >= cut, pa.bool_())], ["doc_id", "score", "toxic"])

    return run


def _passed(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (scored,) = _apply(model)(iter([b]))
            yield b.filter(pc.invert(scored.column("toxic")))

    return run


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, toxic for each row of ``docs`` (doc_id, text, lang, ...): score (0 to 1) depends
    on the whole text alone; toxic compares it with the threshold of the row's language (the
    general one for null or unseen languages). Null and empty texts get the score of no
    evidence. Null or repeated doc_ids are scored like all rows; without labels of both kinds
    every row gets PRIOR and none is toxic. Other columns are ignored; an empty table gives an empty result.
    """
    C.bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    model = spark.sparkContext.broadcast(fit(spark, docs, labels))
    return docs.mapInArrow(_apply(model), "doc_id long, score double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark, C.documents(spark, sf_dir), C.documents(spark, sf_dir, "labels"))
    held = F.coalesce(_remainder() == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject at their language's threshold. Each row is
    judged by its own text and language, whether its doc_id is null, repeated or neither. Null and empty texts have
    the score of no evidence; without labels of both kinds all documents stay; other columns stay as they are, and an empty table gives an empty one."""
    C.bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(spark, docs.withColumn("doc_id", F.col("doc_id").cast("long")), C.documents(spark, sf_dir, "labels")))
    return docs.mapInArrow(_passed(model), docs.schema)
