"""Operator 9: secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by its SHA-256. The ledger is a Parquet
folder of (blob, rules, findings); a run scans only the pairs of blob and rule version
that it lacks, once for all paths that hold the blob, appends them and joins the
findings back to every path.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C

#: Fixed patterns of the base kinds, in the order in which they are listed; the number is the group and the length it needs.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # maximal runs, those of 24 or more
)
#: What the method adds; an opaque run must also have 3.5 bits a character, letters of both cases and digits.
ADDED = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("prefixed", re.compile(r"(?:ghp_|gho_|sk_live_|xox[bp]-)[A-Za-z0-9-]{16,}"), 0, 1),
    ("opaque", re.compile(r"[A-Za-z0-9+/_=-]{32,}", re.ASCII), 0, 32),
)
KINDS = [k for k, *_ in (*BASE, *ADDED)]
RULE_VERSION = hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, p, g, n in (*BASE, *ADDED)]).encode()).hexdigest()[:16]


def _opaque(s: str) -> bool:
    if not (re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s)):
        return False
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) >= 3.5


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points: leftmost non-overlapping per kind, by start, then kind as
    listed. A text without secrets, an empty one too, gives none."""
    out = []
    for k, (kind, pattern, group, least) in enumerate((*BASE, *ADDED)):
        for m in pattern.finditer(text):
            s, e = m.span(group)
            if e - s >= least and (kind != "opaque" or _opaque(m[0])):
                out.append((m.start(), k, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for blob, text in zip(b.column("blob").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = find_spans(text or "")
            if found:  # a blob without findings needs its ledger row, not its findings
                n = Counter(k for *_, k in found)
                base = ",".join(f"{k}:{s}:{e}" for s, e, k in found if k in ("assign", "access", "hex"))
                rows.append((blob, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in found)))
            else:
                rows.append((blob, 0, 0, 0, EMPTY, ""))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


EMPTY = hashlib.sha256(b"").hexdigest()
FOUND = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_versions(spark: SparkSession, docs: DataFrame, ledger: str, rules: str = RULE_VERSION) -> DataFrame:
    """Findings of each row of ``docs`` (doc_id, text, ...), one row a path: doc_id, n_assign,
    n_access, n_hex, base_sha256, spans, blob (hex).

    ``ledger`` is a folder that earlier runs may have left; only blobs it lacks for ``rules`` are
    scanned, one path each. A null text is the empty blob without findings. Rows of a null or
    repeated doc_id are paths like all others. Other columns are ignored; an empty table
    gives an empty result.
    """
    C.bounded_batches(spark)
    root = C.work_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("blob"), "text")
    paths = C.saved(spark, keyed.drop("text"), root, "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("first"))
    incremental = _exists(spark, ledger)
    if incremental:
        blobs = blobs.join(spark.read.parquet(ledger).where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    blobs = C.saved(spark, blobs, root, "unseen")
    other = paths.join(blobs, "blob", "left").where(F.col("doc_id").isNotNull() & (F.col("first").isNull() | (F.col("doc_id") != F.col("first"))))
    # an id that is also the first path of an unseen blob is read again
    spare = C.saved(spark, other.select("doc_id").distinct().join(blobs.select(F.col("first").alias("doc_id")), "doc_id", "left_anti"), root, "spare")
    todo = C.by_ids(keyed, spare, "doc_id", "left_anti")
    if incremental:  # ids that name a known and an unseen blob, and null ids
        todo = C.by_ids(todo, blobs.select("blob"), "blob", "left_semi")
    new = todo.select("blob", "text").mapInArrow(_scan, FOUND).withColumn("rules", F.lit(rules))
    new.write.mode("append").parquet(ledger)
    found = spark.read.parquet(ledger).where((F.col("rules") == rules) & (F.col("spans") != "")).drop("rules").dropDuplicates(["blob"])
    out = paths.join(found, "blob", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.lit(EMPTY)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: the even ids come first, then all, of which only unseen blobs are scanned."""
    docs, ledger = C.documents(spark, sf_dir), C.work_dir(spark) + "/ledger"
    scan_versions(spark, docs.where("doc_id % 2 = 0"), ledger)
    return scan_versions(spark, docs, ledger).drop("blob")
