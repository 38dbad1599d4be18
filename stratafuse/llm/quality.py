"""Operator 4: quality rules as a short-circuit cascade.

Rules are cheap predicates on a text's counts. Their cost (seconds a document) and
selectivity (share rejected) are estimated in executors on a sample, rules are ordered by rejection
per cost, and each rule is then evaluated only on the documents that all earlier ones
passed. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.llm import common as C

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text if ``rejects(text, words, counts)``; counts holds the base counts."""

    name: str
    rejects: Callable[[str, np.ndarray, dict[str, int]], bool]


def _symbols(text: str, words: np.ndarray, n: dict[str, int]) -> bool:
    return 2 * n["n_symbols"] > n["n_words"]


def _word_length(text: str, words: np.ndarray, n: dict[str, int]) -> bool:
    return not 2 * n["n_words"] <= n["word_chars"] <= 15 * n["n_words"]


def _duplicate_lines(text: str, words: np.ndarray, n: dict[str, int]) -> bool:
    return 2 * n["n_dup_lines"] > sum(1 for x in text.split("\n") if x.strip(SPACE))


def _one_word(text: str, words: np.ndarray, n: dict[str, int]) -> bool:
    return 2 * int(np.unique(words, return_counts=True)[1].max()) > n["n_words"]


def _letters(text: str, words: np.ndarray, n: dict[str, int]) -> bool:
    return 2 * sum(map(str.isalpha, text)) < n["word_chars"]


RULES = (Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("duplicate_lines", _duplicate_lines), Rule("one_word", _one_word), Rule("letters", _letters))


def base_counts(texts: list[str | None]) -> tuple[list[dict[str, int]], list[np.ndarray]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text, and its words' hashes."""
    h, ends = C.word_hashes([t.encode() if t else b"" for t in texts])
    at, out = 0, []
    runs = C.window_hashes(h, 8)
    for t, n in zip(texts, np.diff(ends).tolist(), strict=True):
        t = t or ""
        seen: set[str] = set()
        again = 0
        for line in t.split("\n"):
            if line.strip(SPACE):
                again += line in seen
                seen.add(line)
        repeated = 0
        if n > 8:
            codes, _ = pd.factorize(runs[at : at + n - 7])
            starts = np.flatnonzero(np.bincount(codes)[codes] > 1)
            if len(starts):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + 8, -1)
                repeated = int(np.count_nonzero(np.cumsum(edge)[:n]))
        at += n
        out.append({"n_words": n, "word_chars": len(t) - sum(map(t.count, SPACE)), "n_symbols": sum(map(t.count, SYMBOLS)), "n_dup_lines": again, "n_repeat_words": repeated})
    return out, np.split(h, ends[1:-1]) if texts else []


def base_failed(n: dict[str, int]) -> bool:
    return n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"]


COSTS = "rule string, seconds double, hits long, n long"


def _measure(rules: tuple[Rule, ...]):
    """What each rule costs and rejects on the rows of a sample that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            counts, words = base_counts(texts)
            jobs = [(t, w, n) for t, w, n in zip(texts, words, counts, strict=True) if t and not base_failed(n)]
            rows = []
            for r in rules:
                began = time.perf_counter()
                hits = sum(r.rejects(*j) for j in jobs)
                rows.append((r.name, time.perf_counter() - began, hits, len(jobs)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.float64(), pa.int64(), pa.int64()])], ["rule", "seconds", "hits", "n"])

    return run


def by_worth(rules: tuple[Rule, ...], cost: dict[str, tuple[float, int, int]]) -> tuple[Rule, ...]:
    """``rules`` by rejection per cost, given each one's seconds, rejections and rows."""

    def worth(r: Rule) -> float:
        seconds, hits, n = cost.get(r.name, (0.0, 0, 0))
        return ((hits + 0.5) / (n + 1)) / (seconds / max(1, n) + 1e-9)

    return tuple(sorted(rules, key=lambda r: -worth(r)))


def ordered_rules(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """``rules`` by rejection per cost, as measured in executors on about ``rows`` rows that a hash of
    the id spreads over the table; a few numbers a rule come back."""
    every = max(1, docs.count() // max(1, rows))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    sums = picked.mapInArrow(_measure(rules), COSTS).groupBy("rule").agg(F.sum("seconds"), F.sum("hits"), F.sum("n")).collect()
    return by_worth(rules, {r[0]: (r[1], r[2], r[3]) for r in sums})


def _judge(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            counts, words = base_counts(texts)
            failed = [base_failed(n) for n in counts]
            by: list[str | None] = ["base" if f else None for f in failed]
            left = [i for i, f in enumerate(failed) if not f]
            for r in rules:  # each rule sees only what the earlier ones passed
                rejected = [i for i in left if r.rejects(texts[i], words[i], counts[i])]
                for i in rejected:
                    by[i] = r.name
                gone = set(rejected)
                left = [i for i in left if i not in gone]
            cols = [b.column("doc_id")] + [pa.array([n[k] for n in counts], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed, pa.bool_()), pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    return run


def judge_quality(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by
    for each row of ``docs`` (doc_id, text, ...): counts are of the whole text; a null or empty
    text has none and fails (fewer than 20 words). rejected_by is the first rule of the cascade that
    rejects, "base" or null; it depends on the measured order, kept does not. Rows are judged one by one, so a null or
    repeated doc_id changes nothing, other columns are ignored and an empty table gives
    an empty result."""
    C.bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_judge(ordered_rules(spark, docs, rules)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark, C.documents(spark, sf_dir))
