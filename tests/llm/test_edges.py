"""Every operator on nulls, repeated rows, empty and very long texts, clashing column names and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafuse.llm import common as C
from stratafuse.llm import decontaminate, mixing, near_dup, quality, repeats, secrets, token_store, toxicity, url_filter, warc

LONG = "lorem ipsum dolor sit amet " * 120_000  # 3.2 MB
ROWS = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "other words of the same id", None, None), (None, "a b c d e f", "en", "s"), (None, None, None, None), (2, "", "de", "s"), (3, None, "de", None), (4, " \t\n\x0b\x0c\r", "en", "t"), (5, LONG, "en", "t"), (6, "x" * 500_000, "en", "t"), (7, "é日本 \u0085 ſ", "fr", "t")]
CLASH = "doc_id long, text string, lang string, source string, uid string, rid string, marks int, key string, comp string, id string, n int, score string, blob string, digest string, part string, group string, rate string, label string, x string, _id string, _row string, seed int, recipe int, at int"


def edges(spark):
    extra = CLASH.count(",") - 3
    return spark.createDataFrame([(*r, *([None] * extra)) for r in ROWS], CLASH).repartition(3)


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 1, 0), (5, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "near_dup": lambda s, d: near_dup.near_duplicates(s, d, 3, 85),
    "mix": lambda s, d: mixing.mix(s, d),
    "quality": lambda s, d: quality.judge_quality(s, d),
    "toxicity": lambda s, d: toxicity.score_toxicity(s, d, labels(s)),
    "secrets": lambda s, d: secrets.scan_versions(s, d, C.work_dir(s) + "/ledger"),
    "repeats": lambda s, d: repeats.remove_repeats(s, d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, name):
    out = OPERATORS[name](spark, edges(spark)).select("doc_id").collect()
    assert sorted((r["doc_id"] or -1) for r in out) == sorted((r[0] or -1) for r in ROWS)
    assert OPERATORS[name](spark, edges(spark).limit(0)).count() == 0


def test_long_and_odd_texts_by_value(spark):
    d = edges(spark)
    got = {(r["doc_id"], r["n_bytes"]): r for r in repeats.remove_repeats(spark, d).collect()}
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        r = got[i, len(data)]
        gone = len(data) if i in (5, 6) else 0  # each 400-byte string of these two comes again at the next period
        assert r["n_removed"] == gone and r["repeated"] == bool(gone) and r["kept_sha256"] == hashlib.sha256(data[gone:]).hexdigest()
    from tokenizers import Tokenizer

    plain, folder = Tokenizer.from_file(token_store.tokenizer_path()), C.work_dir(spark) + "/store"
    token_store.write_store(spark, d, folder, token_store.tokenizer_path())
    want = sorted((len(x), zlib.crc32(x.tobytes())) for x in (np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in ROWS))
    stored = token_store.read_store(spark, folder).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in stored) == want
    at = 0
    for r in sorted(stored, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_leaks_of_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "lorem ipsum dolor sit amet", "x"), (None, "x", "x"), (3, None, "x")], "item_id long, text string, doc_id string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = sorted(((r["doc_id"] or -1), r["item_id"]) for r in decontaminate.find_leaks(spark, edges(spark), bench, broadcast_bytes=limit).collect())
        assert got == [(-1, 1), (1, 1), (1, 1), (5, 2)]


def test_repeated_and_clashing_pages(spark):
    big = "<p>" + "y" * 2000
    rows = [(1, "http://com/en/1", big), (1, "http://com/en/1", big), (2, "http://com/en/1", big), (None, "http://a.net/de/", big), (3, None, None), (4, "", "")] * 2
    pages = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], "page_id long, url string, html string, digest string, top string, id string, of string, refers_to string, bundle string, host string, rule string, label string")
    folder = C.work_dir(spark) + "/w"
    index = warc.write_archives(spark, pages.repartition(4), folder)
    got = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, folder).collect())
    assert got == sorted([(1, "revisit", 2)] * 4 + [(2, "response", None), (-1, "response", None), (3, "response", None), (4, "response", None)] * 2, key=lambda r: (r[0], r[1]))
    tasks = warc.read_archives(spark, folder).groupBy(F.spark_partition_id()).agg(F.countDistinct("bundle").alias("n")).collect()
    assert len(tasks) == index.select("bundle").distinct().count() > 1  # a task a bundle
    judged = url_filter.judge_urls(spark, pages).collect()
    assert len(judged) == len(rows) and {r["verdict"] for r in judged if r["page_id"] in (1, 2)} == {"block"}


def test_training_rows_do_not_depend_on_order(spark):
    d = spark.createDataFrame([(i % 40, f"text {i % 80} " + ("vile " if i % 3 == 0 else "calm ") * (i % 5), "en") for i in range(160)], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    a, b = (toxicity.fit(spark, x, known) for x in (d, d.orderBy(F.desc("text")).repartition(5)))
    assert np.array_equal(a.tables, b.tables) and a.out_bias == b.out_bias and a.thresholds == b.thresholds
    few = toxicity.fit(spark, d, known, most_bytes=100)
    assert np.isfinite(few.out).all()


KNOWN = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("rows", [[], [(i, 1, 0) for i in range(200)], [(i, 0, 1) for i in range(200)], [(i, None, None) for i in range(200)]])
def test_nothing_is_rejected_without_both_labels(spark, tmp_path, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = spark.createDataFrame(rows, KNOWN)
    scored = toxicity.score_toxicity(spark, docs, known).collect()
    assert len(scored) == docs.count() and not any(r["toxic"] for r in scored) and all(abs(r["score"] - toxicity.PRIOR) < 1e-6 for r in scored)
    known.write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.stage_toxicity(spark, docs, str(tmp_path)).count() == docs.count()


def test_a_huge_labelled_text_takes_no_other_place(spark):
    texts = [(i, ("vile " if i % 3 == 0 else "calm ") * 3 + f"word{i}", "en") for i in range(90)]
    known = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(i, 1, i % 2) for i in range(1000, 1040)], KNOWN)
    plain = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    huge = plain.union(spark.createDataFrame([(i, "x " * 20_000, "en") for i in range(1000, 1040)], plain.schema))
    a, b = toxicity.fit(spark, plain, known, most_bytes=30_000), toxicity.fit(spark, huge, known, most_bytes=30_000)
    assert np.array_equal(a.tables, b.tables) and np.array_equal(a.out, b.out) and a.out.any()
    scores = a.score(["vile vile vile", "calm calm calm"])
    assert scores[0] > 0.5 > scores[1]
