"""Null and repeated doc_ids in the pipeline's stages: every row is judged by its own text."""

from collections import Counter

import numpy as np
import pytest

from stratafuse.llm import decontaminate, near_dup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(3)


def left(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_toxic_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, words(rng, 30) + (" vile scum" if i % 4 == 0 else "")) for i in range(400)]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean, bad = (words(rng, 30), words(rng, 15) + " vile scum " + words(rng, 15))
    more = [(None, clean), (None, bad), (9000, clean), (9000, bad), (9000, clean)]
    got = left(toxicity.stage_toxicity(spark, table(spark, rows + more), str(tmp_path)))
    assert {k: n for k, n in got.items() if k[0] in (None, 9000)} == {(None, clean): 1, (9000, clean): 2}


def test_copied_rows(spark):
    rng = np.random.default_rng(3)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(5, a), (7, a + " end"), (None, a), (None, b), (None, b), (3, c), (3, c), (3, d), (8, d), (9, c + " end"), (2, e), (2, e + " end"), (4, ""), (4, ""), (None, None)]
    got = left(near_dup.stage_near_dedup(spark, table(spark, rows), ""))
    e_kept = {k for k in got if k[0] == 2}
    assert len(e_kept) == 1 and {k: n for k, n in got.items() if k not in e_kept} == {(5, a): 1, (None, b): 1, (3, c): 1, (3, d): 1, (4, ""): 2, (None, None): 1}


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_leaking_rows(spark, tmp_path, most):
    rng = np.random.default_rng(4)
    item, clean, other = (words(rng, 20) for _ in range(3))
    spark.createDataFrame([(1, item), (None, other)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, clean), (None, "x " + item), (6, clean), (6, item + " y"), (6, clean), (7, None), (0, clean), (8, other)]
    got = left(decontaminate.stage_decontaminate(spark, table(spark, rows), str(tmp_path), most))
    assert got == {(None, clean): 1, (6, clean): 2, (7, None): 1, (0, clean): 1, (8, other): 1}
