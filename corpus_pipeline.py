"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, source mix, token store.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, as Parquet. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratafuse.llm import common as C
from stratafuse.llm.decontaminate import stage_decontaminate
from stratafuse.llm.mixing import stage_mixing
from stratafuse.llm.near_dup import stage_near_dedup
from stratafuse.llm.token_store import stage_tokens
from stratafuse.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mixing", stage_mixing),
    ("tokens", stage_tokens),
]

#: Training a classifier and hashing shingles are beyond SQL; tests/llm/test_pipeline.py compares every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents that all stages keep. Null and repeated ids, null, empty and
    very long texts pass as each stage says; without documents there are no rows."""
    docs = C.documents(spark, sf_dir)
    root = C.work_dir(spark)
    for name, stage in STAGES:
        docs = C.saved(spark, stage(spark, docs, sf_dir), root, name)
    return docs
