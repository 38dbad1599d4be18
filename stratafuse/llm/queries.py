"""Queries over the operators of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratafuse.llm import alignment, decontaminate, lexical, mixing, near_dup, packing, quality, repeats, secrets, token_store, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_dup.op1_near_duplicates,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_benchmark_leaks": decontaminate.op5_benchmark_leaks,
    "op6_warc_archive": warc.op6_warc_archive,
    "op7_token_store": token_store.op7_token_store,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_repeated_strings": repeats.op10_repeated_strings,
    "op11_harmonic_packing": packing.op11_harmonic_packing,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_token_alignment": alignment.op13_token_alignment,
}

SQL: dict[str, str] = {"op2_source_mix": mixing.OP2_SQL, "op6_warc_archive": warc.OP6_SQL, "op12_lexical_search": lexical.OP12_SQL}
