"""The registered corpus queries, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlattice.llm import bpe, chat_format, decontaminate, fim, host_rules, mixing, ngram_join, pii, quality_model, runs, secret_scan, suffix_dedup, url_filter
from emberlattice.llm.common import table


def over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[table(spark, sf_dir, name) for name in names])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": over(chat_format.op1_chat_windows, "conversations"),
    "op2_host_rules": over(host_rules.op2_host_rules, "documents"),
    "op3_personal_data": over(pii.op3_personal_data, "documents"),
    "op4_source_mix": over(mixing.op4_source_mix, "documents"),
    "op5_suffix_dedup": over(suffix_dedup.op5_suffix_dedup, "documents"),
    "op6_secret_scans": over(secret_scan.op6_secret_scans, "documents"),
    "op7_url_filters": over(url_filter.op7_url_filters, "pages"),
    "op8_benchmark_leaks": over(decontaminate.op8_benchmark_leaks, "documents", "benchmark"),
    "op9_ngram_join": over(ngram_join.op9_ngram_join, "documents"),
    "op10_quality_classifier": over(quality_model.op10_quality_classifier, "documents", "labels"),
    "op11_shared_chunk_bpe": over(bpe.op11_shared_chunk_bpe, "documents"),
    "op12_periodic_runs": over(runs.op12_periodic_runs, "documents"),
    "op13_fill_in_middle": over(fim.op13_fill_in_middle, "documents"),
}
SQL: dict[str, str] = {"op2_host_rules": host_rules.OP2_SQL, "op4_source_mix": mixing.OP4_SQL,
                      "op9_ngram_join": ngram_join.OP9_SQL, "op13_fill_in_middle": fim.OP13_SQL}
