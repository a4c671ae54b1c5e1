"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_token_alignment
from .common import read_table
from .compression import op2_compression_quality, op4_compression_language_id
from .decontaminate import OP8_SQL, op8_benchmark_decontamination
from .license_scan import op10_license_scan, op10_sql
from .packing import op7_best_fit_packing
from .quality_rules import op1_quality_rules
from .secret_scan import op3_multipart_secrets
from .sharding import op13_external_shuffle
from .simhash import op9_simhash_near_dedup
from .suffix_dedup import op6_suffix_array_dedup
from .token_binary import op5_token_binary
from .whitening import op11_embedding_whitening


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(read_table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _over(op1_quality_rules, "documents", "labels"),
        "op2_compression_quality": _over(op2_compression_quality, "documents", "labels"),
        "op3_multipart_secrets": _over(op3_multipart_secrets, "documents"),
        "op4_compression_language_id": _over(op4_compression_language_id, "documents"),
        "op5_token_binary": _over(op5_token_binary, "documents"),
        "op6_suffix_array_dedup": _over(op6_suffix_array_dedup, "documents"),
        "op7_best_fit_packing": _over(op7_best_fit_packing, "documents"),
        "op8_benchmark_decontamination": _over(op8_benchmark_decontamination, "documents", "benchmark"),
        "op9_simhash_near_dedup": _over(op9_simhash_near_dedup, "documents"),
        "op10_license_scan": _over(op10_license_scan, "documents"),
        "op11_embedding_whitening": _over(op11_embedding_whitening, "embeddings"),
        "op12_token_alignment": _over(op12_token_alignment, "documents"),
        "op13_external_shuffle": _over(op13_external_shuffle, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_benchmark_decontamination": OP8_SQL, "op10_license_scan": op10_sql()}
