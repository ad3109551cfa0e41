"""The registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ann, decontam, licences, lines, minhash, packing, pii, substring, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring.op1_substring_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_approximate_nearest_neighbours": ann.op3_approximate_nearest_neighbours,
        "op4_license_scans": licences.op4_license_scans,
        "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
        "op6_pii": pii.op6_pii,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_url_filters": urls.op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring.OP1_SQL, "op4_license_scans": licences.OP4_SQL, "op9_line_dedup": lines.OP9_SQL}
