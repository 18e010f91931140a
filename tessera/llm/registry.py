"""The subpackage's queries and their SQL, for the entry module."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op1_license, op2_urls, op3_quality, op4_tokens, op5_language, op6_neardup, op7_decontaminate, op8_lm, op9_toxicity, op10_mixing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license.op1_license_scan,
        "op2_url_filter": op2_urls.op2_url_filter,
        "op3_quality_rules": op3_quality.op3_quality_rules,
        "op4_token_counts": op4_tokens.op4_token_counts,
        "op5_language": op5_language.op5_language,
        "op6_near_duplicates": op6_neardup.op6_near_duplicates,
        "op7_decontaminate": op7_decontaminate.op7_decontaminate,
        "op8_lm_score": op8_lm.op8_lm_score,
        "op9_toxicity": op9_toxicity.op9_toxicity,
        "op10_mixing": op10_mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """The SQL of op4 has the vocabulary's pieces in it, so it needs the file that its query needs."""
    found = {"op2_url_filter": op2_urls.oracle(), "op3_quality_rules": op3_quality.ORACLE, "op10_mixing": op10_mixing.ORACLE}
    return found | ({"op4_token_counts": op4_tokens.oracle()} if os.path.exists(op4_tokens.VOCABULARY) else {})
