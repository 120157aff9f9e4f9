"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, licenses, linededup, minhash, mixing, pii, quality, secrets, suffixdedup, tokenfile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_file": tokenfile.op1_token_file,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_personal_data": pii.op4_personal_data,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
        "op9_secrets": secrets.op9_secrets,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.SQL, "op3_mix_sources": mixing.SQL, "op5_line_dedup": linededup.SQL, "op6_license_scan": licenses.SQL, "op7_decontaminate": decontaminate.SQL, "op10_minhash": minhash.SQL}
