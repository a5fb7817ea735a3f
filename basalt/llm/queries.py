"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language, licenses, mixing, near_dedup, pii, quality, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_language": language.op6_language,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_pii": pii.op9_pii,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.SQL,
        "op4_mix_sources": mixing.SQL,
        "op7_near_dedup": near_dedup.SQL,
        "op8_decontaminate": decontaminate.SQL,
        "op9_pii": pii.SQL,
    }
