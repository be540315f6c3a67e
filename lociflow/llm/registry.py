"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from lociflow.llm import chat, decontaminate, fingerprints, jaccard_join, language_id, line_dedup, nearest, packing, pii, quality, source_audit, substring_dedup, token_alignment


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_language_id": language_id.op3_language_id,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
        "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
        "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_pii_surrogates": pii.op10_pii_surrogates,
        "op11_nearest_neighbours": nearest.op11_nearest_neighbours,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_source_divergence": source_audit.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the others are tested against brute force, exact round trips or held-out accuracy."""
    return {"op1_line_dedup": line_dedup.ORACLE_SQL, "op5_chat_formatting": chat.ORACLE_SQL, "op13_source_divergence": source_audit.ORACLE_SQL}
