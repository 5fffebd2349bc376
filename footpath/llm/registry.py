"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, importance, line_dedup, ngram_lm, packing, simhash, substring_dedup, threshold_search, token_counts, vantage_point


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_threshold_search": threshold_search.op2_threshold_search,
        "op3_elias_fano_lm": ngram_lm.op3_elias_fano_lm,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_vantage_point": vantage_point.op5_vantage_point,
        "op6_simhash": simhash.op6_simhash,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_importance_resampling": importance.op10_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_threshold_search": threshold_search.ORACLE, "op4_line_dedup": line_dedup.ORACLE}
