"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, exact_dedup, fill_in_middle, line_dedup, lm_score, minhash, mixing, packing, quality_model, quality_rules, sequence_files, substring_dedup, vector_codes


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_near_dedup": minhash.op3_near_dedup,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_packing": packing.op9_packing,
        "op10_quality_classifier": quality_model.op10_quality_classifier,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_token_files": sequence_files.op12_token_files,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op13_fill_in_middle": fill_in_middle.OP13_SQL,
    }
