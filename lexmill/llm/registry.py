"""The training-data queries and their oracle SQL."""

from __future__ import annotations

from . import decontaminate, license_scan, minhash_dedup, packing, paragraph_dedup, quality_rules, secret_scan, suffix_dedup, token_files, weak_quality


def queries():
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_weak_labels": weak_quality.op1,
        "op2_automaton": secret_scan.op2,
        "op3_minhash": minhash_dedup.op3,
        "op4_line_frequency": quality_rules.op4,
        "op5_positional_index": license_scan.op5,
        "op6_token_files": token_files.op6,
        "op7_winnowing": decontaminate.op7,
        "op8_paragraphs": paragraph_dedup.op8,
        "op9_suffix_array": suffix_dedup.op9,
        "op10_harmonic_packing": packing.op10,
    }


def oracle_sql():
    import corpus_pipeline

    return ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}) | {
        "op2_automaton": secret_scan.OP2_SQL,
        "op4_line_frequency": quality_rules.OP4_SQL,
        "op7_winnowing": decontaminate.OP7_SQL,
    }
