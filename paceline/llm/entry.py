"""Queries and oracle SQL of this subpackage, for the registry at the top of the repository."""

from __future__ import annotations

import corpus_pipeline
from paceline.llm import decontaminate, huffman, language, media, mixing, negatives, passages, quality, simhash, suffix_dedup, token_counts, toxicity, whitening

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_media_columns": media.op2_media_columns,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_token_output": huffman.op5_token_output,
    "op6_language_id": language.op6_language_id,
    "op7_compact_windows": passages.op7_compact_windows,
    "op8_poisson_mix": mixing.op8_poisson_mix,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_benchmark_decontamination": decontaminate.OP1_SQL,
    "op8_poisson_mix": mixing.OP8_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
