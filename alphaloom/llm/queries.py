"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, language_id, near_dedup, packing, periodic_runs, pieces, pii, quality, url_filter, vector_search, whitening


def queries() -> dict:
    return {
        "op1_token_counts": pieces.op1_token_counts,
        "op2_minmax_dedup": near_dedup.op2_minmax_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_compression_quality": quality.op5_compression_quality,
        "op6_bootstrapped_pii": pii.op6_bootstrapped_pii,
        "op7_exact_topk": vector_search.op7_exact_topk,
        "op8_adaptive_ann": vector_search.op8_adaptive_ann,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_benchmark_decontamination": decontamination.op12_benchmark_decontamination,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
        "pages_language_id": language_id.pages_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.op4_sql(),
        "op7_exact_topk": vector_search.op7_sql(),
        "op12_benchmark_decontamination": decontamination.op12_sql(),
    }
