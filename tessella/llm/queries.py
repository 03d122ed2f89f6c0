"""Queries of the text operators, by name, and their DuckDB counterparts."""

from __future__ import annotations

from tessella.llm import clustering, exact_dedup, line_dedup, manifest, minhash_dedup, mixing, pieces, quality, search, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_search": search.op2_search,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_pieces": pieces.op4_pieces,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_clustering": clustering.op11_clustering,
    "op12_manifest": manifest.op12_manifest,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE,
    "op2_search": search.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filters": url_filters.ORACLE,
    "op11_clustering": clustering.ORACLE,
    "op12_manifest": manifest.ORACLE,
}
