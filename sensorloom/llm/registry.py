"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module of this subpackage.
MODULES = {
    "op2_line_dedup": "line_dedup",
    "op5_topk_search": "topk_search",
    "op6_url_filters": "url_filters",
    "op7_jaccard_join": "jaccard_join",
    "op8_piece_encoding": "piece_encoding",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_decontamination": "decontamination",
    "op1_language_id": "language_id",
    "op3_token_counts": "token_counts",
    "op4_substring_dedup": "substring_dedup",
    "op11_merkle_manifest": "merkle_manifest",
    "op12_vector_codes": "vector_codes",
    "op13_quality_ranking": "quality_ranking",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
