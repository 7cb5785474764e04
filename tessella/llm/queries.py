"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import (
    op1_line_dedup,
    op2_decontaminate,
    op3_token_binary,
    op4_url_rules,
    op5_language,
    op6_hash_tree,
    op7_transport_stream,
    op8_mixing,
    op9_substring_dedup,
    op10_jaccard_join,
)

_MODULES = [op1_line_dedup, op2_decontaminate, op3_token_binary, op4_url_rules, op5_language, op6_hash_tree, op7_transport_stream, op8_mixing, op9_substring_dedup, op10_jaccard_join]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
