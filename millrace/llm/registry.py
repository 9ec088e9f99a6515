"""The subpackage's queries and their SQL, for the driver's contract."""

from __future__ import annotations

from importlib import import_module

#: Query name, module and function; SQL is the module's ORACLE_SQL where it has one.
_QUERIES = {
    "op1_ann_inner_product": "ann",
    "op2_pitman_yor": "pitman_yor",
    "op3_language_id": "language",
    "language_of_pages": "language",
    "op4_minhash_groups": "minhash",
    "op5_personal_data": "pii",
    "op6_tool_calls": "tools",
    "op7_best_fit_packing": "packing",
    "op8_warc_segments": "warc",
    "op9_quality_rules": "quality",
    "op10_bpe_roundtrip": "bpe_transducer",
    "op11_mix_sources": "mixing",
    "op12_hard_negatives": "hard_negatives",
    "op13_vector_codes": "vector_codes",
}


def queries() -> dict:
    return {name: getattr(import_module(f"millrace.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"millrace.llm.{module}"), "ORACLE_SQL", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
