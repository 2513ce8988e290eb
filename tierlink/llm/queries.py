"""Queries and oracle SQL of the subpackage, for the entry module to add."""

from __future__ import annotations

from tierlink.llm.decontaminate import op5_query
from tierlink.llm.filter_audit import OP12_SQL, op12_query
from tierlink.llm.html_extract import op10_query
from tierlink.llm.language_id import op1_query
from tierlink.llm.license_scan import op7_query
from tierlink.llm.lm_scoring import op3_query
from tierlink.llm.near_dedup import op2_query
from tierlink.llm.packing import op4_query
from tierlink.llm.pattern_packing import op11_query
from tierlink.llm.prefix_trie import op13_query
from tierlink.llm.quality_rules import OP8_SQL, op8_query
from tierlink.llm.suffix_dedup import op9_query
from tierlink.llm.toxicity import op6_query

QUERIES = {
    "op1_language_id": op1_query,
    "op2_near_dedup": op2_query,
    "op3_lm_scoring": op3_query,
    "op4_packing": op4_query,
    "op5_decontaminate": op5_query,
    "op6_toxicity": op6_query,
    "op7_license_scan": op7_query,
    "op8_quality_rules": op8_query,
    "op9_suffix_dedup": op9_query,
    "op10_html_extract": op10_query,
    "op11_pattern_packing": op11_query,
    "op12_filter_audit": op12_query,
    "op13_prefix_trie": op13_query,
}

ORACLE_SQL = {
    "op8_quality_rules": OP8_SQL,
    "op12_filter_audit": OP12_SQL,
}
