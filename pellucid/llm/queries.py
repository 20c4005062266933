"""The queries of the corpus operators by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import conversation_repair, decontaminate_fm, html_mincut, lang_rank, lm_bloom, mixing, near_dedup, packing, pii_bootstrap, quality_rules, spelling, substring_rlz, url_markov

QUERIES = {
    "op1_html_text": html_mincut.op1_html_text,
    "op2_lm_score": lm_bloom.op2_lm_score,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_substring_dedup": substring_rlz.op4_substring_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_pii": pii_bootstrap.op6_pii,
    "op7_decontaminate": decontaminate_fm.op7_decontaminate,
    "op8_language": lang_rank.op8_language,
    "op9_url_filter": url_markov.op9_url_filter,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_spelling": spelling.op12_spelling,
    "op13_packing": packing.op13_packing,
}

ORACLES = {
    "op4_substring_dedup": substring_rlz.ORACLE,
    "op5_near_dedup": near_dedup.ORACLE,
    "op7_decontaminate": decontaminate_fm.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
