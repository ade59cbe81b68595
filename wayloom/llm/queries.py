"""Queries of the training-data operators."""

from __future__ import annotations

from wayloom.llm import bpe, chat, decontam, exact_dedup, filter_audit, fm_quality, line_dedup, pii, pst, rules, search, simhash, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_line_dedup": line_dedup.query,
    "op3_bpe": bpe.query,
    "op4_fm_quality": fm_quality.query,
    "op5_pii": pii.query,
    "op6_simhash": simhash.query,
    "op7_chat": chat.query,
    "op8_rules": rules.query,
    "op9_pst": pst.query,
    "op10_decontam": decontam.query,
    "op11_search": search.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_rules": rules.ORACLE,
    "op11_search": search.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
