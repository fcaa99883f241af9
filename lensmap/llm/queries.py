"""Registered queries of the dealt operators and their DuckDB SQL."""

from __future__ import annotations

from lensmap.llm import (filter_audit, hmm, jaccard_join, line_rules, merkle, mixing, pii, rule_ensemble, suffix_repeats,
                         templates, token_ids, token_rollup, warc)

QUERIES = {
    "op1_warc_salvage": warc.op1,
    "op2_token_ids": token_ids.op2,
    "op3_token_counts": token_rollup.op3,
    "op4_suffix_repeats": suffix_repeats.op4,
    "op5_rule_ensemble": rule_ensemble.op5,
    "op6_line_frequency": line_rules.op6,
    "op7_jaccard_join": jaccard_join.op7,
    "op8_template_decontamination": templates.op8,
    "op9_source_mixing": mixing.op9,
    "op10_hidden_markov": hmm.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_personal_data": pii.op13,
}
ORACLES = {
    "op1_warc_salvage": warc.SQL,
    "op3_token_counts": token_rollup.SQL,
    "op6_line_frequency": line_rules.SQL,
    "op8_template_decontamination": templates.SQL,
    "op9_source_mixing": mixing.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
