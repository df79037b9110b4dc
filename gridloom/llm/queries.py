"""The driver's queries over the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import chat, decontaminate, html_extract, jaccard_join, language_id, packing, quality_rules, resharding, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_extraction": html_extract.op2_html_extract,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_formatting": chat.op5_chat_format,
    "op6_ngram_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_benchmark_decontamination": decontaminate.op7_decontaminate,
    "op8_language_id": language_id.op8_language_id,
    "op9_sharding": resharding.op9_resharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op5_chat_formatting": chat.SQL,
    "op6_ngram_jaccard_join": jaccard_join.SQL,
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
