"""Registered queries of the training-data operators, with comparison SQL where SQL can express them."""

from __future__ import annotations

from fieldloom.llm import (
    alignment, contamination, conversations, fingerprints, html_text, jaccard, language_model, licenses, mixing, pii, substrings, token_counts, toxicity,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_benchmark_decontamination": contamination.op5_benchmark_decontamination,
    "op6_html_text": html_text.op6_html_text,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_conversation_trie": conversations.op11_conversation_trie,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_lm_scoring": language_model.op13_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op1_pii": pii.ORACLE,
    "op2_substring_dedup": substrings.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE,
    "op11_conversation_trie": conversations.ORACLE,
}
