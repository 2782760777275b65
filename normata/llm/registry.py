"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from normata.llm import chat, decontam, hashing, jaccard, merkle, packing, quality, runs, sharding, spans, suffix_tree, tokens, toxicity

QUERIES = {
    "op1_multi_index_hashing": hashing.op1_multi_index_hashing,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_sentence_spans": spans.op3_sentence_spans,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_suffix_tree": suffix_tree.op8_suffix_tree,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_hilbert_sharding": sharding.op10_hilbert_sharding,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_token_ids": tokens.op12_token_ids,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op3_sentence_spans": spans.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
