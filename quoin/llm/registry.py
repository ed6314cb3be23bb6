"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from quoin.llm import chat, conversation_repair, decontaminate, divergence, exact_dedup, language_id, language_model, mixing, sharding, simhash, suffix_dedup, url_rules, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pivotal_mix": mixing.op2_pivotal_mix,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_preference_format": chat.op4_preference_format,
    "op5_simhash": simhash.op5_simhash,
    "op6_suffix_array": suffix_dedup.op6_suffix_array,
    "op7_language_id": language_id.op7_language_id,
    "op8_sharding": sharding.op8_sharding,
    "op9_revisits": warc.op9_revisits,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_language_model": language_model.op11_language_model,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_preference_format": chat.OP4_SQL,
    "op9_revisits": warc.OP9_SQL,
    "op10_url_rules": url_rules.OP10_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
