"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import conversations, decontaminate, jaccard, line_rules, neardup_vectors, periodic, pieces, quality, recompress, sharding, suffixes, toxicity, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_duplicate_vectors": neardup_vectors.op3_near_duplicate_vectors,
    "op4_substring_dedup": recompress.op4_substring_dedup,
    "op5_benchmark_leaks": decontaminate.op5_benchmark_leaks,
    "op6_balanced_shards": sharding.op6_balanced_shards,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_quality": quality.op9_quality,
    "op10_similar_documents": jaccard.op10_similar_documents,
    "op11_line_rules": line_rules.op11_line_rules,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_near_duplicate_vectors": neardup_vectors.OP3_SQL,
    "op4_substring_dedup": recompress.OP4_SQL,
    "op5_benchmark_leaks": decontaminate.OP5_SQL,
    "op6_balanced_shards": sharding.OP6_SQL,
    "op7_suffix_dedup": suffixes.OP7_SQL,
    "op8_warc_revisits": warc.OP8_SQL,
    "op10_similar_documents": jaccard.OP10_SQL,
    "op11_line_rules": line_rules.OP11_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
