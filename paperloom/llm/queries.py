"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from paperloom.llm import collocations, conversations, decontaminate, divergence, language, line_dedup, mixing, near_dedup, packing, substring_dedup, token_files, topk, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_divergence": divergence.op2_divergence,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_top_k": topk.op5_top_k,
    "op6_language": language.op6_language,
    "op7_warc": warc.op7_warc,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_pack_sequences": packing.op9_pack_sequences,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_conversations": conversations.op12_conversations,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op2_divergence": divergence.op2_sql(),
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_top_k": topk.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_decontaminate": decontaminate.OP11_SQL,
    "op12_conversations": conversations.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
