"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import align, ann, bpe, chat, decontaminate, exact, jaccard, licenses, lines, merkle, shards, suffixes, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_winnowing": decontaminate.op3_winnowing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_jaccard_tiles": jaccard.op5_jaccard_tiles,
    "op6_posting_lists": ann.op6_posting_lists,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_virtual_slots": shards.op10_virtual_slots,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
SQL = {
    "op1_line_dedup": lines.OP1_SQL,
    "op3_winnowing": decontaminate.op3_sql(),
    "op4_license_scan": licenses.op4_sql(),
    "op7_chat_formatting": chat.op7_sql(),
    "op12_exact_dedup": exact.OP12_SQL,
    "op13_merkle_manifest": merkle.op13_sql(),
}
