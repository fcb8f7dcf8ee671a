"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from . import align, bpe, conversation, embed_dedup, exact_dedup, line_dedup, packing, pii, quality, simhash, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_pii": pii.op3_pii,
        "op4_embedding_dedup": embed_dedup.op4_embedding_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_simhash": simhash.op6_simhash,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_quality": quality.op8_quality,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_conversation_repair": conversation.op11_conversation_repair,
        "op12_align": align.op12_align,
        "op13_topk": topk.op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op4_embedding_dedup": embed_dedup.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
        "op13_topk": topk.SQL,
    }
