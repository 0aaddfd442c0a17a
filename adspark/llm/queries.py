"""The driver-facing queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import op1_ppm, op2_shards, op3_sentencepiece, op4_chat, op5_jaccard, op6_suffix_dedup, op7_decontaminate, op8_embeddings, op9_quality, op10_tokenstore, oracles


def queries() -> dict:
    out = {}
    for module in (op1_ppm, op2_shards, op3_sentencepiece, op4_chat, op5_jaccard, op6_suffix_dedup, op7_decontaminate, op8_embeddings, op9_quality, op10_tokenstore):
        out |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2].isdigit() and callable(f)}
    return out


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: no tokenizer, trained model, crc32 or byte-wise repeats."""
    return {"op4_chat": oracles.OP4, "op5_jaccard": oracles.OP5, "op8_embeddings": oracles.OP8}
