"""The ten operations as registered queries, and SQL where SQL can express one."""

from __future__ import annotations

from . import bpe, chat, decontaminate, identifiers, langid, lines, minhash, neighbours, suffix, tokencounts


def queries() -> dict:
    found = (
        lines.op1_line_dedup,
        chat.op2_chat_formatting,
        suffix.op3_suffix_array_dedup,
        bpe.op4_byte_bpe,
        identifiers.op5_personal_identifiers,
        tokencounts.op6_token_counts,
        neighbours.op7_nearest_neighbours,
        decontaminate.op8_benchmark_decontamination,
        langid.op9_language_id,
        minhash.op10_minhash_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ORACLE}
