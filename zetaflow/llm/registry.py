"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import ann, automaton, exact_dedup, html_extract, minhash, mixing, packing, quality, secrets, suffix_array


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality": quality.op2_quality,
        "op3_near_dedup": minhash.op3_near_dedup,
        "op4_secrets": secrets.op4_secrets,
        "op5_automaton": automaton.op5_automaton,
        "op6_extract": html_extract.op6_extract,
        "op7_suffix_array": suffix_array.op7_suffix_array,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_nearest": ann.op9_nearest,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.OP8_SQL}
