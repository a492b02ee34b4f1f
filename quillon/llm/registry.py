"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, html, linededup, lm, minhash, mixing, pii, quality, suffixdedup, toxicity


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_lm": lm.op2_lm,
        "op3_minhash": minhash.op3_minhash,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html": html.op5_html,
        "op6_lines": linededup.op6_lines,
        "op7_leaks": decontaminate.op7_leaks,
        "op8_quality": quality.op8_quality,
        "op9_repeats": suffixdedup.op9_repeats,
        "op10_mix": mixing.op10_mix,
    }


def oracle_sql() -> dict:
    return {
        "op3_minhash": minhash.OP3_SQL,
        "op6_lines": linededup.OP6_SQL,
        "op10_mix": mixing.OP10_SQL,
    }
