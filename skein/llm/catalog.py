"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from skein.llm import decontam, htmltext, mixing, neardup, pii, quality, secrets, substring, suffix, topk

_ALL = {
    "op1_html": htmltext,
    "op2_mix": mixing,
    "op3_suffix": suffix,
    "op4_substring": substring,
    "op5_topk": topk,
    "op6_pii": pii,
    "op7_secrets": secrets,
    "op8_quality": quality,
    "op9_neardup": neardup,
    "op10_decontam": decontam,
}


def queries():
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql():
    return {name: module.SQL for name, module in _ALL.items() if hasattr(module, "SQL")}
