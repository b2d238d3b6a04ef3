"""Queries of the training-data operators, and the SQL that states them."""

from __future__ import annotations

from . import chat, decontaminate, near_dup, pieces, pii, quality, token_store, topk, toxicity, url_filter

MODULES = [pieces, topk, token_store, url_filter, toxicity, near_dup, pii, quality, chat, decontaminate]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
