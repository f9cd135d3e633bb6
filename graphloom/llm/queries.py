"""Queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

import importlib

_MODULES = ("q_simhash", "q_suffix", "q_packing", "q_substring", "q_suffix_tree", "q_langid", "q_quality", "q_ann", "q_topk", "q_mixing", "q_conversation", "q_merkle", "q_pii")


def load() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in _MODULES:
        module = importlib.import_module(f"graphloom.llm.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
