"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import conversation_trie, decontamination, language_id, licenses, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity, url_filters, vector_codes

_MODULES = (quality_rules, simhash, substring_dedup, decontamination, quality_classifier, toxicity, sharding, mixing, url_filters, licenses, conversation_trie, vector_codes, language_id)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
