"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from gymlake.llm import (
    chat_queries,
    html_queries,
    media,
    merkle_queries,
    mixing_queries,
    ngram_join_queries,
    packing_queries,
    quality_model_queries,
    quality_rules_queries,
    rolling_queries,
    substring_queries,
    toxicity_queries,
    url_rules_queries,
)

_MODULES = (
    quality_rules_queries,
    quality_model_queries,
    html_queries,
    media,
    ngram_join_queries,
    packing_queries,
    substring_queries,
    mixing_queries,
    chat_queries,
    toxicity_queries,
    url_rules_queries,
    rolling_queries,
    merkle_queries,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
