"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from cohortloom.llm import (
    bpe,
    collocations,
    embedding_dedup,
    lexical_search,
    licenses,
    mixing,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)

_MODULES = (licenses, toxicity, embedding_dedup, suffix_dedup, quality_model, simhash, mixing,
            sharding, bpe, quality_rules, collocations, packing, lexical_search)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
