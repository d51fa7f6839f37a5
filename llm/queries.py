"""Imports every module that registers queries."""

from llm import (  # noqa: F401
    bpe,
    chat,
    decontaminate,
    grades,
    html,
    kneser_ney,
    merkle,
    pii,
    quality_rules,
    repeats,
    simhash,
    toxicity,
    trie,
)
from llm.registry import QUERIES, SQL  # noqa: F401
