"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

from foliotab.llm import ann, bpe, decontaminate, edits, hard_negatives, html_text, langid, linedup, links, neardup, nodes, packing, resample, secrets, sharding, token_counts, toxicity, worker, words
from foliotab.session import ship_by_value

for _module in (ann, bpe, decontaminate, edits, hard_negatives, html_text, langid, linedup, links, neardup, nodes, packing, resample, secrets, sharding, token_counts, toxicity, worker, words):
    ship_by_value(_module.__name__)
