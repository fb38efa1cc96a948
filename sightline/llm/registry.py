"""Queries and SQL of all operators of this subpackage."""

from __future__ import annotations

from sightline.llm import bpe, decontaminate, lexical, line_dedup, orchard, quality_model, quality_rules, quotation, simhash, token_counts, token_files, url_rules, warc

MODULES = [warc, token_files, line_dedup, url_rules, decontaminate, quality_model, quotation, quality_rules, simhash, bpe, lexical, orchard, token_counts]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
