"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from geosieve.llm import (
    queries_decontaminate, queries_html, queries_minhash, queries_models, queries_pieces, queries_private,
    queries_prefixes, queries_suffixes, queries_tokens, queries_urls, queries_variants, queries_vectors,
)

MODULES = [
    queries_decontaminate, queries_minhash, queries_urls, queries_models, queries_vectors, queries_suffixes,
    queries_html, queries_private, queries_pieces, queries_tokens, queries_prefixes, queries_variants,
]
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
