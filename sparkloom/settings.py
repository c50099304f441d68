"""Defaults of requests and of the index; environment variables ``SPARKLOOM_<NAME>`` override them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_page: int = 9999
    query_limit: int = 20
    facet_size: int = 20
    anonymous_facet_size: int = 50
    fuzziness_short: int = 2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_b_name: float = 0.25
    function_score: bool = False
    weight_pages: float = 1.0
    weight_documents: float = 1.0
    weight_intervals: float = 1.0
    weight_things: float = 1.0
    significant_min_doc_count: int = 5
    significant_sampler: str = "none"
    significant_sample_share: float = 0.1
    significant_sample_size: int = 2000
    significant_text_sample_size: int = 200
    highlight_fragment: int = 200
    highlight_fragments: int = 3
    highlight_no_match: int = 300
    highlight_most: int = 100_000
    mlt_min_doc_freq: int = 1
    mlt_minimum_should_match: str = "10%"
    mlt_min_term_freq: int = 1
    mlt_max_query_terms: int = 200
    mlt_min_word_length: int = 5
    mlt_max_doc_freq: int = 500
    match_names: int = 5
    match_name_parts: bool = True
    match_phonetic: bool = True
    match_symbols: bool = True
    single_token_length: int = 10
    percolation: bool = True
    percolate_slop: int = 2
    mention_names: int = 10_000
    id_namespace: bool = False


def load() -> Settings:
    """The defaults with what the environment says. A value of the wrong kind is an error."""
    out = {}
    for f in fields(Settings):
        raw = os.environ.get(f"SPARKLOOM_{f.name.upper()}")
        if raw is not None:
            kind = type(f.default)
            out[f.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    return Settings(**out)


SETTINGS = load()
