"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from . import bpe, embedding_dedup, fill_middle, html_extract, line_dedup, mixing, perspectives, quality_gam, quality_rules, simhash, token_alignment, token_counts, warc

_MODULES = (quality_rules, warc, line_dedup, mixing, token_counts, embedding_dedup, perspectives, bpe, simhash, quality_gam, fill_middle, html_extract, token_alignment)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
