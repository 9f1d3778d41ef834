"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, html_text, jaccard, licenses, mixing, packing, quality_model, quality_rules, sharding, toxicity

MODULES = (sharding, packing, toxicity, licenses, html_text, jaccard, mixing, ann, quality_rules, quality_model)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
