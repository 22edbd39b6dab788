"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from codequarry.llm import alignment, divergence, exact_dedup, knn, line_dedup, mixing, packing, quality_model, quality_rules, sharding, simhash, suffix_dedup, token_files

MODULES = (mixing, quality_rules, token_files, suffix_dedup, sharding, packing, line_dedup, quality_model, exact_dedup, simhash, knn, divergence, alignment)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
