"""The registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from registry import learning, tables, text, tokens, vectors

FAMILIES = (text, tokens, tables, vectors, learning)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
