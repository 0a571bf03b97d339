"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from echoline.llm import oracles, queries

QUERIES = {name: getattr(queries, name) for name in ("p3_found", "p3_copies", "p4_found", "p4_shares", "p5_found", "p6_ids", "p7_containers", "p7_by_class", "p8_found")}
ORACLES = {name: getattr(oracles, name)() for name in ("p3_found", "p4_found")}
