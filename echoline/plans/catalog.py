"""All queries of the core, and the SQL they are compared with."""

from __future__ import annotations

from echoline.plans import oracles, reports, scan, scan_oracles

FLAGSHIP = "duplicate_groups"
REPORTS = ("p1_found", "p1_types", "p1_table", "p1_union", "p2_found")
QUERIES = {name: getattr(reports, name) for name in REPORTS} | {name: getattr(scan, name) for name in scan.names()}
ORACLES = {"p2_found": oracles.p2_found()} | scan_oracles.ORACLES
