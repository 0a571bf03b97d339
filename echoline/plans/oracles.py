"""SQL that states the core's queries in another way, for DuckDB."""

from __future__ import annotations

#: Inside a DuckDB pattern (fixed values).
_BLANK = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_COPY_COLUMNS = {
    "schema_version": "a.schema_version IS DISTINCT FROM b.schema_version",
    "tool_version": "a.tool_version IS DISTINCT FROM b.tool_version",
    "complete": "a.complete IS DISTINCT FROM b.complete",
    "files": "a.files IS DISTINCT FROM b.files",
    "source_lines": "a.source_lines IS DISTINCT FROM b.source_lines",
    "analyzed_lines": "a.analyzed_lines IS DISTINCT FROM b.analyzed_lines",
    "duplicate_groups": "a.duplicate_groups IS DISTINCT FROM b.duplicate_groups",
    "duplicate_lines": "a.duplicate_lines IS DISTINCT FROM b.duplicate_lines",
    "duplication_percent": "coalesce(abs(a.duplication_percent - b.duplication_percent) > 0.000001, a.duplication_percent IS DISTINCT FROM b.duplication_percent)",
    "findings": "list_sort(list_transform(a.findings, lambda x: CAST(x AS VARCHAR))) IS DISTINCT FROM list_sort(list_transform(b.findings, lambda x: CAST(x AS VARCHAR)))",
    "produced_at": "date_trunc('second', a.produced_at) IS DISTINCT FROM date_trunc('second', b.produced_at)",
}


def _latest(name: str) -> str:
    return (
        f"SELECT * EXCLUDE (project), lower(regexp_replace(project, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS project FROM {name} "
        f"QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(project, '^{_BLANK}+|{_BLANK}+$', '', 'g')), run_no ORDER BY loaded_at DESC NULLS LAST) = 1"
    )


def p2_found() -> str:
    on = "a.project IS NOT DISTINCT FROM b.project AND a.run_no IS NOT DISTINCT FROM b.run_no"
    pairs = ", ".join(f"{test} AS t_{c}" for c, test in _COPY_COLUMNS.items())
    cases = " UNION ALL ".join(f"SELECT project, run_no, '{c}' AS field_name, 'differs' AS diff_kind FROM pairs WHERE t_{c}" for c in _COPY_COLUMNS)
    return (
        f"WITH a AS ({_latest('reports')}), b AS ({_latest('reports_mirror')}), "
        f"pairs AS (SELECT a.project, a.run_no, {pairs} FROM a JOIN b ON {on}) {cases} "
        f"UNION ALL SELECT project, run_no, '*', 'missing_in_mirror' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {on}) "
        f"UNION ALL SELECT project, run_no, '*', 'missing_in_reports' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {on})"
    )
