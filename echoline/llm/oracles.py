"""SQL that states the training-data queries in another way, for DuckDB."""

from __future__ import annotations

_OPTIONS = ("ignore_comments", "ignore_docstrings", "ignore_imports", "ignore_signatures")


def p3_found() -> str:
    named = " || ".join(
        f"CASE WHEN regexp_matches(translate(lower(coalesce(option_json, '')), '-', '_'), '\"{o}\"\\s*:\\s*false') THEN '0' ELSE '1' END" for o in _OPTIONS
    )
    return (
        f"WITH k AS (SELECT file_id, {named} AS o, regexp_replace(lower(normalized), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS t FROM prepared_files WHERE normalized IS NOT NULL), "
        "g AS (SELECT file_id, min(file_id) OVER (PARTITION BY o, t) AS first_id FROM k WHERE t <> '') "
        "SELECT first_id, file_id AS copy_id FROM g WHERE file_id <> first_id"
    )


def p4_found() -> str:
    """Windows of 8 lines compared as text, without anchors or digests."""
    return """
WITH l AS (SELECT file_id, unnest(string_split(normalized, chr(10))) AS t, generate_subscripts(string_split(normalized, chr(10)), 1) - 1 AS n
           FROM prepared_files WHERE normalized IS NOT NULL),
d AS (SELECT t, row_number() OVER () AS id FROM (SELECT DISTINCT t FROM l)),
f AS (SELECT file_id, list(d.id ORDER BY n) AS ids FROM l JOIN d USING (t) GROUP BY file_id),
w AS (SELECT file_id, unnest(range(0, len(ids) - 7)) AS s, unnest([list_slice(ids, x + 1, x + 8) FOR x IN range(0, len(ids) - 7)]) AS k FROM f WHERE len(ids) >= 8),
r AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT file_id) > 1),
m AS (SELECT DISTINCT file_id, s + o.o AS n FROM w SEMI JOIN r USING (k), (SELECT unnest(range(0, 8)) AS o) o),
i AS (SELECT file_id, n, n - row_number() OVER (PARTITION BY file_id ORDER BY n) AS g FROM m)
SELECT file_id, CAST(min(n) AS INTEGER) AS first_line, CAST(max(n) AS INTEGER) AS last_line FROM i GROUP BY file_id, g
"""
