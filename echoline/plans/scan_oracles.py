"""SQL for the scanner's queries: brute force over all windows of lines, for DuckDB."""

from __future__ import annotations

from echoline.plans.scan import FOCUS, NO_FOCUS

FILES = "fl AS (SELECT file_id, coalesce(project, 'unknown') || '/' || path AS path, source_lines FROM prepared_files)"
LINES = "l AS (SELECT DISTINCT file_id, nline, segment_id, source_line, text, effective, context, scope FROM prepared_lines)"
#: Blanks at the ends of a line, as in the expressions (fixed values).
_B = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TEXTS = "dt AS (SELECT doc_id AS file_id, regexp_replace(text, '^\\x{feff}', '') AS source FROM documents WHERE text IS NOT NULL)"
PHYSICAL = TEXTS + r""",
ph AS (SELECT file_id, CAST(generate_subscripts(string_split(source, chr(10)), 1) - 1 AS INTEGER) AS source_line, unnest(string_split(source, chr(10))) AS raw FROM dt),
pc AS (SELECT file_id, source_line, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS content FROM ph)"""
TRIMMED = PHYSICAL + f""",
tl AS (SELECT file_id, source_line, regexp_replace(content, '^{_B}+|{_B}+$', '', 'g') AS text FROM pc),
nl AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY source_line) - 1 AS INTEGER) AS nline, 0 AS segment_id, source_line, text,
       regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AS effective FROM tl WHERE text <> '')"""


def _groups(m: int, same_file: bool = True, lines: str = "l", tag: str = "") -> str:
    """CTEs up to g{tag}: every occurrence of every kept group, with fingerprints; c{tag}: before containment."""
    cross = "" if same_file else "AND count(DISTINCT file_id) > 1"
    t = tag
    return f"""
d{t} AS (SELECT text, row_number() OVER () AS id FROM (SELECT DISTINCT text FROM {lines})),
s{t} AS (SELECT file_id, segment_id, min(nline) AS f, list(id ORDER BY nline) AS ts, list(CAST(effective AS INTEGER) ORDER BY nline) AS es FROM {lines} JOIN d{t} USING (text) GROUP BY ALL),
p{t} AS (SELECT *, unnest(range(1, len(ts) + 2 - {m})) AS i FROM s{t} WHERE len(ts) >= {m}),
k{t} AS (SELECT p.*, ts[i:i + {m - 1}] AS seed FROM p{t} p),
q{t} AS (SELECT k.* FROM k{t} k SEMI JOIN (SELECT seed FROM k{t} GROUP BY seed HAVING count(*) > 1) USING (seed)),
w{t} AS (SELECT file_id, f, ts, es, i, unnest(range({m}, len(ts) - i + 2)) AS n FROM q{t}),
v{t} AS (SELECT file_id, CAST(f + i - 1 AS INTEGER) AS nstart, n, ts[i:i + n - 1] AS b, CASE WHEN i > 1 THEN ts[i - 1] END AS prev, CASE WHEN i + n <= len(ts) THEN ts[i + n] END AS nxt, list_sum(es[i:i + n - 1]) AS eff FROM w{t}),
r{t} AS (SELECT b FROM v{t} GROUP BY b HAVING count(*) > 1 AND NOT (count(nxt) = count(*) AND count(DISTINCT nxt) = 1)),
o{t} AS (SELECT v.* FROM v{t} v SEMI JOIN r{t} USING (b)),
y{t} AS (SELECT b, n, file_id, list(nstart ORDER BY nstart) AS st FROM o{t} GROUP BY ALL),
z{t} AS (SELECT b, n, file_id, unnest(list_reduce(list_transform(st, lambda x: [x]), lambda a, x: CASE WHEN x[1] >= a[-1] + n THEN list_concat(a, x) ELSE a END)) AS nstart FROM y{t}),
h{t} AS (SELECT o.* FROM o{t} o SEMI JOIN z{t} z ON o.b = z.b AND o.file_id = z.file_id AND o.nstart = z.nstart),
x{t} AS (SELECT b FROM h{t} GROUP BY b HAVING count(*) > 1 {cross} AND min(eff) >= {m} AND NOT (count(nxt) = count(*) AND count(DISTINCT nxt) = 1) AND NOT (count(prev) = count(*) AND count(DISTINCT prev) = 1)),
e{t} AS (SELECT h.file_id, h.nstart, CAST(h.n AS INTEGER) AS nlen, CAST(h.eff AS INTEGER) AS lines, h.b FROM h{t} h SEMI JOIN x{t} USING (b)),
a{t} AS (SELECT b, lines, nlen, min({{'f': file_id, 's': nstart}}) AS at FROM e{t} GROUP BY ALL),
u{t} AS (SELECT a.b, string_agg(printf('%08X', strlen(x.text)) || hex(encode(x.text)), '' ORDER BY x.nline) AS hx FROM a{t} a JOIN {lines} x ON x.file_id = a.at.f AND x.nline BETWEEN a.at.s AND a.at.s + a.nlen - 1 GROUP BY a.b),
c{t} AS (SELECT e.file_id, e.nstart, e.nlen, e.lines,
  'echoline-finding-v1:sha256:' || sha256(unhex(hex(encode('echoline-finding-v1')) || '00' || printf('%08X', e.lines) || printf('%08X', e.nlen) || u.hx)) AS fingerprint,
  'sha256:' || sha256(unhex(hex(encode('echoline-baseline-group-v1')) || '00' || printf('%08X', e.lines) || u.hx)) AS baseline_fingerprint FROM e{t} e JOIN u{t} u USING (b)),
i{t} AS (SELECT s.fingerprint AS small, b.fingerprint AS big, count(DISTINCT (s.file_id, s.nstart)) AS n FROM c{t} s JOIN c{t} b ON s.file_id = b.file_id AND b.nlen > s.nlen AND b.nstart <= s.nstart AND b.nstart + b.nlen >= s.nstart + s.nlen GROUP BY ALL),
j{t} AS (SELECT DISTINCT small AS fingerprint FROM i{t} JOIN (SELECT fingerprint, count(*) AS size FROM c{t} GROUP BY ALL) z ON z.fingerprint = i{t}.small AND z.size = i{t}.n),
g{t} AS (SELECT c.* FROM c{t} c ANTI JOIN j{t} USING (fingerprint))"""


_SHAPE = "SELECT fingerprint, lines, nlen, count(*) AS occurrences, count(DISTINCT file_id) AS files FROM {} GROUP BY ALL"
_BASE = f"WITH {FILES}, {LINES}, {_groups(4)}"
_FOLD = "CASE WHEN min({0}) = max({0}) THEN min({0}) WHEN count({0}) > 0 THEN 'mixed' END AS {0}"
FINDINGS = f"""{_BASE},
fo AS (SELECT g.fingerprint, g.file_id, g.nstart, g.lines, {_FOLD.format('l.context')}, {_FOLD.format('l.scope')} FROM g JOIN l ON l.file_id = g.file_id AND l.nline BETWEEN g.nstart AND g.nstart + g.nlen - 1 GROUP BY ALL),
fi AS (SELECT fingerprint, lines, {_FOLD.format('context')}, {_FOLD.format('scope')}, count(*) AS occurrences, count(DISTINCT file_id) AS files FROM fo GROUP BY ALL),
fd AS (SELECT 'DUP001' AS code, *, CASE WHEN files <= 1 THEN 'same-file' WHEN occurrences > files THEN 'hybrid' ELSE 'cross-file' END AS distribution FROM fi)""".replace("AS l.context", "AS context").replace("AS l.scope", "AS scope")
LOCATIONS = "(SELECT g.fingerprint, fl.path, CAST(min(l.source_line) + 1 AS BIGINT) AS start_line, CAST(max(l.source_line) + 1 AS BIGINT) AS end_line FROM g JOIN fl USING (file_id) JOIN l ON l.file_id = g.file_id AND l.nline BETWEEN g.nstart AND g.nstart + g.nlen - 1 GROUP BY g.fingerprint, g.file_id, g.nstart, fl.path)"
REDUNDANT = """(SELECT DISTINCT l.file_id, l.nline FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY file_id, nstart) AS k FROM g) g
JOIN l ON l.file_id = g.file_id AND l.nline BETWEEN g.nstart AND g.nstart + g.nlen - 1 WHERE g.k > 1 AND l.effective)"""
BOTH = f"""WITH {FILES}, {LINES}, {_groups(4)}, {_groups(3, False, tag='3')},
bn AS (SELECT baseline_fingerprint AS fingerprint, lines, path, count(*) AS count FROM g JOIN fl USING (file_id) GROUP BY ALL),
bo AS (SELECT baseline_fingerprint AS fingerprint, lines, path, count(*) AS count FROM g3 JOIN fl USING (file_id) GROUP BY ALL),
st AS (SELECT coalesce(n.fingerprint, o.fingerprint) AS fingerprint, coalesce(n.lines, o.lines) AS lines, coalesce(n.path, o.path) AS path, least(coalesce(n.count, 0), coalesce(o.count, 0)) AS accepted,
  greatest(coalesce(n.count, 0) - coalesce(o.count, 0), 0) AS active, greatest(coalesce(o.count, 0) - coalesce(n.count, 0), 0) AS stale FROM bn n FULL JOIN bo o ON n.fingerprint = o.fingerprint AND n.path = o.path)"""
NESTED = f"""{FINDINGS}, lo AS {LOCATIONS}, ln AS (SELECT fingerprint, list({{'path': path, 'start_line': start_line, 'end_line': end_line}} ORDER BY path, start_line, end_line) AS spots FROM lo GROUP BY fingerprint),
ne AS (SELECT fd.*, ln.spots FROM fd JOIN ln USING (fingerprint))"""
SETTINGS = """st AS (SELECT project, root, CAST(coalesce(min_lines, 4) AS INTEGER) AS min_lines, coalesce(ignore_comments, true) AS ignore_comments, coalesce(ignore_docstrings, true) AS ignore_docstrings, coalesce(ignore_imports, true) AS ignore_imports,
coalesce(ignore_signatures, true) AS ignore_signatures, coalesce(same_file, true) AS same_file, coalesce(hidden, false) AS hidden, coalesce(exclude_patterns, []) AS exclude, CASE WHEN starts_with(baseline, '/') THEN baseline ELSE rtrim(root, '/') || '/' || baseline END AS baseline FROM scan_settings)"""
#: What the patterns of the settings mean, stated one by one.
_MEANING = {
    "**/_vendor/**": "(^|/)_vendor/", "**/migrations/*.py": r"(^|/)migrations/[^/]*\.py$", "*.min.js": r"\.min\.js(/|$)", "*_wire.py": r"_wire\.py(/|$)", ".venv/": r"(^|/)\.venv/", "build/**": "^build/",
    "docs/conf.py": r"^docs/conf\.py(/|$)", "lib/**/tables/": "^lib/(.*/)?tables/", "old/**": "^old/", "tests/**": "^tests/", "third_party/": "(^|/)third_party/",
}
# no pattern of the settings excludes src/gen, so the one that takes a file of it back decides nothing
DISCOVERED = "di AS (SELECT f.project, f.path, regexp_matches(f.path, '[^/]\\.pyi?$') AND (coalesce(s.hidden, false) OR NOT regexp_matches(f.path, '(^|/)\\.')) AND (path = 'src/gen/keep.py' AND list_contains(coalesce(s.exclude, []), '!src/gen/keep.py') OR NOT (" + " OR ".join(f"list_contains(coalesce(s.exclude, []), '{p}') AND regexp_matches(f.path, '{r}')" for p, r in _MEANING.items()) + ")) AS taken FROM source_files f LEFT JOIN st s ON s.project = f.project)"
RAW = "coalesce(project, 'unknown') || '/' || path"

ORACLES = {
    "source_line_counts": "SELECT doc_id AS file_id, CAST(len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS source_lines FROM documents WHERE text IS NOT NULL",
    "physical_lines": f"WITH {PHYSICAL} SELECT file_id, source_line, content FROM pc",
    "normalized_lines": f"WITH {TRIMMED} SELECT file_id, nline, segment_id, source_line, text, effective FROM nl",
    "effective_lines": f"WITH {LINES} SELECT file_id, count(*) AS lines, count(*) FILTER (effective) AS effective_lines FROM l GROUP BY file_id",
    "file_order": f"WITH {FILES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS file_id FROM (SELECT DISTINCT path FROM fl)",
    "duplicate_paths": "SELECT name AS path FROM (SELECT list_last(string_split(path, '/')) AS name FROM prepared_files) GROUP BY name HAVING count(*) > 1",
    "invalid_segments": f"""WITH {LINES.replace(' FROM prepared_lines', ' FROM prepared_lines WHERE effective')} SELECT file_id FROM (SELECT file_id, segment_id FROM l GROUP BY ALL HAVING max(nline) - min(nline) + 1 <> count(*))
UNION SELECT file_id FROM (SELECT file_id FROM l GROUP BY ALL HAVING min(nline) <> 0 OR max(nline) + 1 <> count(*))""",
    "line_dictionary": f"WITH {LINES} SELECT text, row_number() OVER (ORDER BY f) - 1 AS line_id FROM (SELECT text, min({{'f': file_id, 'n': nline}}) AS f FROM l GROUP BY text)",
    "corpus_tokens": f"""WITH {LINES}, d AS (SELECT text, row_number() OVER (ORDER BY f) - 1 AS id FROM (SELECT text, min({{'f': file_id, 'n': nline}}) AS f FROM l GROUP BY text)),
e AS (SELECT file_id, segment_id, max(nline) + 1 AS nline FROM l GROUP BY ALL),
t AS (SELECT file_id, segment_id, nline, id AS token, false AS is_sentinel FROM l JOIN d USING (text)
UNION ALL SELECT file_id, segment_id, nline, row_number() OVER (ORDER BY file_id, segment_id) - 1 + (SELECT count(*) FROM d), true FROM e)
SELECT row_number() OVER (ORDER BY file_id, segment_id, nline) - 1 AS pos, token, CASE WHEN NOT is_sentinel THEN file_id END AS file_id, CASE WHEN NOT is_sentinel THEN nline END AS nline,
CASE WHEN NOT is_sentinel THEN segment_id END AS segment_id, is_sentinel FROM t""",
    "suffix_order": f"""WITH {LINES}, d AS (SELECT text, row_number() OVER (ORDER BY f) - 1 AS id FROM (SELECT text, min({{'f': file_id, 'n': nline}}) AS f FROM l GROUP BY text)),
s AS (SELECT file_id, segment_id, list(id ORDER BY nline) AS ts, row_number() OVER (ORDER BY file_id, segment_id) - 1 AS k FROM l JOIN d USING (text) GROUP BY file_id, segment_id),
b AS (SELECT list_append(ts, k + (SELECT count(*) FROM d)) AS ts, coalesce(sum(len(ts) + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s),
x AS (SELECT CAST(o AS BIGINT) + i - 1 AS pos, ts[i:] AS t FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM b)),
r AS (SELECT pos, t, row_number() OVER (ORDER BY t) - 1 AS rank, lag(t) OVER (ORDER BY t) AS q FROM x)
SELECT pos, rank, CAST(CASE WHEN q IS NULL THEN 0 ELSE coalesce(list_position([t[i] = q[i] FOR i IN range(1, least(len(t), len(q)) + 1)], false) - 1, least(len(t), len(q))) END AS BIGINT) AS lcp FROM r""",
    "repeated_seeds": f"""WITH {LINES}, t AS (SELECT *, lag(text) OVER w AS prev, lead(text, 4) OVER w AS nxt, list(text) OVER (PARTITION BY file_id, segment_id ORDER BY nline ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM l WINDOW w AS (PARTITION BY file_id, segment_id ORDER BY nline)),
s AS (SELECT b, NOT (count(prev) = count(*) AND count(DISTINCT prev) = 1) AS starts, NOT (count(nxt) = count(*) AND count(DISTINCT nxt) = 1) AS ends FROM t WHERE len(b) = 4 GROUP BY b HAVING count(*) > 1) SELECT file_id, nline, starts, ends FROM t JOIN s USING (b)""",
    "candidate_groups": f"{_BASE} {_SHAPE.format('c')}",
    "contained_groups": f"""{_BASE}, kk AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY file_id, nstart) AS r FROM g),
al AS (SELECT fingerprint, file_id, nstart, nlen FROM kk UNION ALL SELECT fingerprint || '-inner', file_id, nstart + 1, nlen - 2 FROM kk WHERE nlen >= 5
 UNION ALL SELECT fingerprint || '-more', file_id, nstart + 1, nlen - 2 FROM kk WHERE nlen >= 5 UNION ALL SELECT fingerprint || '-more', file_id, nstart + 1000001, nlen - 2 FROM kk WHERE nlen >= 5 AND r = 1),
sz AS (SELECT fingerprint, count(*) AS n FROM al GROUP BY ALL),
cv AS (SELECT s.fingerprint, b.fingerprint AS big, count(DISTINCT (s.file_id, s.nstart)) AS n FROM al s JOIN al b ON s.file_id = b.file_id AND b.nlen > s.nlen AND b.nstart <= s.nstart AND b.nstart + b.nlen >= s.nstart + s.nlen GROUP BY ALL)
SELECT DISTINCT fingerprint FROM cv JOIN sz USING (fingerprint, n)""",
    "duplicate_groups": f"{_BASE} {_SHAPE.format('g')}",
    "duplicate_groups_min2": f"WITH {LINES}, {_groups(2)} {_SHAPE.format('g')}",
    "duplicate_groups_cross_file": f"WITH {LINES}, {_groups(4, False)} {_SHAPE.format('g')}",
    "duplicate_occurrences": f"{_BASE} SELECT fingerprint, file_id, nstart, nlen FROM g",
    "text_groups": f"WITH {TRIMMED}, {_groups(4, lines='nl')} {_SHAPE.format('g')}",
    "finding_rows": f"{FINDINGS} SELECT * FROM fd",
    "finding_locations": f"{_BASE} SELECT * FROM {LOCATIONS}",
    "ten_largest": f"{FINDINGS} SELECT fingerprint, lines, occurrences FROM fd ORDER BY lines DESC, fingerprint LIMIT 10",
    "class_counts": f"{FINDINGS} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, count(*) AS findings FROM fd GROUP BY {k}" for k in ("distribution", "context", "scope")),
    "length_buckets": f"{FINDINGS} SELECT min(lines) AS shortest, max(lines) AS longest, count(*) FILTER (lines BETWEEN 4 AND 9) AS lines_4_9, count(*) FILTER (lines BETWEEN 10 AND 19) AS lines_10_19, count(*) FILTER (lines >= 20) AS lines_20_up FROM fd",
    "groups_touching_path": f"{_BASE} SELECT fingerprint, bool_or(contains(path, '/tests/')) AS touches FROM {LOCATIONS} GROUP BY fingerprint",
    "metrics_summary": f"""{_BASE}, m AS (SELECT (SELECT count(*) FROM fl) AS files, CAST((SELECT sum(source_lines) FROM fl) AS BIGINT) AS source_lines, (SELECT count(*) FROM l WHERE effective) AS analyzed_lines,
(SELECT count(DISTINCT fingerprint) FROM g) AS duplicate_groups, (SELECT count(*) FROM {REDUNDANT}) AS duplicate_lines) SELECT *, CASE WHEN analyzed_lines = 0 THEN 0.0 ELSE CAST(duplicate_lines AS DOUBLE) / analyzed_lines * 100 END AS duplication_percent FROM m""",
    "redundant_lines": f"{_BASE} SELECT * FROM {REDUNDANT}",
    "path_counts": f"{_BASE} SELECT fingerprint, path, count(*) AS count FROM g JOIN fl USING (file_id) GROUP BY ALL",
    "baseline_build": f"{_BASE} SELECT baseline_fingerprint AS fingerprint, lines, path, count(*) AS count FROM g JOIN fl USING (file_id) GROUP BY ALL",
    "baseline_status": f"{BOTH} SELECT * FROM st",
    "baseline_totals": f"{BOTH} SELECT CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(active) AS BIGINT) AS active, CAST(sum(stale) AS BIGINT) AS stale FROM st",
    "baseline_active_groups": f"{BOTH} SELECT fingerprint, file_id, nstart FROM g WHERE baseline_fingerprint IN (SELECT fingerprint FROM st WHERE active > 0)",
    "baseline_prune": f"{BOTH} SELECT o.fingerprint, o.lines, o.path, least(o.count, n.count) AS count FROM bo o JOIN bn n ON n.fingerprint = o.fingerprint AND n.path = o.path",
    "baseline_problems": f"""{_BASE}, bb AS (SELECT baseline_fingerprint AS fp, lines, path, count(*) AS n, substr(baseline_fingerprint, 8, 1) AS x FROM g JOIN fl USING (file_id) GROUP BY ALL),
br AS (SELECT CASE WHEN x = '0' THEN upper(fp) ELSE fp END AS fingerprint, CASE WHEN x = '1' THEN 0 WHEN x = '5' AND length(path) % 2 = 0 THEN lines + 1 ELSE lines END AS lines,
 CASE WHEN x = '2' THEN '/' || path WHEN x = '6' THEN path || '/../x' ELSE path END AS path, CASE WHEN x = '3' THEN 0 ELSE n END AS n, x FROM bb),
b2 AS (SELECT * FROM br UNION ALL SELECT * FROM br WHERE x = '4')
SELECT fingerprint, path, CASE x WHEN '0' THEN 'invalid fingerprint' WHEN '1' THEN 'no lines' WHEN '2' THEN 'invalid path' WHEN '6' THEN 'invalid path' WHEN '3' THEN 'no occurrences' END AS reason FROM b2 WHERE x IN ('0', '1', '2', '3', '6')
UNION ALL SELECT fingerprint, path, 'duplicate path' FROM br WHERE x = '4'
UNION ALL SELECT fingerprint, NULL, 'duplicate group' FROM b2 GROUP BY fingerprint HAVING count(DISTINCT lines) > 1""",
    "focused_groups": f"{_BASE} SELECT fingerprint, file_id, nstart FROM g WHERE fingerprint IN (SELECT fingerprint FROM g JOIN fl USING (file_id) WHERE "
    + " OR ".join(f"path = '{s}' OR starts_with(path, '{s}/')" for s in FOCUS)
    + ")",
    "virtual_overlay": f"WITH v AS (SELECT DISTINCT {RAW} AS path FROM source_files) SELECT DISTINCT {RAW} AS path, 'disk' AS origin FROM prepared_files WHERE {RAW} NOT IN (SELECT path FROM v) UNION ALL SELECT path, 'virtual' FROM v",
    "exclude_filter": r"""SELECT file_id, path FROM source_files WHERE regexp_matches(path, '[^/]\.pyi?$') AND NOT (
(regexp_matches(path, '^build/|^docs/conf\.py$|(^|/)third_party/|(^|/)\.venv/|(^|/)_vendor/|_wire\.py$|^lib/(.*/)?tables/|\.min\.js$|^tests/unit/[^/]*/[a-m][^/]*\.py$')
 OR (starts_with(path, 'src/gen/') AND path <> 'src/gen/keep.py')))""",
    "python_lines": "SELECT DISTINCT file_id, nline, source_line, text, effective FROM prepared_lines",
    "keep_going_errors": "SELECT file_id, path, 'parse' AS kind FROM prepared_files WHERE normalized IS NULL",
    "directive_lines": f"""WITH {TRIMMED.replace("regexp_replace(text, '^", "regexp_replace(replace(replace(text, chr(10) || '- ', chr(10) || '# echoline: enable' || chr(10) || '- '), chr(10) || chr(10), chr(10) || '# echoline: disable' || chr(10)), '^")},
ev AS (SELECT *, CASE text WHEN '# echoline: disable' THEN 1 WHEN '# echoline: enable' THEN 0 END AS e FROM tl),
sr AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY source_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ev),
sg AS (SELECT *, coalesce(sum(CASE WHEN e = 1 AND off = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY source_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sr)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY source_line) - 1 AS INTEGER) AS nline, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY s) - 1 AS INTEGER) AS segment_id, source_line, text,
 regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') AS effective FROM sg WHERE e IS NULL AND off = 0 AND text <> ''""",
    "project_settings": f"WITH {SETTINGS} SELECT * FROM st",
    "discovered_files": f"WITH {SETTINGS}, {DISCOVERED} SELECT DISTINCT project, path FROM di WHERE taken",
    "undiscovered_files": f"WITH {SETTINGS}, {DISCOVERED} SELECT project, path FROM source_files EXCEPT SELECT project, path FROM di WHERE taken",
    "unmatched_selectors": f"WITH {FILES}, s AS (SELECT rtrim(unnest({[*FOCUS, *NO_FOCUS]}), '/') AS selector) SELECT selector FROM s WHERE NOT EXISTS (SELECT 1 FROM fl WHERE path = selector OR starts_with(path, selector || '/'))",
    "groups_within_path": f"{_BASE} SELECT fingerprint, bool_or(ends_with(path, '.pyi')) AS touches, bool_and(contains(path, '/src/')) AS within FROM {LOCATIONS} GROUP BY fingerprint",
    "invalid_groups": f"""{_BASE} SELECT fingerprint, CASE right(fingerprint, 1) WHEN '0' THEN 'unknown file' WHEN '1' THEN 'out of range' WHEN '3' THEN 'duplicate occurrence' END AS reason FROM g WHERE right(fingerprint, 1) IN ('0', '1', '3') GROUP BY ALL
UNION ALL SELECT fingerprint, 'different lengths' FROM g WHERE right(fingerprint, 1) = '2' GROUP BY fingerprint HAVING count(DISTINCT file_id % 2) > 1
UNION ALL SELECT DISTINCT fingerprint, 'out of range' FROM g JOIN (SELECT file_id, max(nline) + 1 AS n FROM l GROUP BY file_id) z USING (file_id) WHERE right(fingerprint, 1) = '2' AND file_id % 2 = 0 AND nstart + nlen + 1 > z.n""",
    "finding_order": f"{NESTED} SELECT fingerprint, row_number() OVER (ORDER BY spots[1].path, spots[1].start_line, lines DESC, spots, fingerprint) - 1 AS place FROM ne",
    "finding_snippets": f"""{_BASE}, lo AS {LOCATIONS} SELECT fingerprint, path, start_line, end_line, array_to_string(list_slice(string_split(regexp_replace(regexp_replace(source, '^\\x{{feff}}', ''), '\\r(\\n|$)', '\\1', 'g'), chr(10)), start_line, end_line), chr(10)) AS source
FROM lo JOIN (SELECT coalesce(project, 'unknown') || '/' || path AS path, source FROM prepared_files) USING (path)""",
    "report_json_lines": f"{NESTED} SELECT fingerprint, CAST(to_json({{'code': code, 'fingerprint': fingerprint, 'lines': lines, 'context': context, 'scope': scope, 'occurrences': occurrences, 'files': files, 'distribution': distribution, 'locations': spots}}) AS VARCHAR) AS document FROM ne",
    "report_text": f"""{NESTED} SELECT fingerprint, 'DUP001 ' || lines || ' duplicated lines' || chr(10) || 'Context: ' || context || chr(10) || 'Scope: ' || scope || chr(10) || 'Occurrences: ' || occurrences || ' across ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END
|| ' (' || distribution || ')' || chr(10) || chr(10) || array_to_string(list_transform(spots, lambda x: '  ' || x.path || ':' || x.start_line || '-' || x.end_line || chr(10)), '') || chr(10) AS document FROM ne""",
    "report_markdown": f"""{NESTED} SELECT fingerprint, '## `DUP001` — ' || lines || ' duplicated lines' || chr(10) || chr(10) || '**Context:** ' || context || '  ' || chr(10) || '**Scope:** ' || scope || '  ' || chr(10) || '**Occurrences:** ' || occurrences || ' across ' || files
|| CASE WHEN files = 1 THEN ' file' ELSE ' files' END || ' _(' || distribution || ')_' || chr(10) || chr(10) || array_to_string(list_transform(spots, lambda x: '### `' || x.path || ':' || x.start_line || '-' || x.end_line || '`' || chr(10)), chr(10)) AS document FROM ne""",
    "report_sarif": f"""{NESTED}, pl AS (SELECT *, list_transform(spots, lambda x: {{'physicalLocation': {{'artifactLocation': {{'uri': replace(url_encode(x.path), '%2F', '/')}}, 'region': {{'startLine': x.start_line, 'endLine': x.end_line}}}}}}) AS p FROM ne)
SELECT fingerprint, CAST(to_json({{'ruleId': code, 'message': {{'text': lines || ' duplicated lines across ' || occurrences || ' occurrences in ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END}}, 'partialFingerprints': {{'echolineFindingFingerprint/v1': fingerprint}}, 'locations': p[1:1], 'relatedLocations': p[2:],
 'properties': {{'lines': lines, 'context': context, 'scope': scope, 'occurrences': occurrences, 'files': files, 'distribution': distribution}}}}) AS VARCHAR) AS document FROM pl""",
    "baseline_json_lines": f"""{_BASE}, bb AS (SELECT baseline_fingerprint AS fp, lines, path, count(*) AS n FROM g JOIN fl USING (file_id) GROUP BY ALL),
bl AS (SELECT fp, lines, list({{'path': path, 'count': n}} ORDER BY path, n) AS o FROM bb GROUP BY ALL) SELECT fp AS fingerprint, CAST(to_json({{'fingerprint': fp, 'lines': lines, 'occurrences': o}}) AS VARCHAR) AS document FROM bl""",
    "baseline_status_groups": f"{BOTH} SELECT fingerprint, lines, count(*) AS paths, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(active) AS BIGINT) AS active, CAST(sum(stale) AS BIGINT) AS stale, CAST(sum(active) > 0 AS INTEGER) AS exit_status FROM st GROUP BY ALL",
}
