"""Reports as text, JSON, Markdown and SARIF. They are made on the driver from a report document."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

from echoline import __version__
from echoline.functions.fingerprint import TOOL

#: Versions of the documents (fixed values).
REPORT_VERSION, ERROR_VERSION, BASELINE_VERSION, CAPABILITIES_VERSION, CONFIG_VERSION, STATUS_VERSION = 4, 1, 1, 1, 1, 1
FORMATS = ("json", "markdown", "sarif", "text")
FEATURES = ("baseline-prune", "baseline-status", "focus", "keep-going", "multi-report", "no-fail-on-findings", "stdin-path", "workers-auto")
#: Styles of coloured text as SGR codes (fixed values, those of the published output).
STYLES = {"code": ("1", "33"), "problem": ("1", "31"), "good": ("1", "32"), "head": ("1",), "class": ("1", "35"), "kind": ("1", "34"), "group": ("1", "38;5;208"), "path": ("1", "36"), "place": ("36",), "gutter": ("2",)}


class IncompleteReport(Exception):
    pass


def _pretty(document: object) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)


def _plural(n: int, word: str) -> str:
    return word if n == 1 else word + "s"


def render_json(report: dict) -> str:
    return _pretty(report)


def _paint(color: bool):
    return lambda style, text: "".join(f"\x1b[{c}m" for c in STYLES[style]) + f"{text}\x1b[0m" if color else str(text)


def finding_text(f: dict, color: bool = False) -> list[str]:
    """The lines of one finding."""
    paint, out = _paint(color), []
    out.append(f"{paint('code', f['code'])} {paint('problem', f'{f["lines"]} duplicated {_plural(f["lines"], "line")}')}")
    out.append(f"{paint('head', 'Context:')} {paint('class', f['context'])}")
    out.append(f"{paint('head', 'Scope:')} {paint('class', f['scope'])}")
    where = f"{paint('head', f['occurrences'])} across {paint('head', f['files'])} {_plural(f['files'], 'file')}"
    out.append(f"{paint('head', 'Occurrences:')} {where} {paint('kind', '(' + f['distribution'] + ')')}")
    out.append("")
    for at in f["locations"]:
        out.append("  " + paint("path", at["path"]) + paint("place", f":{at['start_line']}-{at['end_line']}"))
        for k, line in enumerate(_source_lines(at.get("source"))):
            out.append(paint("gutter", f"    {at['start_line'] + k:>4} | ") + line)
    return [*out, ""]


def render_text(report: dict, color: bool = False) -> str:
    paint = _paint(color)
    out = [line for f in report["findings"] for line in finding_text(f, color)]
    n, lines = report["duplicate_groups"], report["duplicate_lines"]
    out.append(f"Found {paint('group', f'{n} duplicate {_plural(n, "group")}')}." if report["findings"] else paint("good", "No duplicate code found."))
    out.append(f"{paint('problem' if lines else 'good', f'{lines} duplicate {_plural(lines, "line")}')} {paint('head', f'({report["duplication_percent"]:.2f}%)')}.")
    return "\n".join(out) + "\n"


def _source_lines(source: str | None) -> list[str]:
    return source.removesuffix("\n").split("\n") if source else []


def _longest_ticks(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def _inline(text: str) -> str:
    fence = "`" * (_longest_ticks(text) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return fence + pad + text + pad + fence


def finding_markdown(f: dict) -> list[str]:
    """The paragraphs of one finding."""
    parts = [f"## `{f['code']}` — {f['lines']} duplicated {_plural(f['lines'], 'line')}\n"]
    where = f"{f['occurrences']} across {f['files']} {_plural(f['files'], 'file')} _({f['distribution']})_"
    parts.append(f"**Context:** {f['context']}  \n**Scope:** {f['scope']}  \n**Occurrences:** {where}\n")
    for at in f["locations"]:
        parts.append("### " + _inline(f"{at['path']}:{at['start_line']}-{at['end_line']}") + "\n")
        if at.get("source") is not None:
            fence = "`" * max(3, _longest_ticks(at["source"]) + 1)
            body = at["source"] if at["source"].endswith("\n") else at["source"] + "\n"
            parts.append(f"{fence}python\n{body}{fence}\n")
    return parts


def render_markdown(report: dict, title: str = TOOL.capitalize()) -> str:
    parts = [f"# {title} duplicate-code report\n"]
    if not report["complete"]:
        parts.append("> **Warning:** Scan incomplete. Results include only successfully processed source.\n")
        if report["errors"]:
            told = [f"- {_inline(e['path']) + ': ' if e.get('path') else ''}{e['message']}" for e in report["errors"]]
            parts.append("## Processing errors\n\n" + "\n".join(told) + "\n")
    if not report["findings"]:
        parts.append("No duplicate code found" + ("" if report["complete"] else " in successfully processed source") + ".\n")
    for f in report["findings"]:
        parts += finding_markdown(f)
    figures = [("Files", "files"), ("Source lines", "source_lines"), ("Analyzed lines", "analyzed_lines"), ("Duplicate groups", "duplicate_groups"), ("Duplicate lines", "duplicate_lines")]
    summary = [f"- **{name}:** {report[key]}" for name, key in figures] + [f"- **Duplication:** {report['duplication_percent']:.2f}%"]
    return "\n".join(parts) + "\n## Summary\n\n" + "\n".join(summary) + "\n"


def _sarif_place(at: dict) -> dict:
    region = {"startLine": at["start_line"], "endLine": at["end_line"]}
    if at.get("source") is not None:
        region["snippet"] = {"text": at["source"]}
    return {"physicalLocation": {"artifactLocation": {"uri": quote(at["path"].replace("\\", "/"), safe="/-._~")}, "region": region}}


def finding_sarif(f: dict, tool: str = TOOL) -> dict:
    """The SARIF result of one finding: its first location is primary, the rest are related."""
    first, *rest = map(_sarif_place, f["locations"])
    told = f"{f['lines']} duplicated {_plural(f['lines'], 'line')} across {f['occurrences']} occurrences in {f['files']} {_plural(f['files'], 'file')}"
    result = {"ruleId": f["code"], "message": {"text": told}, "partialFingerprints": {f"{tool}FindingFingerprint/v1": f["fingerprint"]}, "locations": [first]}
    if rest:
        result["relatedLocations"] = rest
    result["properties"] = {k: f[k] for k in ("lines", "context", "scope", "occurrences", "files", "distribution")}
    return result


def render_sarif(report: dict, tool: str = TOOL) -> str:
    """SARIF 2.1.0; an incomplete report can't be told in it."""
    if not report["complete"]:
        raise IncompleteReport("cannot render SARIF for an incomplete report")
    results = [finding_sarif(f, tool) for f in report["findings"]]
    rule = {"id": "DUP001", "shortDescription": {"text": "Duplicate code"}}
    driver = {"name": tool.capitalize(), "version": report["tool_version"], "rules": [rule]}
    schema = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
    return _pretty({"version": "2.1.0", "$schema": schema, "runs": [{"tool": {"driver": driver}, "results": results}]})


def render_error(kind: str, message: str, path: str | None = None) -> str:
    error = {"kind": kind, "message": message} | ({"path": path} if path else {})
    return _pretty({"schema_version": ERROR_VERSION, "tool_version": __version__, "error": error})


def render_capabilities() -> str:
    return _pretty({
        "schema_version": CAPABILITIES_VERSION, "tool_version": __version__, "report_schema_versions": [REPORT_VERSION], "baseline_schema_versions": [BASELINE_VERSION],
        "error_schema_versions": [ERROR_VERSION], "finding_fingerprint_versions": [1], "formats": list(FORMATS), "features": list(FEATURES),
    })


def render_settings(loaded, no_config: bool, baseline: str | None, as_json: bool) -> str:
    s = loaded.settings
    if as_json:
        state = "disabled" if no_config else "file" if loaded.config_path else "none"
        values = {k: getattr(s, k) for k in ("min_lines", "ignore_comments", "ignore_docstrings", "ignore_imports", "ignore_signatures", "same_file", "hidden")}
        values |= {"exclude": list(s.exclude), "baseline": baseline}
        return _pretty({"schema_version": CONFIG_VERSION, "project_root": loaded.project_root, "configuration": {"state": state, "path": loaded.config_path}, "settings": values})
    said = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    names = {"min_lines": "Min lines", "ignore_comments": "Ignore comments", "ignore_docstrings": "Ignore docstrings", "ignore_imports": "Ignore imports", "ignore_signatures": "Ignore signatures", "same_file": "Same-file detection", "hidden": "Hidden files"}
    out = [f"Project root: {loaded.project_root}", "Configuration: " + ("disabled (--no-config)" if no_config else loaded.config_path or "none")]
    out += [f"{name}: {said(getattr(s, key))}" for key, name in names.items()]
    out += ["Exclude:", *(f"  {p}" for p in s.exclude)] if s.exclude else ["Exclude: none"]
    return "\n".join([*out, f"Baseline: {baseline or 'disabled'}"]) + "\n"


def render_file_list(paths: list[str], as_json: bool) -> str:
    names = sorted(paths)
    return _pretty(names) if as_json else "".join(n + "\n" for n in names)


def status_document(rows: list[dict]) -> dict:
    """Groups in order of fingerprint, each with its paths, and the sums of accepted, active and stale."""
    kinds = ("accepted", "active", "stale")
    groups: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["fingerprint"], r["path"])):
        g = groups.setdefault(r["fingerprint"], {"fingerprint": r["fingerprint"], "lines": r["lines"], "paths": [], "summary": dict.fromkeys(kinds, 0)})
        g["paths"].append({"path": r["path"]} | {k: r[k] for k in kinds})
        for k in kinds:
            g["summary"][k] += r[k]
    return {"schema_version": STATUS_VERSION, "groups": list(groups.values()), "summary": {k: sum(g["summary"][k] for g in groups.values()) for k in kinds}}


def render_status(status: dict, as_json: bool) -> str:
    if as_json:
        return _pretty(status)
    out = ["Baseline status", *(f"{k.capitalize()} occurrences: {status['summary'][k]}" for k in ("accepted", "active", "stale"))]
    for g in status["groups"]:
        out += ["", f"{g['fingerprint']} ({g['lines']} lines)"]
        out += [f"  {p['path']}: accepted {p['accepted']}, active {p['active']}, stale {p['stale']}" for p in g["paths"]]
    return "\n".join(out) + "\n"


def use_color(explicit: str | None, terminal: bool, environment: dict[str, str]) -> bool:
    """always and never are obeyed; else NO_COLOR, CLICOLOR_FORCE and CLICOLOR=0 decide before the terminal."""
    if explicit in ("always", "never"):
        return explicit == "always"
    if explicit != "auto":
        if environment.get("NO_COLOR"):
            return False
        if environment.get("CLICOLOR_FORCE", "0") != "0":
            return True
        if environment.get("CLICOLOR") == "0":
            return False
    return terminal
