"""A scan from options to result: discovery, preparation, detection, baseline, focus, report."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline import __version__
from echoline.functions.fingerprint import TOOL
from echoline.operators import baseline, findings, focus, metrics
from echoline.operators.detect import detect
from echoline.plans import render
from echoline.session import materialize
from echoline.sources import baseline_file, discovery, python_frontend
from echoline.sources.settings import ConfigurationError, Loaded, load_settings, worker_count


class Exit(IntEnum):
    SUCCESS = 0
    FINDINGS = 1
    ERROR = 2


@dataclass(frozen=True)
class ScanOptions:
    paths: tuple[str, ...] = (".",)
    config: str | None = None
    no_config: bool = False
    project_root: str | None = None
    overrides: dict = field(default_factory=dict)
    format: str = "text"
    color: str | None = None
    show_source: bool = False
    reports: tuple[str, ...] = ()
    focus: tuple[str, ...] = ()
    keep_going: bool = False
    no_fail_on_findings: bool = False
    stdin_path: str | None = None
    stdin_source: str | None = None
    baseline: str | None = None
    write_baseline: str | None = None
    baseline_status: str | None = None
    prune_baseline: str | None = None
    show_config: bool = False
    list_files: bool = False
    capabilities: bool = False
    #: most tasks that read sources; None: as many as the cluster runs
    workers: str | None = None
    tool: str = TOOL


@dataclass(frozen=True)
class RunResult:
    stdout: str
    stderr: str
    status: Exit


class OperationalError(Exception):
    def __init__(self, kind: str, message: str, path: str | None = None):
        super().__init__(message)
        self.kind, self.message, self.path = kind, message, path


@dataclass(frozen=True)
class Scan:
    """The tables of one scan; groups are those left after baseline and focus."""

    files: DataFrame
    lines: DataFrame
    groups: DataFrame
    errors: list[dict]


MODES = {"baseline_status": "--baseline-status", "prune_baseline": "--prune-baseline", "show_config": "--show-config", "list_files": "--list-files", "write_baseline": "--write-baseline"}


def check_options(o: ScanOptions) -> None:
    """Which options go together."""
    if o.capabilities and o != ScanOptions(capabilities=True, tool=o.tool):
        raise OperationalError("configuration", "--capabilities goes with no other option")
    modes = [flag for name, flag in MODES.items() if getattr(o, name)]
    if len(modes) > 1:
        raise OperationalError("configuration", f"{modes[0]} and {modes[1]} exclude each other")
    if modes:
        scans = {"--stdin-path": o.stdin_path, "--keep-going": o.keep_going, "--focus": o.focus, "--no-fail-on-findings": o.no_fail_on_findings, "--report": o.reports}
        administers = {} if o.write_baseline else {"--show-source": o.show_source, "--color": o.color}
        if o.baseline_status or o.prune_baseline or o.write_baseline:
            scans["--baseline"] = o.baseline
        if o.write_baseline:
            administers = {"--show-source": o.show_source, "--color": o.color, "--format": o.format != "text"}
        for flag, given in (scans | administers).items():
            if given:
                raise OperationalError("configuration", f"{flag} is not valid with {modes[0]}")
        if not o.write_baseline and o.format in ("markdown", "sarif"):
            raise OperationalError("configuration", f"{modes[0]} supports only text or JSON output")
    if o.color and o.format != "text":
        raise OperationalError("configuration", "--color is only valid with text output")


def report_targets(specs: tuple[str, ...], taken: set[str]) -> list[tuple[str, str]]:
    """FORMAT=PATH pairs; no destination may be a source, the baseline or another destination."""
    targets, used = [], {os.path.realpath(p) for p in taken}
    for spec in specs:
        kind, equals, path = spec.partition("=")
        if not equals or kind not in render.FORMATS or not path:
            raise OperationalError("configuration", f"invalid --report {spec!r}; expected FORMAT=PATH with a format of {', '.join(render.FORMATS)}")
        if (real := os.path.realpath(path)) in used:
            raise OperationalError("configuration", f"--report destination is in use: {path}")
        used.add(real)
        targets.append((kind, path))
    return targets


def scan(files: DataFrame, settings, tool: str = TOOL, keep_going: bool = False) -> Scan:
    """Prepare files (file_id, path, source) and detect; the tables stay distributed."""
    done = materialize(python_frontend.prepared(files, settings.normalization(), directive=tool), "scan-prepared")
    failed = python_frontend.preparation_errors(done)
    errors = []
    if keep_going:
        errors = [r.asDict() for r in failed.orderBy("file_id").collect()]
    elif first := failed.orderBy("file_id").limit(1).collect():
        raise OperationalError(first[0]["kind"], _told(first[0]), first[0]["path"])
    lines = python_frontend.prepared_lines(done)
    groups = detect(lines, settings.min_lines, settings.same_file, tool)
    return Scan(python_frontend.prepared_files(done), lines, groups, errors)


def _told(row) -> str:
    return f"failed to parse {row['path']}: {row['message']} at line {row['line']}, column {row['column']}" if row["kind"] == "parse" else f"failed to {row['kind']} {row['path']}: {row['message']}"


def build_report(found: Scan, analysis: dict, files: DataFrame | None = None, show_source: bool = False) -> dict:
    """The report document; here, and only here, findings come to the driver."""
    figures = metrics.summary(found.files, found.lines, found.groups).first().asDict()
    places = findings.locations(found.groups, found.files)
    if show_source:
        places = findings.snippets(places, files)
    columns = [c for c in ("path", "start_line", "end_line", "source") if c in places.columns]
    nested = places.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("locations"))
    order = ["path", "start_line", "end_line"]
    rows = []
    for r in findings.findings(found.groups).join(nested, "fingerprint").collect():
        row = {k: r[k] for k in ("code", "fingerprint", "lines", "context", "scope", "occurrences", "files", "distribution")}
        rows.append(row | {"locations": [at.asDict() for at in r["locations"]]})
    key = lambda f: (f["locations"][0]["path"], f["locations"][0]["start_line"], -f["lines"], [[at[c] for c in order] for at in f["locations"]])
    errors = [{"kind": e["kind"], "message": _told(e), "path": e["path"]} for e in found.errors]
    return {
        "schema_version": render.REPORT_VERSION, "tool_version": __version__, "complete": not errors, "analysis": analysis, "errors": errors,
        **{k: figures[k] for k in ("files", "source_lines", "analyzed_lines", "duplicate_groups", "duplicate_lines", "duplication_percent")},
        "findings": sorted(rows, key=key),
    }


def _rendered(report: dict, kind: str, color: bool, tool: str) -> str:
    if kind == "json":
        return render.render_json(report)
    if kind == "markdown":
        return render.render_markdown(report, tool.capitalize())
    return render.render_sarif(report, tool) if kind == "sarif" else render.render_text(report, color)


def _rows(table: DataFrame) -> list[tuple]:
    return [(r["fingerprint"], r["lines"], r["path"], r["count"]) for r in table.collect()]


def _execute(spark: SparkSession, o: ScanOptions, terminal: bool, environment: dict[str, str]) -> RunResult:
    check_options(o)
    if o.capabilities:
        return RunResult(render.render_capabilities(), "", Exit.SUCCESS)
    try:
        loaded: Loaded = load_settings(o.paths[0], o.overrides, o.config, o.no_config, o.project_root, o.tool)
        workers = worker_count(o.workers) if o.workers else None
    except ConfigurationError as e:
        raise OperationalError("configuration", f"failed to load configuration: {e}") from None
    settings, root = loaded.settings, loaded.project_root
    accepted = os.path.abspath(o.baseline) if o.baseline else settings.baseline
    if o.show_config:
        return RunResult(render.render_settings(loaded, o.no_config, accepted, o.format == "json"), "", Exit.SUCCESS)
    try:
        virtual = [discovery.virtual_source(o.stdin_path, o.stdin_source, root, list(settings.exclude))] if o.stdin_path else []
        found = discovery.discover(list(o.paths), root, list(settings.exclude), settings.hidden)
    except (discovery.DiscoveryError, OSError, ValueError) as e:
        raise OperationalError("discovery", str(e)) from None
    relative = [discovery._relative(p, root) or p for p in found]
    if o.list_files:
        return RunResult(render.render_file_list(relative, o.format == "json"), "", Exit.SUCCESS)

    disk = {r: p for r, p in zip(relative, found, strict=True) if r not in dict(virtual)}
    names = sorted([*disk, *dict(virtual)], key=lambda p: p.split("/"))
    targets = report_targets(o.reports, {*found, *([accepted] if accepted else [])})
    selectors = sorted({os.path.relpath(os.path.join(root, s), root).replace(os.sep, "/") for s in o.focus})
    for s in selectors:
        if not any(n == s or n.startswith(s + "/") for n in names):
            raise OperationalError("configuration", f"--focus does not match any Python source: {s}")
    ids = {n: i for i, n in enumerate(names)}
    read = discovery.read_files(spark, list(disk.values()), root, workers)
    numbers = spark.createDataFrame([(i, n) for n, i in ids.items()], "file_id bigint, path string")
    files = read.select("path", "source", "problem").unionByName(spark.createDataFrame([(*v, None) for v in virtual], "path string, source string, problem string")).join(numbers, "path")
    result = scan(files, settings, o.tool, o.keep_going)

    current = lambda: baseline.build(result.groups, result.files)
    try:
        if o.write_baseline:
            baseline_file.write_text(o.write_baseline, baseline_file.serialize(_rows(current()), settings.normalization()))
            return RunResult("", "", Exit.SUCCESS)
        if o.baseline_status or o.prune_baseline:
            path = o.baseline_status or o.prune_baseline
            old = baseline_file.read(spark, path, settings.normalization())
            status = render.status_document([r.asDict() for r in baseline.compare(current(), old).collect()])
            if o.prune_baseline:
                text = baseline_file.serialize(_rows(baseline.prune(current(), old)), settings.normalization())
                if text != baseline_file.serialize(_rows(old), settings.normalization()):
                    baseline_file.write_text(path, text)
            return RunResult(render.render_status(status, o.format == "json"), "", Exit.FINDINGS if status["summary"]["active"] else Exit.SUCCESS)
        groups = result.groups
        if accepted:
            old = baseline_file.read(spark, accepted, settings.normalization())
            groups = baseline.active_groups(groups, baseline.compare(current(), old))
    except baseline_file.BaselineError as e:
        raise OperationalError("baseline", str(e)) from None
    if selectors:
        groups = focus.focused(groups, result.files, spark.createDataFrame([(s,) for s in selectors], "selector string"))
    analysis = {k: v for k, v in asdict(settings).items() if k not in ("baseline", "exclude")} | {
        "exclude": list(settings.exclude), "baseline_enabled": bool(accepted), "focus": selectors, "virtual_source": virtual[0][0] if virtual else None, "keep_going": o.keep_going,
    }
    report = build_report(Scan(result.files, result.lines, groups, result.errors), analysis, files, o.show_source)
    try:
        out = _rendered(report, o.format, render.use_color(o.color, terminal, environment), o.tool)
        written = [(path, _rendered(report, kind, False, o.tool)) for kind, path in targets if kind != "sarif" or report["complete"]]
        for path, text in written:
            baseline_file.write_text(path, text)
    except (render.IncompleteReport, OSError) as e:
        raise OperationalError("output", str(e)) from None
    status = Exit.ERROR if not report["complete"] else Exit.FINDINGS if report["findings"] else Exit.SUCCESS
    if o.no_fail_on_findings and status == Exit.FINDINGS:
        status = Exit.SUCCESS
    told = "" if o.format == "json" else "".join(f"{o.tool}: {e['message']}\n" for e in report["errors"])
    return RunResult(out, told, status)


def run(spark: SparkSession, options: ScanOptions, terminal: bool = False, environment: dict[str, str] | None = None) -> RunResult:
    """Scan, or do what the mode asks for. Operational errors end with status 2: a document where the output is JSON, else a message."""
    try:
        return _execute(spark, options, terminal, environment or {})
    except OperationalError as e:
        if options.format == "json":
            return RunResult(render.render_error(e.kind, e.message, e.path), "", Exit.ERROR)
        return RunResult("", f"{options.tool}: {e.message}\n", Exit.ERROR)
