"""Command line: python -m echoline.cli PATH..."""

from __future__ import annotations

import argparse
import os
import sys

from echoline import __version__
from echoline.plans.run import ScanOptions, run
from echoline.session import local_session

TRISTATE = ("ignore-comments", "ignore-docstrings", "ignore-imports", "ignore-signatures", "same-file", "hidden")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echoline", description="Find repeated blocks of Python source with Spark.")
    p.add_argument("paths", nargs="*", default=["."], metavar="PATH")
    p.add_argument("--version", action="version", version=__version__)
    config = p.add_mutually_exclusive_group()
    config.add_argument("--config")
    config.add_argument("--no-config", action="store_true")
    p.add_argument("--project-root")
    for flag in ("capabilities", "show-config", "list-files", "keep-going", "show-source", "no-fail-on-findings", "json"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--format", choices=("text", "json", "markdown", "sarif"))
    p.add_argument("--color", choices=("auto", "always", "never"))
    p.add_argument("--stdin-path")
    p.add_argument("--focus", action="append", default=[])
    p.add_argument("--report", action="append", default=[], metavar="FORMAT=PATH")
    p.add_argument("--workers", help="most tasks that read sources: a number or auto")
    p.add_argument("--min-lines", type=int)
    p.add_argument("--exclude", action="append")
    for name in TRISTATE:
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--baseline")
    p.add_argument("--write-baseline")
    p.add_argument("--baseline-status")
    p.add_argument("--prune-baseline")
    p.add_argument("--tool-name", default="echoline", help="name in directives, fingerprints and configuration")
    return p


def options(arguments: list[str], stdin_source: str | None = None) -> ScanOptions:
    a = parser().parse_args(arguments)
    if a.json and a.format not in (None, "json"):
        parser().error("--json and --format exclude each other")
    overrides = {n.replace("-", "_"): getattr(a, n.replace("-", "_")) for n in TRISTATE} | {"min_lines": a.min_lines, "exclude": a.exclude}
    return ScanOptions(
        paths=tuple(a.paths), config=a.config, no_config=a.no_config, project_root=a.project_root, overrides=overrides,
        format="json" if a.json else a.format or "text", color=a.color, show_source=a.show_source, reports=tuple(a.report), focus=tuple(a.focus),
        keep_going=a.keep_going, no_fail_on_findings=a.no_fail_on_findings, stdin_path=a.stdin_path, stdin_source=stdin_source, baseline=a.baseline,
        write_baseline=a.write_baseline, baseline_status=a.baseline_status, prune_baseline=a.prune_baseline, show_config=a.show_config,
        list_files=a.list_files, capabilities=a.capabilities, workers=a.workers, tool=a.tool_name,
    )


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    chosen = options(arguments)
    if chosen.stdin_path:
        chosen = options(arguments, sys.stdin.read())
    result = run(local_session(os.cpu_count() or 1), chosen, sys.stdout.isatty(), dict(os.environ))
    sys.stdout.write(result.stdout)
    sys.stderr.write(result.stderr)
    return int(result.status)


if __name__ == "__main__":
    sys.exit(main())
