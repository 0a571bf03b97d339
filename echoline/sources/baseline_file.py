"""Baselines as JSON files: strict reading, canonical writing, replacement in one step."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from echoline.plans.render import BASELINE_VERSION
from echoline.sources.python_frontend import NormalizationOptions

SCHEMA = "fingerprint string, lines int, path string, count bigint"


class BaselineError(Exception):
    pass


def project_path_problem(path: str) -> str | None:
    """Why path is none relative to a project, or None."""
    if not path or path.startswith("/") or path.endswith("/") or "\\" in path or "\0" in path or re.match("[A-Za-z]:", path):
        return "not a relative path"
    return "a component is empty, '.' or '..'" if any(c in ("", ".", "..") for c in path.split("/")) else None


def _exactly(value: object, keys: set[str], what: str) -> dict:
    if not isinstance(value, dict) or set(value) != keys:
        raise BaselineError(f"{what} must have exactly the keys {', '.join(sorted(keys))}")
    return value


def _counted(value: object, what: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise BaselineError(f"{what} must be a positive whole number")
    return value


def parse(text: str) -> tuple[NormalizationOptions, list[tuple[str, int, str, int]]]:
    """Normalization and rows (fingerprint, lines, path, count) of a baseline document."""
    try:
        document = json.loads(text)
    except ValueError as e:
        raise BaselineError(f"baseline is no JSON: {e}") from None
    _exactly(document, {"version", "normalization", "groups"}, "a baseline")
    if document["version"] != BASELINE_VERSION:
        raise BaselineError(f"baseline version {document['version']} is not supported")
    options = _exactly(document["normalization"], set(NormalizationOptions.__dataclass_fields__), "normalization")
    if not all(isinstance(v, bool) for v in options.values()):
        raise BaselineError("normalization options must be true or false")
    rows, groups = [], set()
    for group in document["groups"]:
        _exactly(group, {"fingerprint", "lines", "occurrences"}, "a group")
        name = group["fingerprint"]
        if not isinstance(name, str) or not re.fullmatch("sha256:[0-9a-f]{64}", name):
            raise BaselineError(f"invalid fingerprint {name!r}")
        if name in groups:
            raise BaselineError(f"duplicate group {name}")
        groups.add(name)
        lines = _counted(group["lines"], "lines")
        if not group["occurrences"]:
            raise BaselineError(f"group {name} has no occurrences")
        paths = set()
        for at in group["occurrences"]:
            _exactly(at, {"path", "count"}, "an occurrence")
            if not isinstance(at["path"], str) or (problem := project_path_problem(at["path"])):
                raise BaselineError(f"invalid path {at['path']!r}" + (f": {problem}" if isinstance(at["path"], str) else ""))
            if at["path"] in paths:
                raise BaselineError(f"group {name} names {at['path']} twice")
            paths.add(at["path"])
            rows.append((name, lines, at["path"], _counted(at["count"], "count")))
    return NormalizationOptions(**options), rows


def serialize(rows: list[tuple[str, int, str, int]], options: NormalizationOptions) -> str:
    """The document in canonical order; what parse refuses is refused here, too."""
    groups: dict[str, dict] = {}
    for name, lines, path, count in sorted(rows):
        groups.setdefault(name, {"fingerprint": name, "lines": lines, "occurrences": []})["occurrences"].append({"path": path, "count": count})
    text = json.dumps({"version": BASELINE_VERSION, "normalization": asdict(options), "groups": list(groups.values())}, indent=2, ensure_ascii=False)
    parse(text)
    return text


def read(spark: SparkSession, path: str, options: NormalizationOptions) -> DataFrame:
    """The baseline as a table; it must have been made with the same normalization."""
    try:
        with open(path, encoding="utf-8") as f:
            own, rows = parse(f.read())
    except OSError as e:
        raise BaselineError(f"failed to read baseline {path}: {e.strerror}") from None
    if own != options:
        raise BaselineError("baseline was made with other normalization settings")
    return spark.createDataFrame(rows, SCHEMA)


def write_text(path: str, text: str) -> None:
    """Replace a file in one step, so readers see the old or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, prefix=".write-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
