"""Settings of a scan: defaults, a project's own, and what a call overrides."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.sources.python_frontend import NormalizationOptions


class ConfigurationError(Exception):
    pass


@dataclass(frozen=True)
class Settings:
    min_lines: int = 4
    ignore_comments: bool = True
    ignore_docstrings: bool = True
    ignore_imports: bool = True
    ignore_signatures: bool = True
    same_file: bool = True
    hidden: bool = False
    exclude: tuple[str, ...] = ()
    baseline: str | None = None

    def normalization(self) -> NormalizationOptions:
        return NormalizationOptions(self.ignore_comments, self.ignore_docstrings, self.ignore_imports, self.ignore_signatures)


@dataclass(frozen=True)
class Loaded:
    settings: Settings
    config_path: str | None
    project_root: str


_KINDS = {f.name: {"min_lines": int, "exclude": list, "baseline": str}.get(f.name, bool) for f in fields(Settings)}


def merged(settings: Settings, own: dict) -> Settings:
    """settings with the values given; None means not given, and a list replaces the one before."""
    for key, value in own.items():
        kind = _KINDS.get(key.replace("-", "_"))
        if kind is None:
            raise ConfigurationError(f"unknown setting: {key}")
        if value is not None and (not isinstance(value, (kind, tuple) if kind is list else kind) or kind is int and isinstance(value, bool)):
            raise ConfigurationError(f"setting {key} must be of type {kind.__name__}")
    given = {k.replace("-", "_"): v for k, v in own.items() if v is not None}
    if "exclude" in given:
        given["exclude"] = tuple(given["exclude"])
    return replace(settings, **given)


def _project_table(path: str, tool: str, required: bool) -> dict | None:
    if not os.path.isfile(path):
        if required:
            raise ConfigurationError(f"configuration does not exist: {path}")
        return None
    try:
        with open(path, "rb") as f:
            return tomllib.load(f).get("tool", {}).get(tool)
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigurationError(f"failed to read {path}: {e}") from None


def load_settings(start: str, overrides: dict | None = None, config: str | None = None, no_config: bool = False, project_root: str | None = None, tool: str = "echoline") -> Loaded:
    """Settings for a scan that begins at `start`.

    An exact configuration file, no configuration, a given project root, or else the nearest folder above
    whose pyproject.toml has a table for the tool. Overrides go before the project's values.
    """
    if config and no_config:
        raise ConfigurationError("a configuration file and no configuration exclude each other")
    root = os.path.abspath(project_root) if project_root else None
    if root and not os.path.isdir(root):
        raise ConfigurationError(f"project root is not a directory: {root}")
    start = os.path.abspath(start)
    folder = start if os.path.isdir(start) else os.path.dirname(start)
    settings, path = Settings(), None
    if config:
        path = os.path.abspath(config)
        if os.path.basename(path) != "pyproject.toml":
            raise ConfigurationError(f"configuration must be a pyproject.toml: {path}")
        if root and os.path.dirname(path) != root:
            raise ConfigurationError("the configuration file does not lie in the project root")
        settings = merged(settings, _project_table(path, tool, True) or {})
        root = root or os.path.dirname(path)
    elif not no_config:
        folders = [root] if root else [folder]
        while not root and os.path.dirname(folders[-1]) != folders[-1]:
            folders.append(os.path.dirname(folders[-1]))
        for f in folders:
            own = _project_table(os.path.join(f, "pyproject.toml"), tool, False)
            if own is not None:
                path, root, settings = os.path.join(f, "pyproject.toml"), root or f, merged(settings, own)
                break
    root = root or folder
    settings = merged(settings, overrides or {})
    if settings.baseline:
        settings = replace(settings, baseline=os.path.join(root, settings.baseline))
    if settings.min_lines < 1:
        raise ConfigurationError("min_lines must be at least 1")
    return Loaded(settings, path, root)


def resolved(own: DataFrame) -> DataFrame:
    """Settings of many projects at once: project, root and the fields of Settings, null where not set.

    A project's value goes before the default, a list replaces the default one, a relative baseline lies in the
    root. A min_lines below 1 raises ConfigurationError when the rows are read.
    """
    defaults = Settings()
    kinds = {f.name: {"min_lines": "int", "exclude": "array<string>", "baseline": "string"}.get(f.name, "boolean") for f in fields(Settings)}
    column = lambda name: F.col(name).cast(kinds[name]) if name in own.columns else F.lit(None).cast(kinds[name])
    given = {n: F.coalesce(column(n), F.array().cast("array<string>") if n == "exclude" else F.lit(getattr(defaults, n)).cast(kinds[n])) for n in kinds}
    given["min_lines"] = F.when(given["min_lines"] < 1, F.raise_error(F.lit("min_lines must be at least 1")).cast("int")).otherwise(given["min_lines"])
    path = given["baseline"]
    given["baseline"] = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), path))
    return own.select("project", "root", *[c.alias(n) for n, c in given.items()])


def worker_count(value: str, available: int | None = None) -> int:
    """The most tasks that read sources, where that is to be bounded: a positive number, or 'auto', the processors available, from 1 to 4."""
    if value == "auto":
        return min(4, max(1, available or os.cpu_count() or 1))
    if not value.isdigit() or int(value) < 1:
        raise ConfigurationError("workers must be a positive number or 'auto'")
    return int(value)
