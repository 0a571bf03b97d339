"""Finding Python files below given paths, and reading them on the executors."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.sources.patterns import Pattern, compile_patterns, decides, excluded

IGNORE_FILES = (".gitignore", ".ignore")
_PYTHON = re.compile(r".+\.pyi?$", re.S)


class DiscoveryError(Exception):
    pass


def _relative(path: str, root: str) -> str | None:
    return os.path.relpath(path, root).replace(os.sep, "/") if path == root or path.startswith(root.rstrip("/") + "/") else None


def _outside(patterns: list[Pattern], path: str, root: str, is_folder: bool) -> bool:
    """Whether the settings exclude a path; paths outside the project aren't theirs."""
    own = _relative(path, root)
    return bool(own) and own != "." and excluded(patterns, own, is_folder)


def _walk(folder: str, root: str, patterns: list[Pattern], hidden: bool, above: list[tuple[str, list[Pattern]]]) -> Iterator[str]:
    ignores = list(above)
    for name in IGNORE_FILES:
        file = os.path.join(folder, name)
        if os.path.isfile(file):
            with open(file, encoding="utf-8", errors="replace") as f:
                ignores.append((folder, compile_patterns(f.read().split("\n"))))
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        is_folder = entry.is_dir(follow_symlinks=False)
        if entry.is_symlink() or not (is_folder or entry.is_file(follow_symlinks=False)):
            continue
        if not hidden and entry.name.startswith("."):
            continue
        verdicts = (decides(rules, os.path.relpath(entry.path, base).replace(os.sep, "/"), is_folder) for base, rules in reversed(ignores))
        if next((v for v in verdicts if v is not None), False) or _outside(patterns, entry.path, root, is_folder):
            continue
        if is_folder:
            yield from _walk(entry.path, root, patterns, hidden, ignores)
        elif _PYTHON.match(entry.name):
            yield entry.path


def discover(paths: list[str], root: str, exclude: list[str] | None = None, hidden: bool = False) -> list[str]:
    """Absolute paths of the Python files, each once, in path order.

    A file named itself is taken whatever ignore files say, but not if the settings exclude it. Links to
    files are taken only where they are named, links to folders never. Ignore files of the folders walked
    and of those above them, up to the project root, hold.
    """
    root = os.path.abspath(root)
    patterns = compile_patterns(exclude or [])
    found: set[str] = set()
    for given in paths:
        path = os.path.abspath(given)
        if not os.path.lexists(path):
            raise DiscoveryError(f"path does not exist: {path}")
        if os.path.isdir(path):
            if os.path.islink(path):
                continue
            above, folder = [], path
            while folder != root and _relative(folder, root):
                folder = os.path.dirname(folder)
                for name in IGNORE_FILES:
                    file = os.path.join(folder, name)
                    if os.path.isfile(file):
                        with open(file, encoding="utf-8", errors="replace") as f:
                            above.insert(0, (folder, compile_patterns(f.read().split("\n"))))
            found.update(_walk(path, root, patterns, hidden, above))
        elif os.path.islink(path) and not os.path.exists(path):
            raise DiscoveryError(f"link leads nowhere: {path}")
        elif os.path.isfile(path) and _PYTHON.match(os.path.basename(path)) and not _outside(patterns, path, root, False):
            found.add(path)
    return sorted(found, key=lambda p: p.split("/"))


def read_files(spark: SparkSession, paths: list[str], root: str, partitions: int | None = None) -> DataFrame:
    """file_id (path order), path (relative to root where inside), source of each file, and problem: why it couldn't be read.

    Files are read on the executors, by as many tasks as there are cores or by `partitions`; what isn't UTF-8
    or can't be read has a null source.
    """
    rows = [(i, _relative(p, os.path.abspath(root)) or p, p) for i, p in enumerate(paths)]
    listed = spark.createDataFrame(rows, "file_id bigint, path string, location string")
    listed = listed.repartition(min(max(1, len(paths)), partitions or spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sources, problems = [], []
            for location in batch["location"]:
                source = problem = None
                try:
                    with open(location, "rb") as f:
                        source = f.read().decode("utf-8")
                except OSError as e:
                    problem = e.strerror or type(e).__name__
                except UnicodeDecodeError as e:
                    problem = f"no UTF-8 at byte {e.start}"
                sources.append(source)
                problems.append(problem)
            yield pd.DataFrame({"file_id": batch["file_id"], "path": batch["path"], "source": sources, "problem": problems})

    return listed.mapInPandas(read, "file_id bigint, path string, source string, problem string")


def discovered(listing: DataFrame, settings: DataFrame) -> DataFrame:
    """The rows of a listing (project, path from the root, any more columns) that a scan of each project would take.

    For trees too large to be walked by one process, listed by whatever stores them. settings: project, hidden
    and exclude, a row per project, which is sent to all tasks; projects without one have none set. Files that
    are no Python, hidden ones and excluded ones are left out; a null path is no file.
    """
    columns = listing.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict[tuple[str, ...], list[Pattern]] = {}
        for batch in batches:
            keep = []
            for path, hidden, lines in zip(batch["path"], batch["_hidden"], batch["_exclude"], strict=True):
                own = tuple(lines) if lines is not None else ()
                if own not in compiled:
                    compiled[own] = compile_patterns(list(own))
                seen = hidden is True or hidden is not None and bool(hidden) or not any(c.startswith(".") for c in path.split("/"))
                keep.append(bool(_PYTHON.fullmatch(path.rpartition("/")[2])) and seen and not excluded(compiled[own], path))
            yield batch.loc[keep, columns]

    per = settings.select(F.col("project").alias("_project"), F.coalesce("hidden", F.lit(False)).alias("_hidden"), F.col("exclude").alias("_exclude"))
    rows = listing.where("path IS NOT NULL").join(F.broadcast(per), F.col("project") == F.col("_project"), "left").withColumn("_hidden", F.coalesce("_hidden", F.lit(False)))
    return rows.drop("_project").mapInPandas(run, listing.schema)


def virtual_source(path: str, text: str | None, root: str, exclude: list[str]) -> tuple[str, str]:
    """Project path and text of a source that is not on disk."""
    if text is None:
        raise DiscoveryError("a virtual source needs its text")
    own = _relative(os.path.abspath(os.path.join(root, path)), os.path.abspath(root))
    if own is None or own == ".":
        raise DiscoveryError(f"virtual source outside the project root: {path}")
    if not _PYTHON.match(os.path.basename(own)):
        raise DiscoveryError(f"virtual source is no Python file: {path}")
    if excluded(compile_patterns(exclude), own):
        raise DiscoveryError(f"virtual source is excluded: {path}")
    return own, text
