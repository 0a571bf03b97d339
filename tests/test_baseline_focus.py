"""Baselines, focus, patterns, settings and discovery."""

import json
import os

import pytest
from pyspark.sql import functions as F

from echoline.operators import baseline, corpus, focus, textprep
from echoline.sources import baseline_file, discovery, patterns
from echoline.sources.python_frontend import NormalizationOptions
from echoline.sources.settings import ConfigurationError, load_settings, merged, Settings, worker_count

SHA = "sha256:" + "0" * 64


def table(spark, counts):
    return spark.createDataFrame([(SHA, 2, p, n) for p, n in counts.items()], "fingerprint string, lines int, path string, count bigint")


def test_debt(spark):
    status = baseline.compare(table(spark, {"a": 1, "b": 2, "d": 3}), table(spark, {"a": 2, "b": 1, "c": 1}))
    assert baseline.totals(status).first().asDict() == {"accepted": 2, "active": 4, "stale": 2}
    pruned = baseline.prune(table(spark, {"a": 1, "b": 3, "d": 2}), table(spark, {"a": 2, "b": 1, "c": 4}))
    assert {r.path: r["count"] for r in pruned.collect()} == {"a": 1, "b": 1}


def test_problems(spark):
    rows = [("x", 1, "a", 1), (SHA, 0, "a", 1), (SHA, 0, "../a", 1), (SHA, 1, "C:a", 0), (SHA, 1, "ok", 0), (SHA, 1, "ok", 2)]
    found = baseline.problems(spark.createDataFrame(rows, "fingerprint string, lines int, path string, count bigint")).collect()
    assert sorted({r.reason for r in found}) == ["duplicate group", "duplicate path", "invalid fingerprint", "invalid path", "no lines", "no occurrences"]


def test_baseline_document(tmp_path, spark):
    options = NormalizationOptions()
    text = baseline_file.serialize([(SHA, 2, "b.py", 1), (SHA, 2, "a.py", 2)], options)
    assert [o["path"] for o in json.loads(text)["groups"][0]["occurrences"]] == ["a.py", "b.py"]
    path = str(tmp_path / "b.json")
    baseline_file.write_text(path, text)
    assert baseline_file.read(spark, path, options).count() == 2
    for change in ({"extra": 1}, {"version": 2}, {"groups": [{"fingerprint": "x", "lines": 1, "occurrences": []}]}):
        with pytest.raises(baseline_file.BaselineError):
            baseline_file.parse(json.dumps(json.loads(text) | change))
    with pytest.raises(baseline_file.BaselineError):
        baseline_file.read(spark, path, NormalizationOptions(ignore_imports=False))


def test_focus_takes_whole_components(spark):
    files = spark.createDataFrame([(0, "src1/a.py"), (1, "src10/b.py"), (2, "lib/c.py")], "file_id bigint, path string")
    groups = spark.createDataFrame([("g", 0), ("g", 2), ("h", 1), ("h", 2)], "fingerprint string, file_id bigint")
    picked = lambda *s: spark.createDataFrame([(x,) for x in s], "selector string")
    assert {r.fingerprint for r in focus.focused(groups, files, picked("src1/")).collect()} == {"g"}
    assert focus.focused(groups, files, picked("src1")).count() == 2
    assert [r.selector for r in focus.unmatched(files, picked("src1", "src")).collect()] == ["src"]


def test_path_order(spark):
    files = spark.createDataFrame([(p,) for p in ("a.b", "a/z", "a", "a/é", "a/b")], "path string")
    assert [r.path for r in corpus.ordered_files(files).orderBy("file_id").collect()] == ["a", "a/b", "a/z", "a/é", "a.b"]


RULES = ["build/", "*.min.js", "/docs/conf.py", "lib/**/tables/", "old/**", "!old/keep.py", "a[!b]c?", "x/*/y", r"\#odd", "# note", ""]
PATHS = {
    "build/a.py": True, "q/build/a.py": True, "build": False, "m.min.js": True, "docs/conf.py": True, "y/docs/conf.py": False, "lib/tables/q.py": True, "lib/a/b/tables/q.py": True,
    "old/z.py": True, "old/keep.py": False, "axcd": True, "abcd": False, "x/1/y": True, "x/1/2/y": False, "#odd": True,
}


def test_patterns(spark):
    rules = patterns.compile_patterns(RULES)
    assert {p: patterns.excluded(rules, p) for p in PATHS} == PATHS
    df = spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", patterns.is_excluded(F.col("path"), RULES).alias("out"))
    assert {r.path: r.out for r in df.collect()} == PATHS
    with pytest.raises(ValueError):
        patterns.compile_pattern("a[b")


def test_discovery(tmp_path, spark):
    for name in ("a.py", "b.txt", "c.pyi", ".hidden/d.py", "skip/e.py", "_priv/__init__.py", "ign/f.py", "ign/g.py"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(b"x = 1\n")
    (tmp_path / "bad.py").write_bytes(b"\xff")
    (tmp_path / ".gitignore").write_text("ign/f.py\n")
    os.symlink(tmp_path / "skip", tmp_path / "link")
    root = str(tmp_path)
    names = lambda *a, **k: [os.path.relpath(p, root) for p in discovery.discover(list(a) or [root], root, **k)]
    assert names(exclude=["skip/"]) == ["_priv/__init__.py", "a.py", "bad.py", "c.pyi", "ign/g.py"]
    assert ".hidden/d.py" in names(hidden=True)
    assert names(root + "/ign/f.py", root + "/ign/f.py") == ["ign/f.py"] and names(root + "/link") == []
    with pytest.raises(discovery.DiscoveryError):
        names(root + "/none")
    read = discovery.read_files(spark, discovery.discover([root], root), root)
    assert {r.path: r.source is None for r in read.collect()}["bad.py"]


def test_settings(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.echoline]\nmin-lines = 6\nexclude = ["a"]\nbaseline = "b.json"\n')
    (tmp_path / "sub").mkdir()
    loaded = load_settings(str(tmp_path / "sub"), {"exclude": ["z"], "hidden": True, "min_lines": None})
    assert (loaded.settings.min_lines, loaded.settings.exclude, loaded.settings.hidden) == (6, ("z",), True)
    assert loaded.project_root == str(tmp_path) and loaded.settings.baseline == str(tmp_path / "b.json")
    assert load_settings(str(tmp_path), no_config=True).settings == Settings()
    for wrong in ({"min_lines": 0}, {"nothing": 1}, {"hidden": "yes"}):
        with pytest.raises(ConfigurationError):
            load_settings(str(tmp_path), wrong, no_config=True)
    with pytest.raises(ConfigurationError):
        load_settings(str(tmp_path), config=str(tmp_path / "pyproject.toml"), no_config=True)
    assert [worker_count("auto", 9), worker_count("auto", 2), worker_count("3")] == [4, 2, 3]
    assert merged(Settings(), {"min-lines": 2}).min_lines == 2


def test_suppression_and_lines_of_texts(spark):
    files = spark.createDataFrame([(1, "﻿a\r\n\n  b \n# t: disable\nc\n# t: enable\n—\n"), (2, None), (3, "")], "file_id bigint, source string")
    rows = textprep.normalized_lines(files, "t").orderBy("nline").collect()
    assert [(r.nline, r.segment_id, r.source_line, r.text, r.effective) for r in rows] == [(0, 0, 0, "a", True), (1, 0, 2, "b", True), (2, 1, 6, "—", False)]
    counts = {r.file_id: r.n for r in files.where("source IS NOT NULL").select("file_id", textprep.line_count(F.col("source")).alias("n")).collect()}
    assert counts == {1: 7, 3: 0}
