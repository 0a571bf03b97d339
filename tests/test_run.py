"""Scans from options to output."""

import json

import pytest

from echoline.cli import options
from echoline.plans import render
from echoline.plans.run import Exit, ScanOptions, run

BODY = "def f(a,\n  b):\n    x = a + 1\n    y = x * 2  # c\n    z = y - 3\n    return z\n"


@pytest.fixture
def project(tmp_path):
    (tmp_path / "a.py").write_text("import os\n" + BODY)
    (tmp_path / "b.py").write_text(BODY.replace("a,\n  b", "a, b"))
    return tmp_path


def scan(spark, project, **k):
    return run(spark, ScanOptions(paths=(str(project),), no_config=True, **k))


def test_text(spark, project):
    result = scan(spark, project)
    assert result.status == Exit.FINDINGS
    assert result.stdout == (
        "DUP001 4 duplicated lines\nContext: executable\nScope: function\nOccurrences: 2 across 2 files (cross-file)\n\n  a.py:4-7\n  b.py:2-5\n\nFound 1 duplicate group.\n4 duplicate lines (50.00%).\n"
    )
    assert scan(spark, project, no_fail_on_findings=True).status == Exit.SUCCESS


def test_baseline_round(spark, project):
    base = str(project / "base.json")
    assert scan(spark, project, write_baseline=base).status == Exit.SUCCESS
    assert scan(spark, project, baseline=base).stdout.startswith("No duplicate code found.")
    (project / "c.py").write_text(BODY)
    (project / "b.py").write_text("q = 1\n")
    status = scan(spark, project, baseline_status=base, format="json")
    assert json.loads(status.stdout)["summary"] == {"accepted": 1, "active": 1, "stale": 1} and status.status == Exit.FINDINGS
    again = json.loads(scan(spark, project, baseline=base, focus=("a.py",), format="json").stdout)
    assert [[at["path"] for at in f["locations"]] for f in again["findings"]] == [["a.py", "c.py"]]
    scan(spark, project, prune_baseline=base)
    assert json.loads(scan(spark, project, baseline_status=base, format="json").stdout)["summary"] == {"accepted": 1, "active": 1, "stale": 0}


def test_errors_and_keep_going(spark, project):
    (project / "bad.py").write_text("value = 1\n)\n")
    stopped = scan(spark, project, format="json")
    assert stopped.status == Exit.ERROR and json.loads(stopped.stdout)["error"]["kind"] == "parse"
    going = scan(spark, project, keep_going=True, format="markdown")
    assert going.status == Exit.ERROR and "Scan incomplete" in going.stdout and "`bad.py`" in going.stdout
    assert scan(spark, project, keep_going=True, format="sarif").status == Exit.ERROR
    assert "does not match" in scan(spark, project, focus=("none.py",)).stderr
    assert scan(spark, project, focus=("a.py",), list_files=True).status == Exit.ERROR


def test_virtual_source_and_reports(spark, project):
    out = str(project / "out.sarif")
    result = scan(spark, project, stdin_path="b.py", stdin_source="q = 1\n", reports=(f"sarif={out}",), format="json")
    assert json.loads(result.stdout)["findings"] == [] and json.loads(open(out).read())["runs"][0]["results"] == []
    assert scan(spark, project, reports=(f"json={project}/a.py",)).status == Exit.ERROR


def test_modes_without_a_scan(spark, project):
    assert scan(spark, project, list_files=True).stdout == "a.py\nb.py\n"
    assert json.loads(scan(spark, project, show_config=True, format="json").stdout)["settings"]["min_lines"] == 4
    assert "focus" in json.loads(run(spark, ScanOptions(capabilities=True)).stdout)["features"]


def test_command_line():
    o = options(["x", "--no-hidden", "--min-lines", "3", "--json", "--no-same-file", "--report", "text=o"])
    assert (o.paths, o.format, o.overrides["hidden"], o.overrides["same_file"], o.overrides["ignore_imports"], o.reports) == (("x",), "json", False, False, None, ("text=o",))


def test_colours_and_fences():
    assert render.use_color("always", False, {"NO_COLOR": "1"}) and not render.use_color(None, True, {"NO_COLOR": "1"})
    assert render.use_color(None, False, {"CLICOLOR_FORCE": "1"}) and not render.use_color(None, True, {"CLICOLOR": "0"}) and render.use_color(None, True, {})
    assert render._inline("a`b") == "``a`b``" and render._inline("`x") == "`` `x ``"
    assert render._sarif_place({"path": "a b/é.py", "start_line": 1, "end_line": 2})["physicalLocation"]["artifactLocation"]["uri"] == "a%20b/%C3%A9.py"


def test_options_that_exclude_each_other(spark, project):
    for k in ({"capabilities": True, "keep_going": True}, {"baseline": "b", "write_baseline": "b"}, {"baseline": "b", "baseline_status": "b"}, {"baseline": "b", "prune_baseline": "b"}, {"write_baseline": "b", "format": "json"}, {"write_baseline": "b", "show_source": True}):
        result = run(spark, ScanOptions(**({} if "capabilities" in k else {"paths": (str(project),), "no_config": True}), **k))
        assert result.status == Exit.ERROR, k
    assert run(spark, ScanOptions(capabilities=True)).status == Exit.SUCCESS


def test_read_errors_have_a_cause_and_dangling_links_are_told(spark, project):
    (project / "bad.py").write_bytes(b"a = 1\n\xff")
    result = scan(spark, project)
    assert result.status == Exit.ERROR and "bad.py" in result.stderr and "no UTF-8 at byte 6" in result.stderr
    (project / "link.py").symlink_to(project / "nowhere.py")
    result = run(spark, ScanOptions(paths=(str(project / "link.py"),), no_config=True))
    assert result.status == Exit.ERROR and "leads nowhere" in result.stderr


def test_colours(spark, project):
    out = scan(spark, project, color="always").stdout
    assert "\x1b[1m\x1b[33mDUP001\x1b[0m \x1b[1m\x1b[31m4 duplicated lines\x1b[0m" in out and "\x1b[1m\x1b[38;5;208m1 duplicate group\x1b[0m" in out


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from echoline import session

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        getCheckpointDir = get

    class Session:
        conf, sparkContext = Context(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    assert session.on_one_machine("local[8]") and not session.on_one_machine("local-cluster[3,2,1024]")


def test_tables_of_steps_are_removed(spark):
    from echoline import session

    with session.Scratch() as scratch:
        path = scratch.write(spark.range(3), "step").inputFiles()[0]
        assert path
    kept = session.written(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    new = session.materialize(spark.range(3), "result")
    assert new.count() == 3
    session.release(spark, kept)
    assert session.written(spark) == kept
