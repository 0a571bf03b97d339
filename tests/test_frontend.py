"""Normalized lines of Python sources."""

import pytest

from echoline.sources.python_frontend import NormalizationOptions, SourceError, prepare, source_line_count


def texts(source, **options):
    return [x.text for x in prepare(source, NormalizationOptions(**options))]


def test_comments_come_from_tokens():
    assert texts('value = "# not a comment"\nother = 42  # comment\n') == ['value = "# not a comment"', "other = 42"]


def test_docstrings():
    source = '"""m"""\nclass Example:\n    """c"""\n    value = 1\n    def f(self):\n        """d"""\n        """ordinary string expression"""\n        return value\n'
    assert texts(source) == ["class Example:", "value = 1", '"""ordinary string expression"""', "return value"]
    assert texts('f"x"\n') == ['f"x"'] and texts('b"x"\n') == ['b"x"']


def test_imports_at_any_depth_and_their_semicolons():
    assert texts("if enabled:\n    import os\n    run()\n") == ["if enabled:", "run()"]
    assert texts("import os; run()\n") == ["run()"] == texts("run(); import os\n")


def test_signatures_go_decorators_stay():
    assert texts("@wrap\nasync def f(\n    a,\n    b,\n):\n    def g(x: int): return calculate(1, 2)\n    return g\n") == ["@wrap", "return calculate(1, 2)", "return g"]
    assert texts("def f(a): return a\n", ignore_signatures=False) == ["def f(a): return a"]


def test_context_and_scope():
    source = "A = 1\nclass C:\n    x = 1\n    def f(self):\n        y = 2\n        return y\nrun()\nif a:\n    b = 1\n"
    assert [(x.context, x.scope) for x in prepare(source)] == [
        ("declarative", "module"), ("declarative", "class"), ("declarative", "class"), ("executable", "function"), ("executable", "function"), ("executable", "module"), ("executable", "module"), ("executable", "module"),
    ]
    assert [(x.context, x.scope) for x in prepare("value = 1; run()\n")] == [("mixed", "module")]
    assert [(x.context, x.effective) for x in prepare("type X = (\n    int\n)\n")] == [("declarative", True), ("declarative", True), ("declarative", False)]


def test_suppression_ends_a_segment():
    source = "a = 1\nb = 2  # echoline: disable\nc = 3\n# echoline: enable\nd = 4\n"
    assert [(x.text, x.segment_id) for x in prepare(source)] == [("a = 1", 0), ("b = 2", 0), ("d = 4", 1)]
    assert [x.segment_id for x in prepare("a = 1\n# echoline: disable\n# echoline: enable\nb = 2\n", NormalizationOptions(ignore_comments=False))] == [0, 1]


def test_line_ends_marks_and_blanks():
    assert texts("﻿a = 1\r\nb = 2\r\n") == ["a = 1", "b = 2"]
    assert [x.source_line for x in prepare("\n\na = 1\n")] == [2]
    assert texts("a = 1 # ä\nü = 'é'; import os\n") == ["a = 1", "ü = 'é'"]
    assert [source_line_count(s) for s in ("", "a", "a\n", "a\n\n", "\n")] == [0, 1, 1, 2, 1]


def test_errors_have_a_place():
    with pytest.raises(SourceError) as e:
        prepare("value = 1\n)\n")
    assert (e.value.kind, e.value.line, e.value.column) == ("parse", 2, 1)
    with pytest.raises(SourceError):
        prepare("a = '\0'")


def test_prepared_files_are_made_again(spark, data):
    """Sources that parse give the normalized text, and the contexts, that the tables hold."""
    import pandas as pd

    from echoline.plans import scan
    from echoline.sources.python_frontend import prepared_lines

    made = prepared_lines(scan._prepared(spark, data)).toPandas().sort_values(["file_id", "nline"])
    given = pd.read_parquet(f"{data}/prepared_files.parquet").set_index("file_id").normalized
    whole = made.groupby("file_id").text.agg("\n".join)
    assert len(whole) > 30 and (whole == given.loc[whole.index]).all()
    lines = pd.read_parquet(f"{data}/prepared_lines.parquet").drop_duplicates().merge(made, on=["file_id", "nline"])
    assert (lines.text_x == lines.text_y).all() and (lines.effective_x == lines.effective_y).all()
    # the tables call statements of a class body, behind a method, part of the function
    differ = lines[lines.scope_x != lines.scope_y]
    assert set(zip(differ.scope_x, differ.scope_y, strict=True)) <= {("function", "class")}
