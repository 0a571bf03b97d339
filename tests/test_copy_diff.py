"""Differences between two copies."""

from echoline.operators.copy_diff import CopySpec, compare_copies

SCHEMA = "k string, n bigint, v int, x double, items array<struct<a:int,b:string>>, at timestamp_ntz, loaded bigint"
SPEC = CopySpec(keys=("k", "n"), folded_keys=("k",), version="loaded", unordered=("items",), seconds=("at",), tolerance={"x": 1e-6})


def found(spark, left, right, spec=SPEC, schema=SCHEMA):
    from datetime import datetime

    fix = lambda rows: [tuple(datetime.fromisoformat(v) if isinstance(v, str) and v[:2] == "20" else v for v in r) for r in rows]
    rows = compare_copies(spark.createDataFrame(fix(left), schema), spark.createDataFrame(fix(right), schema), spec).collect()
    return sorted(((r.k, r.n, r.field_name, r.diff_kind) for r in rows), key=str)


def row(k="a", n=1, v=1, x=1.0, items=((1, "p"), (2, None)), at="2025-01-01T00:00:00.5", loaded=1):
    return (k, n, v, x, None if items is None else list(items), at, loaded)


def test_equal_in_other_form(spark):
    assert found(spark, [row()], [row(k=" A\t", x=1.0000004, items=((2, None), (1, "p")), at="2025-01-01T00:00:00", loaded=9)]) == []


def test_each_field_and_missing_rows(spark):
    left = [row(), row(n=2), row(n=3, v=None), row(n=4, items=None), row(n=5, x=None)]
    right = [row(v=2, x=1.00001), row(n=3), row(n=4, items=()), row(n=5, x=float("nan")), row(k="b", n=7)]
    assert found(spark, left, right) == sorted([
        ("a", 1, "v", "differs"), ("a", 1, "x", "differs"), ("a", 2, "*", "missing_in_right"), ("a", 3, "v", "differs"), ("a", 4, "items", "differs"), ("a", 5, "x", "differs"), ("b", 7, "*", "missing_in_left"),
    ], key=str)


def test_latest_version_counts_and_repeated_elements_matter(spark):
    left = [row(v=5, loaded=1), row(v=6, loaded=3), row(v=6, loaded=3), row(v=7, loaded=None)]
    assert found(spark, left, [row(v=6)]) == []
    assert found(spark, [row(items=((1, "p"), (1, "p"), (2, "q")))], [row(items=((1, "p"), (2, "q"), (2, "q")))]) == [("a", 1, "items", "differs")]


def test_null_keys_nan_and_empty_tables(spark):
    nan = float("nan")
    assert found(spark, [row(k=None, x=nan)], [row(k=None, x=nan)]) == []
    assert found(spark, [], []) == []
    assert found(spark, [row()], []) == [("a", 1, "*", "missing_in_right")]


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda: [row(k=rng.choice("ab"), n=n, v=rng.choice([1, 2, None]), x=rng.choice([0.0, 1e-7, 1.0])) for n in range(300) if rng.random() < 0.9]
    left, right = make(), make()
    a, b = {r[:2]: r for r in left}, {r[:2]: r for r in right}
    expected = [(*k, "*", "missing_in_right") for k in a.keys() - b.keys()] + [(*k, "*", "missing_in_left") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        expected += [(*k, "v", "differs")] * (a[k][2] != b[k][2]) + [(*k, "x", "differs")] * (abs(a[k][3] - b[k][3]) > 1e-6)
    assert found(spark, left, right) == sorted(expected, key=str)


def test_columns_of_any_name(spark):
    schema = "k string, n bigint, _leaf int, `a.b` int, _side string, loaded bigint"
    spec = CopySpec(keys=("k", "n"), version="loaded")
    left, right = [("a", 1, 1, 1, "x", 0), ("b", 1, 2, 2, None, 0)], [("a", 1, 1, 2, "x", 0), ("b", 1, 3, 2, "", 0)]
    assert found(spark, left, right, spec, schema) == [("a", 1, "a.b", "differs"), ("b", 1, "_leaf", "differs"), ("b", 1, "_side", "differs")]


def test_columns_that_one_side_lacks(spark):
    left, right = spark.createDataFrame([(1, 5, 0)], "k int, more int, loaded int"), spark.createDataFrame([(1, 0), (2, 0)], "k int, loaded int")
    rows = compare_copies(left, right, CopySpec(keys=("k",), version="loaded")).collect()
    assert sorted((r.k, r.field_name, r.diff_kind) for r in rows) == [(1, "more", "differs"), (2, "*", "missing_in_left")]


def test_nulls_inside_columns_and_keys(spark):
    schema = "k string, n bigint, items array<struct<c:string,s:string,l:array<int>>>, one struct<a:string,b:string>, loaded bigint"
    spec = CopySpec(keys=("k", "n"), version="loaded", unordered=("items",))
    base = ("a", [("m", None, [1])], ("p", None))
    others = [
        ("items", [(None, "m", [1])], ("p", None)), ("items", [("m", None, [1]), None], ("p", None)), ("items", [("m", None, [1, None])], ("p", None)),
        ("items", [("m", None, None), (None, None, [1])], ("p", None)), ("one", [("m", None, [1])], (None, "p")), ("items", [("m", None, [1]), (None, None, [])], ("p", None)),
    ]
    left = [(base[0], n, base[1], base[2], 0) for n in range(len(others) + 1)] + [(None, 99, [], None, 0)]
    right = [("a", n, items, one, 0) for n, (_, items, one) in enumerate(others)] + [("a", len(others), base[1], base[2], 0), ("\0", 99, [], None, 0)]
    expected = [("a", n, c, "differs") for n, (c, *_) in enumerate(others)] + [(None, 99, "*", "missing_in_right"), ("\0", 99, "*", "missing_in_left")]
    assert found(spark, left, right, spec, schema) == sorted(expected, key=str)
    for a, b in ([], [None]), ([("m", None, [])], [("m", None, [None])]):
        assert found(spark, [("a", 1, a, None, 0)], [("a", 1, b, None, 0)], spec, schema) == [("a", 1, "items", "differs")]


def test_each_null_inside_a_column_is_found_by_itself(spark):
    """Tables of one key, so that no other difference opens its range."""
    schema = "k int, f array<struct<c:string,s:string>>, tags array<string>, loaded int"
    spec = CopySpec(keys=("k",), version="loaded", unordered=("f", "tags"))
    cases = {
        "f": [([(None, "x")], [("x", None)]), ([("x", "y")], [("x", "y"), (None, None)]), ([], [(None, None)]), (None, []), ([None], [(None, None)])],
        "tags": [([], [None]), (None, [None]), (["a"], ["a", None])],
    }
    for column, pairs in cases.items():
        for a, b in pairs:
            row = lambda v: [(1, v if column == "f" else [], v if column == "tags" else [], 0)]  # noqa: B023, E731
            rows = compare_copies(spark.createDataFrame(row(a), schema), spark.createDataFrame(row(b), schema), spec).collect()
            assert [(r.field_name, r.diff_kind) for r in rows] == [(column, "differs")], (a, b)
    ordered = CopySpec(keys=("k",), version="loaded")
    rows = compare_copies(spark.createDataFrame([(1, [], ["a", None], 0)], schema), spark.createDataFrame([(1, [], [None, "a"], 0)], schema), ordered).collect()
    assert [r.field_name for r in rows] == ["tags"]


def test_only_rows_of_differing_records_are_moved_in_full(spark):
    left = spark.range(5000).selectExpr("id AS k", "repeat('x', 50) AS text", "0 AS loaded")
    right = left.selectExpr("k", "IF(k = 77, 'y', text) AS text", "loaded")
    rows = compare_copies(left, right, CopySpec(keys=("k",), version="loaded")).collect()
    assert [(r.k, r.field_name) for r in rows] == [(77, "text")]
