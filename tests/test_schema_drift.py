"""Changes of documents from file to file."""

import json
import random

from echoline.operators import schema_drift as sd

FIELDS = ["version", "total_lines", "findings", "findings.code", "findings.lines"]
SCHEMA = "delivery_id bigint, feed string, run_no int, received_at timestamp_ntz, payload string"


def changes(spark, files, feed="f"):
    rows = [(i, feed, run, None, p if isinstance(p, str) or p is None else json.dumps(p)) for i, (run, p) in enumerate(files)]
    found, _, _ = sd.drift(spark.createDataFrame(rows, SCHEMA), FIELDS)
    return sorted((r.run_no, r.field_path, r.change_kind) for r in found.collect())


def test_kinds_of_change(spark):
    files = [
        (1, {"version": 1, "total_lines": 3, "findings": [{"code": "x", "lines": 1}]}),
        (2, {"version": 1.0, "totalLines": 3, "findings": []}),
        (3, {"version": None, "totalLines": "3", "findings": {"n0": {"Code": "x", "lines": 2, "own": 1}}, "extra": 1}),
        (4, "no json"),
        (5, {"version": "1", "findings": [], "extra": None}),
        (6, {"version": "1", "findings": [], "extra": True}),
    ]
    assert changes(spark, files) == [
        (2, "total_lines", "renamed"), (2, "version", "retyped"),
        (3, "extra", "added"), (3, "findings", "retyped"), (3, "findings.code", "renamed"), (3, "findings.own", "added"), (3, "total_lines", "retyped"),
        (5, "findings", "retyped"), (5, "total_lines", "removed"), (5, "version", "retyped"),
        (6, "extra", "retyped"),
    ]


def test_order_repeats_and_invalid_files(spark):
    files = [(3, {"version": 2, "own": 1}), (1, {"version": 1}), (3, {"version": 2, "own": 1}), (2, None), (2, ""), (2, "[1]"), (2, '{"version": NaN}')]
    assert changes(spark, files) == [(3, "own", "added")]
    assert changes(spark, []) == []


def test_type_since_it_was_added(spark):
    files = [(1, {"own": 1}), (2, {}), (3, {"own": "a"}), (4, {"own": None}), (5, {"own": 2})]
    assert changes(spark, files) == [(2, "own", "removed"), (3, "own", "added"), (5, "own", "retyped")]


def test_blocks_give_what_one_fold_gives(spark, monkeypatch):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 1, 1.5, "a", True, [], {}])
    files = [(n, {k: value() for k in ("version", "total_lines", "one", "two") if rng.random() < 0.8} | {"findings": [{k: value() for k in ("code", "lines") if rng.random() < 0.7} for _ in range(rng.choice([0, 0, 2]))]}) for n in range(60)]
    whole = changes(spark, files)
    monkeypatch.setattr(sd, "BLOCK_RUNS", 3)
    assert changes(spark, files) == whole and len(whole) > 60


def test_names_by_evidence(spark):
    files = [(n, {"version": 1, "findings": []} | ({"total_lines": 5} if n % 2 else {"rows_seen": 5}) | ({"note": 1} if n % 3 else {})) for n in range(40)]
    rows = [(n, f"feed{n}", n, None, json.dumps(p)) for n, p in files]
    _, _, names = sd.drift(spark.createDataFrame(rows, SCHEMA), FIELDS)
    assert names.top == {"rows_seen": "total_lines"}


def test_promotion_and_casts():
    assert [sd.promote(*p) for p in [("integer", "number"), ("boolean", "integer"), (None, "list"), ("object", "list")]] == ["number", "string", "list", "string"]
    assert [sd._cast(*p) for p in [("4", "integer"), (4.0, "integer"), (4.5, "integer"), ("0.5", "number"), (1, "boolean"), ("x", "boolean"), ([1], "list"), (5, "string")]] == [4, 4, None, 0.5, True, None, "[1]", "5"]


def test_consistent_table(spark):
    files = [(1, {"version": "2", "findings": {"n0": {"code": 7, "lines": "3"}}}), (2, {"version": 3, "findings": None})]
    rows = [(n, "f", n, None, json.dumps(p)) for n, p in files]
    df = spark.createDataFrame(rows, SCHEMA)
    _, _, names = sd.drift(df, FIELDS)
    types = dict(zip(FIELDS, ["integer", "integer", "list", "string", "integer"], strict=True))
    got = {r.run_no: r for r in sd.consistent_table(df, names, types).collect()}
    assert (got[1].version, got[1].findings[0].code, got[1].findings[0].lines) == (2, "7", 3)
    assert (got[2].version, got[2].total_lines, got[2].findings) == (3, None, None)


def test_no_value_is_lost_from_the_consistent_table(spark):
    fields = {"version": "integer", "done": "boolean", "duplication_percent": "number", "findings": "list", "findings.code": "string", "findings.lines": "integer"}
    odd = [None, 1, 4.5, 2**70, 2**53 + 1, True, "0.03%", "7 %", "1,5", "nan", "", "1e999999999", "9007199254740993.0", [1], {"a": 1}]
    documents = [{k: v for k in ("version", "done", "duplication_percent")} | {"findings": [{"code": v, "lines": v}, v]} for v in odd]
    documents += [{"findings": v} for v in odd] + [{"version": 1, "Version": 2, "findings": [{"lines": 3, "Lines": "3"}]}, {"version": None, "Version": 5}]
    df = spark.createDataFrame([(n, "f", n, None, json.dumps(d)) for n, d in enumerate(documents)], SCHEMA)
    names = sd.Names(list(fields), "findings", {"Version": "version"}, {"Lines": "lines"})
    got = {r.run_no: r for r in sd.consistent_table(df, names, fields).collect()}
    for n, d in enumerate(documents[: 2 * len(odd)]):
        kept = {(u.field_path, u.position): u.value for u in got[n].unheld}
        for k, v in d.items():
            if k != "findings":
                assert (got[n][k] is not None or (k, None) in kept) == (v is not None)
            elif isinstance(v, list) and len(v) == 2:
                for f, x in v[0].items():
                    assert (got[n].findings[0][f] is not None or ("findings." + f, 0) in kept) == (x is not None)
                assert len(got[n].findings) == 2 or v[1] is None or ("findings", None) in kept
            elif v is not None:
                assert got[n].findings or ("findings", None) in kept
    percents = {d["duplication_percent"]: got[n].duplication_percent for n, d in enumerate(documents) if isinstance(d.get("duplication_percent"), str)}
    assert percents == {"0.03%": 0.03, "7 %": 7.0} | dict.fromkeys(["1,5", "nan", "", "1e999999999", "9007199254740993.0"])
    both, later = got[len(documents) - 2], got[len(documents) - 1]
    assert (both.version, both.findings[0].lines, [tuple(u) for u in both.unheld]) == (1, 3, [("version", None, "2")])
    assert (later.version, later.unheld) == (5, [])


def test_union_schema_holds_every_value(spark):
    files = [(1, {"version": 1, "total_lines": 3}), (2, {"Version": "1a", "total_lines": 3.5}), (3, {"version": None, "findings": [{"code": True}, {"code": "x", "lines": 2}]})]
    df = spark.createDataFrame([(n, "f", n, None, json.dumps(p)) for n, p in files], SCHEMA)
    types = dict(zip(FIELDS, ["integer", "integer", "list", "boolean", "integer"], strict=True))
    _, _, names = sd.drift(df, FIELDS)
    union = sd.union_schema(df, names, types)
    assert union == {"version": "string", "total_lines": "number", "findings": "list", "findings.code": "string", "findings.lines": "integer"}
    got = {r.run_no: r for r in sd.consistent_table(df, names, union).collect()}
    assert [got[n].version for n in (1, 2, 3)] == ["1", "1a", None] and [got[n].total_lines for n in (1, 2)] == [3.0, 3.5]
    assert [e.code for e in got[3].findings] == ["true", "x"] and not any(r.unheld for r in got.values())


def test_many_names_stop_nothing(spark):
    """Every file has a name of its own; none of them comes to the driver."""
    rows = [(n, f"feed{n % 7}", n, None, json.dumps({"version": 1, f"own_{n}": n})) for n in range(3000)]
    found, _, names = sd.drift(spark.createDataFrame(rows, SCHEMA), FIELDS)
    assert names.top == {} and found.where("field_path LIKE 'own%' AND change_kind = 'added'").count() == 3000 - 7
