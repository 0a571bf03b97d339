"""The ledger of canonical keys."""

import json
import re
import tempfile
from collections import defaultdict

from echoline.llm import format_duplicates as fd

SCHEMA = "id bigint, text string, options string, key string"


def pairs(spark, rows, batches=1):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)  # a column named key is in the way
    parts = [fd.keyed(df.where(f"id % {batches} = {b}"), "id", "text", "options") for b in range(batches)]
    with tempfile.TemporaryDirectory() as folder:
        for part in parts:
            fd.Ledger(spark, folder).update(part)
        ledger = fd.Ledger(spark, folder).load().cache()
        ledger.count()
    whole = fd.keyed(df, "id", "text", "options")
    return sorted((r.first_id, r.copy_id) for r in fd.copies_of(whole, ledger).collect()), {r.key: (r.copies, r.first_id) for r in ledger.collect()}


def test_forms_that_say_the_same(spark):
    off = {"ignore_comments": False}
    rows = [
        (5, "A = b(1)\n", None), (3, "a=B ( 1 )", "{}"), (9, "a == b, 1", json.dumps({"IGNORE-Comments": True})), (4, "a = b(1)", json.dumps(off)), (6, "a=b(1)", json.dumps({"Ignore_comments": False, "other": 1})),
        (7, "a_b1", None), (8, None, None), (1, " \n;", None), (2, "", None), (10, "Ü é", None), (11, "ü\té!", "no json"),
    ]
    assert pairs(spark, rows)[0] == [(3, 5), (3, 9), (4, 6), (10, 11)]


def test_batches_repeats_and_empty(spark):
    rows = [(n, f"x{n % 3}", None) for n in range(12)] + [(0, "x0", None)]
    assert pairs(spark, rows, 1) == pairs(spark, rows, 4)
    assert sorted(pairs(spark, rows)[1].values()) == [(4, 1), (4, 2), (5, 0)]
    assert pairs(spark, []) == ([], {})


def test_prepared_files_against_brute_force(spark, data):
    import pandas as pd

    from echoline.llm import queries

    files = pd.read_parquet(f"{data}/prepared_files.parquet").sort_values("file_id")
    groups = defaultdict(list)
    for i, text, options in zip(files.file_id, files.normalized, files.option_json, strict=True):
        key = re.sub(r"\W", "", text.lower()) if text else ""
        named = {k.lower().replace("-", "_"): v for k, v in json.loads(options).items()} if options else {}
        if key:
            groups[key, tuple(named.get(o, True) for o in fd.OPTIONS)].append(i)
    expected = sorted((g[0], i) for g in groups.values() for i in g[1:])
    assert sorted((r.first_id, r.copy_id) for r in queries.p3_found(spark, data).collect()) == expected


def test_each_record_once_with_its_copies(spark, data):
    import pandas as pd

    from echoline.llm import catalog

    files = pd.read_parquet(f"{data}/prepared_files.parquet")
    groups = defaultdict(list)
    for i, text, options in zip(files.file_id, files.normalized, files.option_json, strict=True):
        named = {k.lower().replace("-", "_"): v for k, v in json.loads(options).items()} if options else {}
        if key := re.sub(r"\W", "", text.lower()) if text else "":
            groups[key, tuple(named.get(o, True) for o in fd.OPTIONS)].append(i)
    expected = sorted((min(g), len(g)) for g in groups.values())
    assert sorted((r.first_id, r.copies) for r in catalog.QUERIES["p3_copies"](spark, data).collect()) == expected
    assert max(n for _, n in expected) > 1


def test_an_update_touches_only_its_buckets(spark, tmp_path):
    df = spark.createDataFrame([(n, f"text {n}", None, None) for n in range(200)], SCHEMA)
    keys = fd.keyed(df, "id", "text", "options", buckets=16)
    ledger = fd.Ledger(spark, str(tmp_path))
    assert ledger.load().count() == 0 and ledger.update(keys.where("false")) == []
    assert ledger.update(keys) == list(range(16))
    before = dict(ledger.parts)
    one = keys.where("id = 7")
    bucket = one.first().bucket
    again = fd.Ledger(spark, str(tmp_path))
    plan = fd.updated(again.load([bucket]), one)._jdf.queryExecution().executedPlan().toString()
    assert "Location: InMemoryFileIndex(1 paths)" in plan  # of 16 buckets one is read
    assert again.update(one) == [bucket]
    assert {b for b in before if again.parts[b] != before[b]} == {bucket}
    read = {r.first_id: r.copies for r in fd.Ledger(spark, str(tmp_path)).load().collect()}
    assert read == {n: 2 if n == 7 else 1 for n in range(200)}


def test_a_lost_update_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, None)], SCHEMA)
    keys = fd.keyed(df, "id", "text", "options")
    ledger = fd.Ledger(spark, str(tmp_path))
    ledger.update(keys)
    other = fd.Ledger(spark, str(tmp_path))
    other._commit = lambda *_: None  # ends before the manifest is there
    other.update(keys)
    assert [r.copies for r in fd.Ledger(spark, str(tmp_path)).load().collect()] == [1]
    fd.Ledger(spark, str(tmp_path)).update(keys)
    assert [r.copies for r in fd.Ledger(spark, str(tmp_path)).load().collect()] == [2]
