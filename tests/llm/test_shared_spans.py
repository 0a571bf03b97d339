"""Spans of lines shared between records, against all windows."""

import random
from collections import defaultdict

import numpy as np

from echoline.llm import shared_spans as ss
from tests.conftest import is_split


def brute(texts, m):
    held = defaultdict(set)
    lines = {i: t.split("\n") for i, t in texts if t is not None}
    for i, own in lines.items():
        for a in range(len(own) - m + 1):
            held[tuple(own[a : a + m])].add(i)
    found = []
    for i, own in lines.items():
        marked = sorted({b for a in range(len(own) - m + 1) if len(held[tuple(own[a : a + m])]) > 1 for b in range(a, a + m)})
        for k, b in enumerate(marked):
            if k == 0 or marked[k - 1] != b - 1:
                found.append([i, b, b])
            found[-1][2] = b
    return sorted(map(tuple, found))


def spans(spark, texts, m, **k):
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "id bigint, text string, anchor int")
    return sorted((r.id, r.first_line, r.last_line) for r in ss.shared_spans(df, "id", "text", m, **k).collect())


def test_random_records(spark):
    rng = random.Random(1)
    for m, seed in ((1, None), (3, None), (4, 2), (8, None)):
        texts = [(n, "\n".join(rng.choices("ab", k=rng.randint(1, 14)))) for n in range(8)]
        assert spans(spark, texts, m, seed=seed) == brute(texts, m)


def test_edges(spark):
    block = "\n".join(f"line {n}" for n in range(8))
    texts = [(1, block), (2, f"x\n{block}\ny"), (3, f"{block}\n{block}"), (4, "\n".join(block.split("\n")[:7])), (5, None), (6, ""), (7, "a\n" * 20), (8, block.replace("line 3", "line  3"))]
    assert spans(spark, texts, 8) == [(1, 0, 7), (2, 1, 8), (3, 0, 15)]
    assert spans(spark, [(1, block), (1, block)], 8) == [] == spans(spark, [], 8)
    shares = ss.shared_shares(spark.createDataFrame(texts, "id bigint, text string"), ss.shared_spans(spark.createDataFrame(texts, "id bigint, text string"), "id", "text"), "id", "text")
    assert {r.id: (r.n_lines, r.shared_lines) for r in shares.collect() if r.id in (2, 4)} == {2: (10, 8), 4: (7, 0)}


def test_every_window_holds_an_anchor():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 4, 200).astype(np.uint64)
    at = ss.anchors_of(grams, 5)
    assert all(((at >= a) & (at < a + 5)).any() for a in range(196))
    assert len(ss.anchors_of(grams[:4], 5)) == 0


def test_shares_of_all_prepared_files(spark, data):
    import pandas as pd

    from echoline.llm import catalog

    files = pd.read_parquet(f"{data}/prepared_files.parquet")
    texts = [(i, t) for i, t in zip(files.file_id, files.normalized, strict=True) if t is not None]
    shared = defaultdict(int)
    for i, first, last in brute(texts, 8):
        shared[i] += last - first + 1
    expected = {i: (n := t.count("\n") + 1, shared[i], shared[i] / n) for i, t in texts}
    rows = catalog.QUERIES["p4_shares"](spark, data).collect()
    assert len(rows) == len(expected) and {r.file_id: (r.n_lines, r.shared_lines, r.share) for r in rows} == expected
    assert sum(shared.values()) > 0


def test_fewer_rows_than_windows(spark, data):
    """Only anchors meet each other, and windows are made around shared ones alone."""
    from echoline.session import Scratch

    files = spark.read.parquet(f"{data}/prepared_files.parquet")
    with Scratch() as scratch:
        texts = files.selectExpr("file_id AS id", "normalized AS text").where("text IS NOT NULL")
        lines = scratch.write(texts.mapInArrow(ss._hashed, ss.LINES_SCHEMA), "lines")
        windows = lines.selectExpr("sum(greatest(size(l1) - 7, 0)) AS n").first().n
        anchors = lines.select("id", "l1").mapInArrow(ss._anchors(8, 4), ss.ANCHOR_SCHEMA)
        shared = ss.in_several(anchors, ["anchor"], scratch).groupBy("id").agg({"pos": "collect_set"}).toDF("id", "pos")
        emitted = anchors.count() + lines.join(shared, "id").mapInArrow(ss._windows(8, 4), ss.WINDOW_SCHEMA).count()
    assert 0 < emitted < windows


def test_rows_of_a_hot_key_are_split(spark, small_partitions):
    """A third of all rows hold one key: their join runs in several tasks."""
    from echoline.session import Scratch

    rows = spark.range(90_000).selectExpr("id", "IF(id % 3 = 0, 7, id) AS key", "hash(id) AS pos")
    with Scratch() as scratch:
        found = ss.in_several(rows, ["key"], scratch)
        assert len(found.collect()) == 30_001  # and row 7 itself
        assert is_split(found)
