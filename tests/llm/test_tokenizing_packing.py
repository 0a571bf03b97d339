"""Token ids against the tokenizer library, and packings against their rules."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echoline.llm import packing, queries, tokenizing

PATH = queries.tokenizer_file()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return tokenizing.Encoder(tokenizing.MergeTable(PATH))


def ids(encoder, text):
    return [i for w in encoder.split([text])[0] for i in encoder.known[w]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aab'ts lreé \n\t 1中 \x85\x1c<|>endoftxxx", max_size=80))
def test_ids_are_the_librarys(library, encoder, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_long_and_special_texts(library, encoder):
    for text in ("a" * 5000, "<|endoftext|>", "word " * 3000, "\n" * 999, "'ll've'S", "ab" * 2001 + "é"):
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, data, library):
    import pandas as pd

    docs = pd.read_parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, data).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in zip(docs.doc_id, docs.text, strict=True)}


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello", 0), (3, "hello", 0)], "doc text string, text2 string, x int".replace("doc text string", "doc bigint").replace("text2", "text"))
    rows = sorted((r.id, len(r.ids)) for r in tokenizing.encode(df, "doc", "text", PATH).collect())
    assert rows == [(1, 0), (2, 0), (3, 1), (3, 1)] == sorted((r.id, r.tokens) for r in tokenizing.token_counts(df, "doc", "text", PATH).collect())
    assert tokenizing.encode(df.limit(0), "doc", "text", PATH).count() == 0


CLASSES = [("small", 16), ("medium", 40), ("large", 100)]


def check(rows, sizes, classes):
    capacity = dict(classes)
    per_id, held = {}, {}
    for r in rows:
        per_id.setdefault(r.id, []).append((r.piece, r.tokens))
        held.setdefault(r.container, [r.pack_class, 0])
        assert held[r.container][0] == r.pack_class
        held[r.container][1] += r.tokens
    largest = max(capacity.values())
    for i, n in sizes:
        pieces = sorted(per_id.pop(i))
        assert sum(t for _, t in pieces) == (n or 0) and [p for p, _ in pieces] == list(range(max(1, -(-(n or 0) // largest))))
    assert not per_id
    assert all(used <= capacity[name] for name, used in held.values())
    return sum(capacity[name] for name, used in held.values() if used)


def test_packing_rules(spark, monkeypatch):
    rng = random.Random(4)
    sizes = [(n, rng.choice([0, 1, 7, 7, 7, 30, 99, 100, 101, 250, None]) if n % 2 else rng.randint(1, 60)) for n in range(400)]
    monkeypatch.setattr(packing, "RANK_BLOCK", 50)
    df = spark.createDataFrame(sizes, "id bigint, tokens bigint")
    total = check(packing.pack(df, CLASSES).collect(), sizes, CLASSES)
    assert total <= 1.02 * sum(n or 0 for _, n in sizes)
    for one in CLASSES:
        check(packing.pack(df, [one]).collect(), sizes, [one])


def test_packing_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "id bigint, tokens bigint")
    assert packing.pack(df([]), CLASSES).count() == 0
    assert [(r.container, r.pack_class, r.tokens) for r in packing.pack(df([(1, 0), (2, None)]), CLASSES).collect()] == [(0, "small", 0)] * 2
    assert [r.pack_class for r in packing.pack(df([(1, 3)]), CLASSES).collect()] == ["small"]
    with pytest.raises(ValueError):
        packing.pack(df([(1, 3)]), [])


def test_groups_of_containers_are_best_fit():
    """The plan on the histogram fills as best fit does item by item."""
    rng = random.Random(9)
    for _ in range(200):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 40))), reverse=True)
        plan = packing.best_fit([(s, items.count(s)) for s in set(items)], (20,), packing.open_largest)
        spaces = []
        for s in items:
            fits = [k for k, left in enumerate(spaces) if left >= s]
            k = min(fits, key=lambda k: spaces[k]) if fits else len(spaces)
            spaces[k:k + 1] = [(spaces[k] if fits else 20) - s]
        assert sum(n for _, n, _, _ in plan.containers) == len(spaces)
        assert sum((b - a) for _, a, b, _, _ in plan.runs) == len(items)
