"""Subjects of documents: held-out labels, and texts of no or several subjects."""

import random

from echoline.llm import subjects as sj

WORDS = {"sea": "ship wave harbour sail anchor tide captain mast", "bread": "oven dough flour crust yeast loaf baker knead"}
COMMON = "the report says that every module keeps one row of it before this".split()


def text(rng, names, passing=()):
    out = []
    for name in names:
        out += [" ".join(rng.sample(COMMON, 5) + rng.sample(WORDS[name].split(), 3)) + "." for _ in range(4)]
    out += [" ".join(rng.sample(COMMON, 6)) + f" ({rng.choice(WORDS[name].split())})" for name in passing]
    return " ".join(out + [" ".join(rng.sample(COMMON, 8)) for _ in range(3)])


def made(spark, n=300):
    rng = random.Random(2)
    truth, rows = {}, []
    for i in range(n):
        names = rng.choice([("sea",), ("bread",), ("sea", "bread"), ()])
        passing = [x for x in WORDS if x not in names and rng.random() < 0.5]
        truth[i] = set(names)
        rows.append((i, text(rng, names, passing), "en", "s"))
    labels = [(i, x.upper() + " " if i % 3 else x) for i in range(0, n, 4) for x in truth[i]] + [(0, None), (1, "no subject"), (999, "sea")]
    areas = [("sea", "Ships and the sea."), ("bread", None)]
    frames = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, subject string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame(areas, "subject string, description string")
    return truth, frames


def test_subjects_are_found(spark):
    truth, frames = made(spark)
    got = {i: set() for i in truth}
    for r in sj.subjects_of(*frames, options=sj.SubjectOptions(common=0.7)).collect():
        got[r.id].add(r.subject)
    right = sum(got[i] == truth[i] for i in truth)
    assert right >= 0.97 * len(truth)


def test_null_empty_and_no_labels(spark):
    _, (documents, labels, areas) = made(spark, 40)
    odd = spark.createDataFrame([(1000, None, None, None), (1001, "", "en", None), (1002, "…", "xx", None)], documents.schema)
    assert {r.id for r in sj.subjects_of(documents.unionByName(odd), labels, areas).collect()} < set(range(40))
    assert sj.subjects_of(documents.limit(0), labels, areas).count() == 0
    assert sj.subjects_of(documents, labels, areas.limit(0)).count() == 0
    sj.subjects_of(documents, labels.limit(0), areas).count()


def test_terms():
    assert sj.terms("GalaxyGroup HTTP_SERVERS are classes") == ["galaxy", "group", "http", "server", "are", "classe"]
    assert sj.terms("Müller's straßenbahnFahrt") == ["müller", "straßenbahn", "fahrt"]
