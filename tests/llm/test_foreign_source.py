"""Kinds of source files."""

import random

from echoline.llm import foreign_source as fs

HAND = '"""Read rows."""\nimport os\n\nLIMITS = [3, 14, 15, 92, 65]\n\n\ndef read(path, limit=10):\n    rows = []\n    with open(path) as handle:\n        for number, line in enumerate(handle):\n            if number > limit:\n                break\n            rows.append(line.strip().split(","))\n    return rows\n\n\nclass Store:\n    def __init__(self, root):\n        self.root = os.path.abspath(root)\n\n    def size(self):\n        return sum(len(r) for r in read(self.root))\n'
STUBS = "".join(f"@overload\ndef name_{n}(a: int, b: str = ...) -> 'T{n}': ...\n" for n in range(12))
MINIFIED = ";".join(f"a{n}=b[{n}]+c*{n};d.e(f,{{'g':{n}}})" for n in range(40))
NUMBERS = "rows = [\n" + "".join(f"    {n}.5, -{n}.25, {n}.125, {n},\n" for n in range(30)) + "]\n"


def kind(source):
    return fs.own_kind(source, fs.ForeignOptions())[0]


def test_kinds_by_layout():
    assert kind(HAND) is None and kind("import re; route=60; print(route+5)") is None
    assert kind(STUBS) == "generated" and kind(MINIFIED) == "minified" and kind(NUMBERS) == "data"
    assert kind(";".join(f"first_name_{n}=second_name[{n}]+third_name*{n}" for n in range(60))) == "minified"  # only spaces squeezed
    assert kind("BLOB = b'" + "\\x00\\xff" * 200 + "'\n") == "data"
    assert kind("# rows used to be auto-generated; they are written by hand now\n" + HAND) is None
    assert kind(HAND + '\nHEADER = "# @generated by toolset"\n') is None
    assert kind(HAND + '\nHELP = "' + "words of a long help text that goes on " * 30 + '"\n') is None
    assert [kind(x) for x in (None, "", " \n", "\ufeff", "# note\n", "'unclosed", "x = 'a\n" * 3)] == [None] * 7


def test_canonical_layout():
    layout = fs.Layout("a=1;b = 2 # note\nif x :  return  y\n" + "f(" + ", ".join(["argument"] * 8) + ")\n")
    assert layout.canonical(40) == ["a=1", "b=2", "if x:return y", "f(argument,argument,argument,argument,", "argument,argument,argument,argument)"]


def test_folders_are_learned(spark):
    """A folder of proven copies tells the copies of packages that are not published, and a name in a header others."""
    shapes = ["value_{0}_{1} = compute_{0}({1})", "if problem_{0} > {1}: raise Problem_{0}", "for item_{1} in table_{0}: print(item_{1})", "return_{0}.append([{1}, total_{0}])", "del cache_{0}['key {1}']", "assert state_{0} != {1}, 'no state'"]

    def body(n):
        rng = random.Random(n)
        return "".join(rng.choice(shapes).format(n, rng.randint(100, 999)) + "\n" for _ in range(12))

    rows = [(n, f"p{n % 5}", f"lib/strange_place/sub{n}/a.py", body(n)) for n in range(10)]  # published
    rows += [(n, f"p{n % 5}", "lib/strange_place/otherpkg/a.py", body(n)) for n in range(10, 16)]  # not published
    rows += [(16, "p1", "src/a.py", "# otherpkg 1.2, taken over\n" + body(16)), (17, "p1", "src/b.py", "# not the other pkg\n" + body(17))]
    rows += [(n, f"p{n % 5}", f"lib/usual_place/m{n}/a.py", body(n)) for n in range(18, 60)]  # written by hand
    rows += [(60, "p1", "lib/strange_place_too/a.py", body(60))]
    files = spark.createDataFrame(rows, "file_id bigint, project string, path string, source string")
    packages = spark.createDataFrame([(f"{n}.py", body(n)) for n in range(10)], "path string, source string")
    found = {r.id: r.kind for r in fs.classify(files, packages).collect()}
    assert found == dict.fromkeys(range(17), "vendored")


def test_copies_of_packages(spark):
    changed = HAND.replace('"', "'").replace("    ", "\t").upper().replace("LIMIT=10", "LIMIT = 11")
    rows = [(1, "a/x.py", HAND), (2, "b/y.py", changed), (3, "c/z.py", "import os\n"), (4, "d.py", None), (5, "e.py", STUBS)]
    files = spark.createDataFrame([(*r, "k", None) for r in rows], "file_id bigint, path string, source string, kind string, project string")
    packages = spark.createDataFrame([("p/x.py", HAND)], "path string, source string")
    found = {r.id: r.kind for r in fs.classify(files, packages).collect()}
    assert found == {1: "vendored", 2: "vendored", 5: "generated"}
    short = spark.createDataFrame([("p/z.py", "import  os\n")], "path string, source string")  # compared as a whole
    assert {r.id: r.kind for r in fs.classify(files, short).collect()} == {3: "vendored", 5: "generated"}
    assert fs.classify(files.limit(0), packages.limit(0)).count() == 0
    assert {r.id for r in fs.classify(files, packages.limit(0)).collect()} == {5}


def test_tables_have_all_kinds(spark, data):
    from echoline.llm import queries

    rows = queries.p5_found(spark, data).collect()
    assert {r.kind for r in rows} == {"generated", "minified", "vendored", "data"} and len({r.file_id for r in rows}) == len(rows)
