"""The detector against all windows, on small random and exhaustive corpora."""

import itertools
import random
from collections import defaultdict

import pytest

from echoline.operators import detect, findings, metrics

SCHEMA = "file_id bigint, nline int, segment_id int, source_line int, text string, effective boolean, context string, scope string"


def rows_of(files):
    rows = []
    for f, segs in enumerate(files):
        n = 0
        for k, seg in enumerate(segs):
            for text in seg:
                rows.append((f, n, k, n, text, text != ")", "executable", "module"))
                n += 1
    return rows


def windows(files, m, same_file):
    """Groups (length, effective lines, occurrences) by trying every window."""
    found = defaultdict(list)
    for f, segs in enumerate(files):
        base = 0
        for seg in segs:
            for i, j in itertools.combinations(range(len(seg) + 1), 2):
                found[tuple(seg[i:j])].append((f, base + i, seg[i - 1] if i else None, seg[j] if j < len(seg) else None))
            base += len(seg)
    same = lambda xs: None not in xs and len(set(xs)) == 1
    groups = []
    for block, at in found.items():
        n, effective = len(block), sum(x != ")" for x in block)
        if n < m or len(at) < 2 or same([x[3] for x in at]):
            continue
        kept, ends = [], {}
        for x in sorted(at, key=lambda x: x[:2]):
            if x[1] >= ends.get(x[0], 0):
                kept.append(x)
                ends[x[0]] = x[1] + n
        if len(kept) < 2 or effective < m or same([x[2] for x in kept]) or same([x[3] for x in kept]) or not same_file and len({x[0] for x in kept}) < 2:
            continue
        groups.append((n, effective, tuple(x[:2] for x in kept)))
    inside = lambda big, small: big[0] > small[0] and all(any(f == g and b <= a and b + big[0] >= a + small[0] for g, b in big[2]) for f, a in small[2])
    return {g for g in groups if not any(inside(b, g) for b in groups)}


def detected(spark, files, m, same_file, pairs_a_line=detect.PAIRS_A_LINE):
    groups = detect.detect(spark.createDataFrame(rows_of(files), SCHEMA), m, same_file, pairs_a_line=pairs_a_line)
    got = defaultdict(list)
    for r in groups.collect():
        got[r.fingerprint, r.nlen, r.effective_lines].append((r.file_id, r.nstart))
    return {(k[1], k[2], tuple(sorted(v))) for k, v in got.items()}


@pytest.mark.parametrize("pairs_a_line", [detect.PAIRS_A_LINE, 0])
def test_random_corpora(spark, pairs_a_line):
    """With 0, all files that hold a repeat are worked on by levels and tree."""
    rng = random.Random(11)
    for _ in range(8):
        letters = ["a", "b", ")"][: rng.choice([1, 2, 3])]
        files = [[rng.choices(letters, k=rng.randint(1, 9)) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 4))]
        m, same_file = rng.choice([1, 2, 3]), rng.random() < 0.6
        assert detected(spark, files, m, same_file, pairs_a_line) == windows(files, m, same_file), (files, m, same_file)


CASES = [
    ([[["a", "b", "c", "d", "x"]], [["a", "b", "c", "d", "y"]]], 4, True, {(4, 4, ((0, 0), (1, 0)))}),
    ([[["a", "b", "c", "d", "gap", "a", "b", "c", "d"]]], 4, True, {(4, 4, ((0, 0), (0, 5)))}),
    ([[["a", "b", "c", "d", "gap", "a", "b", "c", "d"]]], 4, False, set()),
    ([[[")", "calc", ")", "return"]], [[")", "calc", ")", "return"]]], 3, True, set()),
    ([[[")", "calc", ")", "return"]], [[")", "calc", ")", "return"]]], 2, True, {(4, 2, ((0, 0), (1, 0)))}),
    ([[["a", "b"], ["c", "d"]], [["a", "b"], ["c", "d"]]], 4, True, set()),
    ([[["a", "b", "c", "d"]], [["a", "b", "c", "d"]], [["a", "b", "c", "z"]]], 3, True, {(4, 4, ((0, 0), (1, 0))), (3, 3, ((0, 0), (1, 0), (2, 0)))}),
    ([[["s", "s", "s", "s"]]], 1, True, {(2, 2, ((0, 0), (0, 2)))}),
]


@pytest.mark.parametrize(("files", "m", "same_file", "expected"), CASES)
def test_stated_cases(spark, files, m, same_file, expected):
    assert detected(spark, files, m, same_file) == expected == windows(files, m, same_file)


def test_empty_corpus_and_bad_length(spark):
    assert detect.detect(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        detect.detect(spark.createDataFrame([], SCHEMA), 0)


#: Digests of the lines 'alpha = 1' and 'beta = 2' in a group of two (fixed values).
FINDING = "572a68e97a82622bee89bc469c0d261ad28357d1753dd70128e424144f9d6443"
BASELINE = "80d31b6f8888c1118e22dcd6bfee46046848b0c9f944aa4a236a1cfd5c8fac2d"


def test_fingerprints_and_figures(spark, data):
    # the tool whose reports the tables hold is named in their fingerprints
    tool = spark.read.parquet(f"{data}/reports.parquet").selectExpr("inline(findings)").first().fingerprint.partition("-finding-")[0]
    lines = spark.createDataFrame(rows_of([[["alpha = 1", "beta = 2"]], [["alpha = 1", "beta = 2"]]]), SCHEMA)
    files = spark.createDataFrame([(0, "a.py", 2), (1, "b.py", 2)], "file_id bigint, path string, source_lines int")
    groups = detect.detect(lines, 2, tool=tool)
    one = groups.first()
    assert one.fingerprint == f"{tool}-finding-v1:sha256:{FINDING}"
    assert one.baseline_fingerprint == f"sha256:{BASELINE}"
    assert metrics.summary(files, lines, groups).first().asDict() == {"files": 2, "source_lines": 4, "analyzed_lines": 4, "duplicate_groups": 1, "duplicate_lines": 2, "duplication_percent": 50.0}
    found = findings.findings(groups).first()
    assert (found.lines, found.context, found.scope, found.occurrences, found.files, found.distribution) == (2, "executable", "module", 2, 2, "cross-file")


def test_redundant_lines_are_a_union(spark):
    lines = spark.createDataFrame(rows_of([[list("abcdefxxxxxx"[:6])], [list("abcdef")]]), SCHEMA)
    groups = spark.createDataFrame([("g", 0, 0, 4, True), ("g", 1, 0, 4, False), ("h", 0, 2, 4, True), ("h", 1, 2, 4, False)], "fingerprint string, file_id bigint, nstart int, nlen int, canonical boolean")
    assert metrics.redundant_lines(groups, lines).count() == 6


def test_equal_lines_cost_little(spark):
    """100,000 equal lines in one file, and a file of two kinds of lines at random: rows stay near n log n."""
    from echoline.session import Scratch

    n = 100_000
    rng = random.Random(5)
    equal = spark.range(n).selectExpr("0L AS file_id", "CAST(id AS int) AS nline", "0 AS segment_id", "'s' AS text", "true AS effective")
    mixed = spark.createDataFrame([(1, i, 0, rng.choice("ab"), True) for i in range(20_000)], equal.schema)
    with Scratch() as scratch:
        files = scratch.write(detect.corpus_files(equal.unionByName(mixed)), "files")
        rows = detect.blocks(files, 4, scratch).groupBy("file_id").count().collect()
    assert {r.file_id: r["count"] < 40 * n for r in rows} == {0: True, 1: True}


def test_hot_seeds_and_classes_are_split(spark, small_partitions):
    """A header in a third of all files: the joins of its seeds and of its occurrences run in several tasks."""
    from echoline.session import Scratch
    from tests.conftest import is_split

    header = [f"header {n}" for n in range(4)]
    rows = [(f, n, 0, text, True) for f in range(6000) for n, text in enumerate((header if f % 3 == 0 else []) + [f"own {f} {n}" for n in range(4)])]
    lines = spark.createDataFrame(rows, "file_id bigint, nline int, segment_id int, text string, effective boolean")
    with Scratch() as scratch:
        files = scratch.write(detect.corpus_files(lines), "files")
        seeded = scratch.write(detect.seeds(files, 4), "seeds")
        keys = scratch.write(detect.repeated_seeds(seeded), "keys")
        there = detect.with_keys(seeded, keys)
        assert len(there.collect()) == 2000 and is_split(there)
        made = detect.blocks(files, 4, scratch)
        told = scratch.write(detect._fingerprinted(detect._classes(made, True), files, "echoline"), "classes")
        found = detect.with_classes(made, told)
        assert len(found.collect()) == 2000 and is_split(found)
