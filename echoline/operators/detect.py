"""Repeated blocks of normalized lines: every maximal block that occurs at least twice.

The corpus is a table of lines (file_id, nline, segment_id, text, effective). Instead of one global suffix
array, positions are grouped by the digest of their first min_lines lines (seeds), and only what repeats
goes on:
  1. a seed that occurs once lies in no block; one that always follows the same line can't begin a maximal
     block, and one that is always followed by the same line can't end one. What is left, each start with
     each end behind it, is nearly the blocks themselves: branch lengths of the suffix tree, not all lengths;
  2. files in which that leaves many pairs for each line repeat themselves at many lengths. For them the
     same test is made with blocks of 2, 4, 8, ... seeds (rank doubling by digest, one pass for all lengths),
     and what still repeats inside the file is walked as a tree, so 100,000 equal lines cost about
     n log n rows;
  3. overlapping copies in one file are removed from the left, where the file lies;
  4. a class of equal blocks is one row of an aggregation with partial sums; its rules are checked there,
     and the text of one representative is digested to its fingerprint;
  5. groups whose every occurrence lies in one longer group are dropped, by counting covered occurrences.
No step pairs the occurrences of a group. Tables of keys that meet all rows are written first, so that their
size is known (small ones are broadcast) and a hot key's rows can be split over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.functions.fingerprint import TOOL, baseline_fingerprint, finding_fingerprint
from echoline.session import Scratch, materialize

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB)
#: Pairs of a start and an end, for each line of a file, above which the file is looked at more closely.
PAIRS_A_LINE = 64
#: Lines of a bin in which covering occurrences are looked up.
BIN_LINES = 64
EXTRAS = ("source_line", "context", "scope")


def validate_min_lines(min_lines: int) -> None:
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")


def _assembled(names: list[str]):
    """Rows in order of file and line to one row a file, each line once."""

    def files(table: pa.Table) -> pa.RecordBatch:
        ids, number = table.column("file_id").to_numpy(), table.column("nline").to_numpy()
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (number[1:] != number[:-1])])
        if not fresh.all():
            table = table.filter(pa.array(fresh))
            ids, number = ids[fresh], number[fresh]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        offsets = pa.array(np.append(starts, len(ids)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(number[starts]), *lists], names=["file_id", "first", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last file so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("file_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if held and (cut or held[0].column("file_id")[0].as_py() != ids[0]):
                yield files(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield files(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield files(pa.Table.from_batches(held))

    return run


def corpus_files(lines: DataFrame) -> DataFrame:
    """One row per file: its lines in order, as arrays, with two digests of each text.

    One shuffle brings the lines of a file together, and its rows are put side by side in order. Of rows
    with one file_id and nline, which late deliveries bring, one counts (the least text). A null text is an
    empty line that is not effective; lines without a file or number are left out.
    """
    kinds = {"segments": "int", "t1": "bigint", "t2": "bigint", "effective": "boolean", "source_line": "int", "context": "string", "scope": "string", "texts": "string"}
    text = F.coalesce("text", F.lit(""))
    made = {
        "segments": F.coalesce("segment_id", F.lit(0)).cast("int"),
        "t1": F.xxhash64(text),
        "t2": F.xxhash64(F.lit(7), text),
        "effective": F.coalesce("effective", F.lit(False)) & F.col("text").isNotNull(),
        **{c: F.col(c).cast(kinds[c]) for c in EXTRAS if c in lines.columns},
        "texts": text,
    }
    rows = lines.where("file_id IS NOT NULL AND nline IS NOT NULL").select(F.col("file_id").cast("bigint").alias("file_id"), F.col("nline").cast("int").alias("nline"), *[c.alias(n) for n, c in made.items()])
    ordered = rows.repartition("file_id").sortWithinPartitions("file_id", "nline", "texts")
    schema = ", ".join(["file_id bigint, first int", *[f"{n} array<{kinds[n]}>" for n in made]])
    return ordered.mapInArrow(_assembled(list(made)), schema)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, one list after the other, and where each list begins and ends."""
    lists = batch.column(name)
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), (offsets - offsets[0]).astype(np.int64)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _lists(batch, name)[0].to_numpy(zero_copy_only=False)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K3
    return x ^ (x >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """The digest of two neighbours; not commutative, and mixed again at every level."""
    return _mixed(a * _K1 + ((b << np.uint64(27)) | (b >> np.uint64(37))) * _K2 + np.asarray(salt).astype(np.uint64))


def block_digests(lanes: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Digests of the blocks from start over length lines, by doubling: two overlapping halves of a power of two."""
    out = [np.empty(len(start), np.uint64) for _ in lanes]
    level = np.frexp(length.astype(float))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange((level.max() if len(level) else -1) + 2))
    held = [x.astype(np.int64).view(np.uint64) for x in lanes]
    for k in range(len(cuts) - 1):
        if k:
            width = 1 << (k - 1)
            held = [_joined(h[:-width], h[width:], k) for h in held]
        at = order[cuts[k] : cuts[k + 1]]
        for o, h in zip(out, held, strict=True):
            o[at] = _joined(h[start[at]], h[start[at] + length[at] - (1 << k)], length[at])
    return [o.view(np.int64) for o in out]


class _Files:
    """The lines of all files of a batch, one after the other."""

    def __init__(self, batch: pa.RecordBatch):
        values, self.offsets = _lists(batch, "t1")
        self.t1, self.t2 = values.to_numpy(zero_copy_only=False), _numbers(batch, "t2")
        n = len(self.t1)
        border = np.zeros(n + 1, bool)
        border[self.offsets] = True
        segments = _numbers(batch, "segments")
        border[1:n] |= segments[1:] != segments[:-1]
        starts = np.flatnonzero(border[:n])
        self.of = np.cumsum(border[:n]) - 1
        #: where the segment of each line begins and ends
        self.begin, self.end = starts[self.of], np.append(starts[1:], n)[self.of]

    def before(self, at: np.ndarray) -> pa.Array:
        """The line before each place; null at a segment's start."""
        return pa.array(self.t1[np.maximum(at - 1, 0)], mask=at == self.begin[at])

    def behind(self, at: np.ndarray, length: np.ndarray) -> pa.Array:
        stop = at + length
        return pa.array(self.t1[np.minimum(stop, len(self.t1) - 1)], mask=stop == self.end[at])


SEED_SCHEMA = "file_id bigint, pos int, s1 bigint, s2 bigint, prev bigint, next bigint"


def _seeds(min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _Files(batch)
            at = np.flatnonzero(np.arange(len(f.t1)) + min_lines <= f.end)
            length = np.full(len(at), min_lines)
            owner = np.searchsorted(f.offsets, at, "right") - 1
            s1, s2 = block_digests([f.t1, f.t2], at, length)
            columns = [batch.column("file_id").take(pa.array(owner)), pa.array((at - f.offsets[owner]).astype(np.int32)), pa.array(s1), pa.array(s2), f.before(at), f.behind(at, length)]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "pos", "s1", "s2", "prev", "next"])

    return run


def seeds(files: DataFrame, min_lines: int) -> DataFrame:
    """Every run of min_lines lines inside a segment, with its digests and the lines before and behind (null at a segment's ends)."""
    return files.select("file_id", "segments", "t1", "t2").mapInArrow(_seeds(min_lines), SEED_SCHEMA)


def _all_same(name: str) -> Column:
    """All rows have one value in `name`, and none lacks it: then the block extends everywhere alike."""
    return (F.min(name) == F.max(name)) & (F.count(name) == F.count("*"))


def _differs(name: str) -> Column:
    return ~F.coalesce(_all_same(name), F.lit(False))


def repeated_seeds(seeded: DataFrame, keys: tuple[str, ...] = ("s1", "s2")) -> DataFrame:
    """Keys that occur twice or more; `starts` unless the same line stands before each, `ends` unless it stands behind each."""
    return seeded.groupBy(*keys).agg(F.count("*").alias("n"), _differs("prev").alias("starts"), _differs("next").alias("ends")).where("n > 1").drop("n")


def _blocks_type(extras: list[str]) -> str:
    more = {"source_line": "start_line bigint, end_line bigint", "context": "context string", "scope": "scope string"}
    return ", ".join(["file_id bigint, nstart int, nlen int, effective_lines int, d1 bigint, d2 bigint, prev bigint, next bigint", *[more[c] for c in extras]])


def _folded(batch: pa.RecordBatch, name: str, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The value that all lines of each block have, 'mixed' if they differ; lines without one don't count."""
    coded = _lists(batch, name)[0].dictionary_encode()
    words = [*coded.dictionary.to_pylist(), "mixed"]
    there = np.append(pc.is_valid(coded).to_numpy(zero_copy_only=False), True)
    codes = np.append(pc.fill_null(coded.indices, 0).to_numpy(), 0)
    n = len(codes) - 1
    index = np.arange(n + 1)
    following = np.minimum.accumulate(np.where(there, index, n)[::-1])[::-1]  # the next line that has a value
    latest = np.maximum.accumulate(np.where(there, index, 0))
    changes = np.cumsum(np.concatenate([[False], codes[latest[1:]] != codes[latest[:-1]]]))
    first = following[start]
    differ = changes[stop - 1] != changes[np.minimum(first, stop - 1)]
    return pa.array(words, pa.string()).take(pa.array(np.where(differ, len(words) - 1, codes[first]), mask=first >= stop))


def _rows(batch: pa.RecordBatch, f: _Files, at: np.ndarray, length: np.ndarray, digests: list[np.ndarray], extras: list[str]) -> pa.RecordBatch:
    owner = np.searchsorted(f.offsets, at, "right") - 1
    first = batch.column("first").to_numpy()
    effective = np.concatenate([[0], np.cumsum(_numbers(batch, "effective"))])
    last = at + np.maximum(length, 1) - 1
    columns = {
        "file_id": batch.column("file_id").take(pa.array(owner)),
        "nstart": pa.array((first[owner] + at - f.offsets[owner]).astype(np.int32)),
        "nlen": pa.array(length.astype(np.int32)),
        "effective_lines": pa.array((effective[at + length] - effective[at]).astype(np.int32)),
        "d1": pa.array(digests[0]),
        "d2": pa.array(digests[1]),
        "prev": f.before(at),
        "next": f.behind(at, length),
    }
    for c in extras:
        if c == "source_line":
            lines = pc.add(pc.cast(_lists(batch, c)[0], pa.int64()), 1)
            columns |= {"start_line": lines.take(pa.array(at)), "end_line": lines.take(pa.array(last))}
        else:
            columns[c] = _folded(batch, c, at, last + 1)
    return pa.RecordBatch.from_pydict(columns)


class _Places:
    """Where blocks may begin and end in the files of a batch, from the repeated seeds."""

    def __init__(self, batch: pa.RecordBatch, f: _Files):
        pos, held = _lists(batch, "pos")
        at = np.repeat(f.offsets[:-1], np.diff(held)) + pos.to_numpy()
        gaps = (np.diff(at) != 1) | (np.diff(f.of[at]) != 0) if len(at) else np.empty(0, bool)
        last = np.append(gaps, True)
        #: the last seed of the run of repeated seeds around each
        whole = at[last][np.cumsum(np.concatenate([[0], last[:-1]])).astype(int)] if len(at) else at
        starts, ends = _numbers(batch, "starts").astype(bool), _numbers(batch, "ends").astype(bool)
        self.starts, self.limit, self.ends = at[starts], whole[starts], at[ends]
        self.low, self.high = np.searchsorted(self.ends, self.starts), np.searchsorted(self.ends, self.limit, "right")
        self.owner = np.searchsorted(f.offsets, self.starts, "right") - 1
        self.pairs = np.bincount(self.owner, self.high - self.low, batch.num_rows)


def _kept(owner: np.ndarray, at: np.ndarray, length: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """Which blocks stay when, of equal ones in a file, those that begin before an earlier kept one ends are left out."""
    order = np.lexsort((at, d1, length, owner))
    o, a, n, d = owner[order], at[order], length[order], d1[order]
    same = (o[1:] == o[:-1]) & (n[1:] == n[:-1]) & (d[1:] == d[:-1])
    keep = np.ones(len(a), bool)
    clash = np.flatnonzero(same & (a[1:] - a[:-1] < n[1:])) + 1
    if len(clash):
        classes = np.cumsum(np.concatenate([[False], ~same]))
        for c in np.unique(classes[clash]).tolist():  # only classes that overlap themselves
            low, high = np.searchsorted(classes, [c, c + 1])
            end = -1
            for i in range(low, high):
                if a[i] < end:
                    keep[i] = False
                else:
                    end = a[i] + n[i]
    return order[keep]


def _blocks(min_lines: int, extras: list[str], pairs_a_line: int, most: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _Files(batch)
            p = _Places(batch, f)
            deep = p.pairs > pairs_a_line * (np.diff(f.offsets) + 1)
            use = ~deep[p.owner]
            starts, low, high, owner = p.starts[use], p.low[use], p.high[use], p.owner[use]
            # parts of about `most` pairs, a file never split
            size = np.bincount(owner, high - low, batch.num_rows)
            parts = (np.cumsum(size) // most)[owner]
            for part in np.unique(parts):
                i = np.flatnonzero(parts == part)
                counts = high[i] - low[i]
                whose = np.repeat(i, counts)
                at = starts[whose]
                end = p.ends[low[whose] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
                length = end - at + min_lines
                digests = block_digests([f.t1, f.t2], at, length)
                keep = _kept(owner[whose], at, length, digests[0])
                yield _rows(batch, f, at[keep], length[keep], [d[keep] for d in digests], extras)
            if deep.any():  # told by a length of 0
                at = f.offsets[:-1][deep]
                yield _rows(batch, f, at, np.zeros(len(at), int), [np.zeros(len(at), np.int64)] * 2, extras)

    return run


LONG_SCHEMA = "file_id bigint, level int, pos int, d1 bigint, d2 bigint, prev bigint, next bigint"


def _long_blocks(min_lines: int):
    """Blocks of min_lines * 2 ** level lines, level 1 and up, that begin or end where a repeated block may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _Files(batch)
            p = _Places(batch, f)
            # runs of repeated seeds again, seen from their ends
            pos, held = _lists(batch, "pos")
            seed = np.repeat(f.offsets[:-1], np.diff(held)) + pos.to_numpy()
            fresh = np.concatenate([[True], (np.diff(seed) != 1) | (np.diff(f.of[seed]) != 0)]) if len(seed) else np.empty(0, bool)
            begin = seed[fresh][np.cumsum(fresh) - 1][_numbers(batch, "ends").astype(bool)]
            found = [[], [], []]
            size, level = 2 * min_lines, 1
            while size <= len(f.t1):
                front = p.starts[p.starts + size - min_lines <= p.limit]
                back = p.ends - size + min_lines
                at = np.unique(np.concatenate([front, back[back >= begin]]))
                if not len(at):
                    break
                for column, x in zip(found, (at, np.full(len(at), size), np.full(len(at), level)), strict=True):
                    column.append(x)
                size, level = 2 * size, level + 1
            at, length, levels = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in found)
            owner = np.searchsorted(f.offsets, at, "right") - 1
            d1, d2 = block_digests([f.t1, f.t2], at, length)
            columns = [batch.column("file_id").take(pa.array(owner)), pa.array(levels.astype(np.int32)), pa.array((at - f.offsets[owner]).astype(np.int32)), pa.array(d1), pa.array(d2), f.before(at), f.behind(at, length)]
            yield pa.RecordBatch.from_arrays(columns, names=["file_id", "level", "pos", "d1", "d2", "prev", "next"])

    return run


def _suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a text, and the common prefix of each with the one before; by doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width, levels = 1, [rank]
    while rank.max(initial=0) < n - 1:
        behind = np.full(n, -1, np.int64)
        behind[:-width] = rank[width:]
        rank = np.unique(rank * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool) if n else np.zeros(0, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = np.where(same, 1 << k, 0)
        a, b, common[1:] = a + step, b + step, common[1:] + step
    return order, common


def _walk(f: _Files, at: np.ndarray, limit: np.ndarray, allowed) -> Iterator[tuple[int, int]]:
    """Start and length of every kept block of one file, from the tree of its suffixes.

    Starts `at` have blocks of up to `limit` lines. Starts whose blocks of a length are equal form one set,
    which only grows as lengths fall; sets are joined small into large. For each length that `allowed`
    gives for a set, its kept members are found by jumps, without a look at the others.
    """
    low, high = int(at.min()), int((at + limit).max())
    tokens = np.unique(f.t1[low:high], return_inverse=True)[1].astype(np.int64)
    order, common = _suffix_order(tokens)
    place = np.full(len(tokens), -1)
    place[at - low] = np.arange(len(at))
    chosen = np.flatnonzero(place[order] >= 0)
    member = place[order[chosen]]
    # common prefix with the start before it in order, cut where blocks must end
    shared = np.minimum.reduceat(common[: chosen[-1] + 1], chosen[:-1] + 1) if len(chosen) > 1 else np.empty(0, np.int64)
    shared = np.minimum(shared, np.minimum(limit[member[:-1]], limit[member[1:]]))
    sets: list[list[int]] = [[int(at[m])] for m in member]
    top = limit[member].tolist()
    parent = list(range(len(member)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def emit(i: int, below: int) -> Iterator[tuple[int, int]]:
        members = sets[i]
        for n in allowed(members[0], below, top[i]):
            k = 0
            while k < len(members):
                yield members[k], n
                k = bisect_left(members, members[k] + n, k + 1)

    by_depth = np.argsort(-shared, kind="stable")
    i = 0
    while i < len(by_depth):
        depth = int(shared[by_depth[i]])
        j = i
        while j < len(by_depth) and shared[by_depth[j]] == depth:
            j += 1
        edges = by_depth[i:j].tolist()
        for r in {root(x) for e in edges for x in (e, e + 1)}:
            if top[r] > depth:
                yield from emit(r, depth)
                top[r] = depth
        for e in edges:
            a, b = root(e), root(e + 1)
            if len(sets[a]) < len(sets[b]):
                a, b = b, a
            parent[b] = a
            big = sets[a]
            for x in sets[b]:
                big.insert(bisect_left(big, x), x)
            sets[b] = []
        i = j
    for r in {root(x) for x in range(len(member))}:
        yield from emit(r, 0)


def _deep_blocks(min_lines: int, extras: list[str], most: int = 1 << 18):
    """Blocks of files that repeat themselves at many lengths; `levels` has the repeated blocks of each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                f = _Files(batch)
                p = _Places(batch, f)
                pos, flags = _lists(batch, "levels")[0].flatten()[1].to_numpy(), _lists(batch, "levels")[0].flatten()
                level, starts, ends = flags[0].to_numpy(), flags[2].to_numpy(zero_copy_only=False).astype(bool), flags[3].to_numpy(zero_copy_only=False).astype(bool)
                front, back = [set(p.starts.tolist())], [p.ends + min_lines]
                for k in range(1, level.max(initial=0) + 1):
                    here = level == k
                    front.append(set(pos[here & starts].tolist()))
                    back.append(np.sort(pos[here & ends]) + (min_lines << k))

                def allowed(start: int, below: int, top: int) -> Iterator[int]:
                    for k, stops in enumerate(back):  # noqa: B023
                        low, high = max(below + 1, min_lines << k), min(top, (min_lines << (k + 1)) - 1)
                        if low > top:
                            return
                        if start in front[k] and high >= low:  # noqa: B023
                            a, b = np.searchsorted(stops, [start + low, start + high + 1])
                            yield from (stops[a:b] - start).tolist()

                pairs: list[tuple[int, int]] = []

                def rows() -> pa.RecordBatch:
                    at, length = (np.array(x, np.int64) for x in zip(*pairs, strict=True))  # noqa: B023
                    return _rows(batch, f, at, length, block_digests([f.t1, f.t2], at, length), extras)  # noqa: B023

                if len(p.starts):
                    for pair in _walk(f, p.starts, p.limit + min_lines - p.starts, allowed):
                        pairs.append(pair)
                        if len(pairs) >= most:
                            yield rows()
                            pairs = []
                if pairs:
                    yield rows()

    return run


def with_keys(seeded: DataFrame, keys: DataFrame) -> DataFrame:
    """Positions of repeated seeds; keys is a written table, so a hot seed's rows can be split."""
    return seeded.select("file_id", "pos", "s1", "s2").join(keys, ["s1", "s2"])


def with_classes(made: DataFrame, told: DataFrame) -> DataFrame:
    """Occurrences with the fingerprints of their class; told is a written table, so a hot class can be split."""
    return made.join(told, CLASS)


def _held(files: DataFrame, seeded: DataFrame, keys: DataFrame) -> DataFrame:
    """Files that have repeated seeds, with their places."""
    places = with_keys(seeded, keys).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", "starts", "ends"))).alias("p"), F.max("starts").alias("some"))
    places = places.where("some").select("file_id", *[F.col(f"p.{c}").alias(c) for c in ("pos", "starts", "ends")])
    return files.drop("texts").join(places, "file_id")


def blocks(files: DataFrame, min_lines: int, scratch: Scratch, pairs_a_line: int = PAIRS_A_LINE) -> DataFrame:
    """Blocks that may be maximal and occur twice, overlapping copies of a file removed: columns of _blocks_type."""
    extras = [c for c in EXTRAS if c in files.columns]
    schema = _blocks_type(extras)
    seeded = seeds(files, min_lines)
    keys = scratch.write(repeated_seeds(seeded), "detect-seeds")
    held = _held(files, seeded, keys)
    made = scratch.write(held.mapInArrow(_blocks(min_lines, extras, pairs_a_line), schema).where(f"nlen = 0 OR effective_lines >= {min_lines}"), "detect-blocks")
    deep = made.where("nlen = 0").select("file_id")
    if deep.isEmpty():
        return made
    deep = scratch.write(deep, "detect-deep")
    long = held.mapInArrow(_long_blocks(min_lines), LONG_SCHEMA)
    level_keys = ["level", "d1", "d2"]
    repeated = scratch.write(repeated_seeds(long, tuple(level_keys)), "detect-levels")
    close = held.join(deep, "file_id", "left_semi")
    again = close.mapInArrow(_long_blocks(min_lines), LONG_SCHEMA).join(repeated, level_keys)
    levels = again.groupBy("file_id").agg(F.collect_list(F.struct("level", "pos", "starts", "ends")).alias("levels"))
    none = F.array().cast("array<struct<level:int,pos:int,starts:boolean,ends:boolean>>")
    rows = close.join(levels, "file_id", "left").withColumn("levels", F.coalesce("levels", none))
    more = rows.mapInArrow(_deep_blocks(min_lines, extras), schema).where(f"effective_lines >= {min_lines}")
    return made.where("nlen > 0").unionByName(scratch.write(more, "detect-deep-blocks"))


CLASS = ["nlen", "effective_lines", "d1", "d2"]


def _classes(made: DataFrame, same_file: bool) -> DataFrame:
    """Classes with two occurrences or more that neither extend alike to the left nor to the right, with the first occurrence and their number."""
    found = made.groupBy(*CLASS).agg(
        F.count("*").alias("size"), F.min("file_id").alias("_low"), F.max("file_id").alias("_high"), F.min(F.struct("file_id", "nstart")).alias("first"),
        _differs("prev").alias("_left"), _differs("next").alias("_right"),
    )
    rule = (F.col("size") >= 2) & F.col("_left") & F.col("_right")
    if not same_file:
        rule = rule & (F.col("_low") < F.col("_high"))
    return found.where(rule).drop("_low", "_high", "_left", "_right")


def _fingerprinted(classes: DataFrame, files: DataFrame, tool: str) -> DataFrame:
    """classes with the fingerprints of their text, which is read at the first occurrence only."""
    at = classes.select(F.col("first.file_id").alias("file_id"), *CLASS, "size", "first")
    read = at.join(files.select("file_id", F.col("first").alias("_from"), "texts"), "file_id")
    texts = F.slice("texts", F.col("first.nstart") - F.col("_from") + 1, F.col("nlen"))
    both = {
        "fingerprint": finding_fingerprint(F.col("_texts"), F.col("effective_lines"), F.col("nlen"), tool),
        "baseline_fingerprint": baseline_fingerprint(F.col("_texts"), F.col("effective_lines"), tool),
    }
    return read.select(*CLASS, "size", "first", texts.alias("_texts")).withColumns(both).drop("_texts")


def contained(groups: DataFrame) -> DataFrame:
    """Fingerprints of groups all of whose occurrences lie inside occurrences of one longer group.

    Occurrences meet the longer ones that cover their first line, in bins of lines, and are counted for each
    pair of groups: as occurrences of a group don't overlap in a file, each is covered by one of the longer
    group's at most. groups: fingerprint, size (occurrences of the group), file_id, nstart, nlen.
    """
    number = lambda line: F.floor(line / BIN_LINES).cast("int")
    small = groups.select(F.col("fingerprint").alias("small"), "size", "file_id", F.col("nstart").alias("a"), (F.col("nstart") + F.col("nlen")).alias("z"), number(F.col("nstart")).alias("bin"))
    bins = F.explode(F.sequence(number(F.col("nstart")), number(F.col("nstart") + F.col("nlen") - 1)))
    big = groups.select(F.col("fingerprint").alias("big"), "file_id", F.col("nstart").alias("b"), (F.col("nstart") + F.col("nlen")).alias("y"), bins.alias("bin"))
    inside = (F.col("b") <= F.col("a")) & (F.col("y") >= F.col("z")) & (F.col("y") - F.col("b") > F.col("z") - F.col("a"))
    covered = small.join(big, ["file_id", "bin"]).where(inside).groupBy("small", "big").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return covered.where("n = size").select(F.col("small").alias("fingerprint")).distinct()


def _found(lines: DataFrame, min_lines: int, same_file: bool, tool: str, pairs_a_line: int) -> DataFrame:
    validate_min_lines(min_lines)
    with Scratch() as scratch:
        files = scratch.write(corpus_files(lines), "detect-files")
        made = blocks(files, min_lines, scratch, pairs_a_line)
        told = scratch.write(_fingerprinted(_classes(made, same_file), files, tool), "detect-classes")
        rows = with_classes(made, told).withColumn("canonical", F.struct("file_id", "nstart") == F.col("first"))
        return materialize(rows.drop("d1", "d2", "prev", "next", "first"), "detect-groups")


def candidates(lines: DataFrame, min_lines: int = 4, same_file: bool = True, tool: str = TOOL, pairs_a_line: int = PAIRS_A_LINE) -> DataFrame:
    """Every occurrence of every group before containment; columns as in detect."""
    return _found(lines, min_lines, same_file, tool, pairs_a_line)


def detect(lines: DataFrame, min_lines: int = 4, same_file: bool = True, tool: str = TOOL, pairs_a_line: int = PAIRS_A_LINE) -> DataFrame:
    """Every occurrence of every reported group: fingerprint, baseline_fingerprint, effective_lines, nlen,
    size (its group's occurrences), file_id, nstart, canonical (whether it is the group's first) and, where
    lines have source_line, context and scope, start_line, end_line, context, scope.

    lines: file_id, nline (dense in a file), segment_id, text, effective. Blocks never cross a segment.
    An empty corpus has no groups; of rows with one file_id and nline one counts. pairs_a_line changes only the
    way in which files that repeat themselves are worked on.
    """
    groups = _found(lines, min_lines, same_file, tool, pairs_a_line)
    return groups.join(contained(groups), "fingerprint", "left_anti")
