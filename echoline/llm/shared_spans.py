"""Long exact spans of lines that records share with others: seed and extend on winnowed anchors.

Seed: every record's lines are hashed once, every few consecutive lines form a gram, and of each run of
grams that a span of min_lines holds the smallest is an anchor (winnowing). Any span of min_lines that two
records share therefore has an anchor in both, at the same place. Anchors alone meet each other; only those
that stand in more than one record go on, which is known before anything is made of them.

Extend: from an anchor that is shared, the match must reach min_lines in some way to the left and right.
Each way is a window of min_lines that holds the anchor; windows are keyed by a 128-bit digest of their
lines, and those found in several records are kept. Longer matches are unions of such windows, so the
maximal spans are the islands of kept windows. No pairs of records are formed anywhere: a block that a third
of all records hold costs one row per occurrence. Keys that meet rows are tables of their own, so that small
ones are broadcast and the rows of a hot one can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.session import Scratch, materialize, spread

#: Multipliers of the polynomial digests: odd constants, so multiplication loses no bits.
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

LINES_SCHEMA = "id bigint, l1 array<bigint>, l2 array<bigint>"
ANCHOR_SCHEMA = "id bigint, pos int, anchor bigint"
WINDOW_SCHEMA = "id bigint, start int, w1 bigint, w2 bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(lines: np.ndarray, size: int, multiplier: np.uint64) -> np.ndarray:
    """The digest of each `size` consecutive values."""
    n = len(lines) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * multiplier + lines[k : k + n]
    return _mix(total)


def anchors_of(grams: np.ndarray, reach: int, first: np.ndarray | None = None) -> np.ndarray:
    """Positions of the smallest gram of each `reach` consecutive ones (those that begin at `first`); ties go to the last."""
    if len(grams) < reach:
        return np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, reach)
    first = np.arange(len(runs)) if first is None else first
    return np.unique(first + reach - 1 - np.argmin(runs[first][:, ::-1], axis=1))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two digests of every line of a text."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            lines = [t.encode("utf-8", "surrogatepass").split(b"\n") for t in part.column("text").to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, lines)]).astype(np.int32))
            values = np.frombuffer(b"".join([digest(x) for own in lines for x in own]), np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values[:, k]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists], names=["id", "l1", "l2"])


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _anchors(min_lines: int, seed: int):
    reach = min_lines - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch, "l1")
            if len(values) < min_lines:
                continue
            grams = _digests(values.view(np.uint64), seed, _P1)
            # runs of grams within one record, all records at once
            first = np.arange(len(grams) - reach + 1)
            at = anchors_of(grams, reach, first[first + min_lines <= offsets[np.searchsorted(offsets, first, "right")]])
            owner = np.searchsorted(offsets, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array((at - offsets[owner]).astype(np.int32)), pa.array(grams[at].view(np.int64))], names=["id", "pos", "anchor"])

    return run


def _windows(min_lines: int, seed: int):
    """Every window of min_lines around the shared anchors of a record, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, offsets), (two, _), (pos, held) = _lists(batch, "l1"), _lists(batch, "l2"), _lists(batch, "pos")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(held))
            start = ((offsets[:-1][owner] + pos)[:, None] - np.arange(min_lines - seed + 1)[None, :]).ravel()
            owner = np.repeat(owner, min_lines - seed + 1)
            there = (start >= offsets[owner]) & (start + min_lines <= offsets[owner + 1])
            start, kept = np.unique(start[there], return_index=True)
            owner = owner[there][kept]
            w1, w2 = (_digests(x.view(np.uint64), min_lines, p)[start].view(np.int64) if len(start) else start for x, p in ((one, _P2), (two, _P1)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array((start - offsets[owner]).astype(np.int32)), pa.array(w1), pa.array(w2)], names=["id", "start", "w1", "w2"])

    return run


def in_several(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """rows whose key stands in records of more than one id.

    The keys are written first: a small table is broadcast, and else a hot key's rows are split over tasks,
    which adaptive execution can't do for an aggregate that feeds the join directly.
    """
    several = rows.groupBy(*keys).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select(*keys)
    return rows.join(scratch.write(several, "span-keys"), keys, "left_semi")


def shared_windows(records: DataFrame, id_column: str, text_column: str, scratch: Scratch, min_lines: int = 8, seed: int | None = None) -> DataFrame:
    """id and start of every window of min_lines lines that stands in another record as well."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    seed = seed or max(1, min_lines // 2)
    texts = records.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    lines = scratch.write(spread(texts).mapInArrow(_hashed, LINES_SCHEMA), "span-lines")
    anchors = lines.select("id", "l1").mapInArrow(_anchors(min_lines, seed), ANCHOR_SCHEMA)
    places = in_several(anchors, ["anchor"], scratch).groupBy("id").agg(F.collect_set("pos").alias("pos"))
    windows = scratch.write(lines.join(places, "id").mapInArrow(_windows(min_lines, seed), WINDOW_SCHEMA), "span-windows")
    return in_several(windows, ["w1", "w2"], scratch).select("id", "start")


def shared_spans(records: DataFrame, id_column: str, text_column: str, min_lines: int = 8, seed: int | None = None) -> DataFrame:
    """id, first_line and last_line (from 0, inclusive) of each maximal run of shared lines.

    A line is shared if it lies in min_lines or more consecutive lines that stand, character for
    character, in another record. Null texts and texts of fewer lines give no row; repeats inside one
    record alone do not count; repeated rows of one id count as one record.
    """
    order = Window.partitionBy("id").orderBy("start")
    fresh = F.coalesce(F.col("start") > F.lag("start").over(order) + min_lines, F.lit(True))
    with Scratch() as scratch:
        windows = shared_windows(records, id_column, text_column, scratch, min_lines, seed)
        islands = windows.distinct().withColumn("_new", fresh.cast("int")).withColumn("_island", F.sum("_new").over(order))
        spans = islands.groupBy("id", "_island").agg(F.min("start").alias("first_line"), (F.max("start") + min_lines - 1).cast("int").alias("last_line"))
        return materialize(spans.drop("_island"), "shared-spans")


def shared_shares(records: DataFrame, spans: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """For each record its number of lines, how many of them are shared, and the share."""
    lines = records.select(F.col(id_column).cast("bigint").alias("id"), F.size(F.split(F.col(text_column), "\n", -1)).alias("n_lines")).where(F.col(text_column).isNotNull())
    per = spans.groupBy("id").agg(F.sum(F.col("last_line") - F.col("first_line") + 1).alias("shared_lines"))
    shared = F.coalesce("shared_lines", F.lit(0)).cast("bigint")
    return lines.join(per, "id", "left").select("id", "n_lines", shared.alias("shared_lines"), (shared / F.col("n_lines")).alias("share"))
