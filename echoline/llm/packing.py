"""Filling containers of permitted capacities with items, best fit, planned on the histogram of sizes.

Items of one size are interchangeable, so which sizes meet in a container depends on the histogram alone,
and that has at most as many rows as the largest capacity, however many items there are. The plan is made
on it: sizes go in descending order, each into the containers with the least sufficient space; only when
none has room is one opened, of the permitted capacity that costs least. At the end every container
shrinks to the smallest capacity that holds its contents. Containers that look alike are kept as one run
of numbers, so the plan stays small, too: its runs follow the sizes and the different spaces left, both at
most the largest capacity, and level off (5,518 runs at a thousand times sf0.1), so the plan, 40 bytes a run,
is always broadcast. Items then find their container by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.session import materialize

#: Rows of a size that one task ranks.
RANK_BLOCK = 50_000


@dataclass
class Plan:
    #: (size, rank of the first item, rank after the last, first container, items in each container)
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    #: (first container, containers, capacity, tokens in each)
    containers: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def capacity(self) -> int:
        return sum(n * c for _, n, c, _ in self.containers)


Opening = Callable[[int, int, tuple[int, ...]], int]


def open_largest(size: int, copies: int, capacities: tuple[int, ...]) -> int:
    return capacities[-1]


def open_tightest(size: int, copies: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, size)]


def open_least_rest(size: int, copies: int, capacities: tuple[int, ...]) -> int:
    """The capacity of which items of this size leave the least share unused."""
    fits = [c for c in capacities if c >= size]
    return min(fits, key=lambda c: ((c - min(copies, c // size) * size) / c, -c))


def best_fit(histogram: Iterable[tuple[int, int]], capacities: tuple[int, ...], opening: Opening) -> Plan:
    """Best fit in descending order of size; histogram has (size, items), sizes from 1 to the largest capacity."""
    plan, spaces = Plan(), []
    #: space left -> runs of containers with it: (first, containers, tokens in each)
    free: dict[int, list[tuple[int, int, int, int]]] = {}
    made = 0

    def keep(first: int, n: int, capacity: int, used: int) -> None:
        if capacity == used:
            closed.append((first, n, used))
            return
        if not (runs := free.setdefault(capacity - used, [])):
            insort(spaces, capacity - used)
        runs.append((first, n, capacity, used))

    closed: list[tuple[int, int, int]] = []
    for size, n in sorted(histogram, reverse=True):
        rank = 0
        while n:
            if (i := bisect_left(spaces, size)) < len(spaces):
                first, count, capacity, used = free[spaces[i]].pop()
                if not free[spaces[i]]:
                    del free[spaces[i]], spaces[i]
            else:
                capacity, used = opening(size, n, capacities), 0
                first, count = made, max(1, n // (capacity // size))
                made += count
            each = (capacity - used) // size
            filled = min(count, n // each)
            if not filled:
                filled, each = 1, n
            plan.runs.append((size, rank, rank + filled * each, first, each))
            rank += filled * each
            n -= filled * each
            keep(first, filled, capacity, used + each * size)
            if count > filled:
                keep(first + filled, count - filled, capacity, used)
    held = closed + [(first, n, used) for runs in free.values() for first, n, _, used in runs]
    plan.containers = sorted((first, n, capacities[bisect_left(capacities, used)], used) for first, n, used in held)
    return plan


def plan_containers(histogram: list[tuple[int, int]], capacities: Iterable[int]) -> Plan:
    """The plan of least total capacity over the ways to choose the capacity of a new container."""
    permitted = tuple(sorted(set(capacities)))
    return min((best_fit(histogram, permitted, how) for how in (open_largest, open_least_rest, open_tightest)), key=lambda p: p.capacity)


def pieces_of(sizes: DataFrame, largest: int) -> DataFrame:
    """id, piece (from 0) and tokens: an item above the largest capacity is cut into full pieces and a rest, others stay whole."""
    count = F.greatest(F.ceil(F.col("tokens") / largest), F.lit(1))
    return (
        sizes.select("id", "tokens", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("piece"))
        .select("id", "piece", F.least(F.col("tokens") - F.col("piece").cast("bigint") * largest, F.lit(largest)).cast("int").alias("tokens"))
    )


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with their rank among those of their size, from 0.

    Each size is cut into blocks by a hash, so a size that most rows have is ranked by many tasks;
    the blocks' counts are summed up before.
    """
    blocks = max(1, -(-n // RANK_BLOCK))
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)))
    before = Window.partitionBy("tokens").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("tokens", "_block").count().select("tokens", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("tokens", "_block").orderBy("id", "piece")
    return blocked.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["tokens", "_block"]).select("id", "piece", "tokens", (F.col("_start") + F.col("_in")).alias("rank"))


def pack(sizes: DataFrame, classes: list[tuple[str, int]]) -> DataFrame:
    """id, piece, tokens, pack_class and container of every item or piece.

    sizes: id and tokens, one row for each item. classes: name and capacity of the permitted containers,
    chosen among jointly. Items of 0 tokens, for instance empty texts, lie in container 0 and take no
    space. Null sizes count as 0; repeated ids are items of their own. Without permitted containers it
    raises ValueError.
    """
    if not classes or min(c for _, c in classes) < 1:
        raise ValueError("containers need a capacity of 1 or more")
    names = {c: name for name, c in sorted(classes, reverse=True)}
    spark, largest = sizes.sparkSession, max(names)
    whole = sizes.select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    pieces = materialize(pieces_of(whole, largest), "pack-pieces")
    # at most `largest` + 1 rows
    counts = [(r["tokens"], r["count"]) for r in pieces.groupBy("tokens").count().collect()]
    plan = plan_containers([x for x in counts if x[0]], names)
    runs = plan.runs or [(0, 0, 0, 0, 1)]
    held = plan.containers or [(0, 1, min(names), 0)]
    starts = [first for first, *_ in held]
    rows = []
    for size, low, high, first, each in runs:  # cut at the borders of container runs, so that each row has one class
        while low < high:
            f, n, capacity, _ = held[bisect_left(starts, first + 1) - 1]
            stop = min(high, low + (f + n - first) * each)
            rows.append((size, low, stop, first, each, names[capacity]))
            first, low = f + n, stop
    zeros = sum(n for size, n in counts if not size)
    rows.append((0, 0, zeros, 0, max(1, zeros), names[held[0][2]]))
    lookup = spark.createDataFrame(rows, "tokens int, low bigint, high bigint, first bigint, each bigint, pack_class string")
    items = ranked(pieces, sum(n for _, n in counts)).alias("i")
    hit = (F.col("i.tokens") == F.col("r.tokens")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    place = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))
    return items.join(F.broadcast(lookup).alias("r"), hit).select("id", "piece", "i.tokens", "pack_class", place.cast("bigint").alias("container"))
