"""Differences between two copies of a table, found by hierarchical checksums.

Rows of both sides are keyed, the key is hashed into a range tree, and every range carries a
checksum and a count for each side. Ranges are split from the root, only where the two sides
disagree, down to single keys; only the rows of these are read in full and compared column by
column. So one narrow shuffle (key and digests) brings the sides together, and the wide rows that
are moved are those of records that differ.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from echoline.functions.text import strip_blank
from echoline.session import Scratch, materialize

#: Bits of the key hash by which one step splits a range, and of the smallest range above single keys:
#: at most 2 ** 20 ranges, so their table is bounded (8 MB of range numbers).
STEP_BITS, TREE_BITS = 10, 20


@dataclass(frozen=True)
class CopySpec:
    """How two copies are compared.

    keys: columns that identify a record. folded_keys: those of them compared without case and
    outer blanks. version: of several rows with one key on one side, the one with the highest
    version counts (null lowest; ties go to a fixed but arbitrary row). unordered: array columns
    that are equal if they hold the same elements equally often. seconds: timestamps compared in
    whole seconds. tolerance: doubles that differ only beyond the given distance. All else is
    compared exactly; null equals only null, also in keys.
    """

    keys: tuple[str, ...]
    version: str
    folded_keys: tuple[str, ...] = ()
    unordered: tuple[str, ...] = ()
    seconds: tuple[str, ...] = ()
    tolerance: dict[str, float] = field(default_factory=dict)


def _comparable(name: str, spec: CopySpec) -> Column:
    if name in spec.unordered:
        return F.sort_array(F.col(f"`{name}`"))
    if name in spec.seconds:
        return F.date_trunc("second", F.col(f"`{name}`"))
    return F.col(f"`{name}`")


def _summed(name: str, spec: CopySpec) -> Column:
    """What a column adds to the checksum. Equal sums hide no difference but by a collision of both digests:
    nulls are marked at any depth, and a tolerant column is cut into cells narrower than its tolerance, so
    values of one cell count as equal anyway."""
    if name in spec.tolerance:
        x = F.col(f"`{name}`").cast("double")
        cell = spec.tolerance[name] / 2
        return F.when(F.isnan(x) | (F.abs(x) > 1e12), x.cast("string")).otherwise(F.floor(x / cell).cast("string"))
    return F.col(f"`{name}`")


def _nulls(value: Column, kind: DataType) -> Column:
    """Where value, or anything inside it, is null, and how many elements its arrays have."""
    if isinstance(kind, StructType):
        there = F.concat(F.lit("1"), *[_nulls(value.getField(f.name), f.dataType) for f in kind])
    elif isinstance(kind, ArrayType):
        there = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _nulls(x, kind.elementType)), ""), F.lit("]"))
    else:
        there = F.lit("1")
    return F.when(value.isNull(), "0").otherwise(there)


def _side(df: DataFrame, columns: list[str], spec: CopySpec, side: int) -> DataFrame:
    keys = [(F.lower(strip_blank(F.col(f"`{k}`"))) if k in spec.folded_keys else F.col(f"`{k}`")).alias(k) for k in spec.keys]
    rows = df.select(*keys, F.col(f"`{spec.version}`").alias("_version"), *[_comparable(c, spec).alias(c) for c in columns])
    sums = [_summed(c, spec) for c in columns]
    place = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in spec.keys]
    # the position of a null is hashed as well, at any depth: xxhash64 skips nulls
    marks = F.concat(*[F.when(F.col(f"`{k}`").isNull(), "0").otherwise("1") for k in spec.keys], *[_nulls(s, rows.schema[c].dataType) for c, s in zip(columns, sums, strict=True)])
    return rows.select(
        F.lit(side).alias("_side"),
        F.xxhash64(F.lit(17), *place).alias("_place"),
        F.xxhash64(F.lit(1), marks, *place, *sums).alias("_h1"),
        F.xxhash64(F.lit(2), marks, *place, *sums).alias("_h2"),
        "*",
    )


def _latest(value: Column, side: int) -> Column:
    order = F.struct("_version", "_h1", "_h2")
    here = F.col("_side") == side
    return F.max_by(F.when(here, value), F.when(here, order))


def _mismatched(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """_place of every key whose checksums differ, reached from the root through differing ranges only."""
    per_key = rows.groupBy("_place", *keys).agg(
        _latest(F.struct("_h1", "_h2"), 0).alias("a"), _latest(F.struct("_h1", "_h2"), 1).alias("b")
    )
    sums = [F.col(f"{s}._h{i}").alias(f"{s}{i}") for s in "ab" for i in (1, 2)]
    records = scratch.write(per_key.select("_place", *sums), "copy-keys")
    number = lambda bits: F.shiftrightunsigned("_place", 64 - bits) if bits else F.lit(0).cast("bigint")
    #: at most 2 ** TREE_BITS ranges, so their table and any list of them may be sent to all
    up = [F.coalesce(F.bit_xor(f"{s}{i}"), F.lit(0)).alias(f"{s}{i}") for s in "ab" for i in (1, 2)]
    counts = [F.count(f"{s}1").alias(f"n{s}") for s in "ab"]
    leaves = scratch.write(records.groupBy(number(TREE_BITS).alias("_range")).agg(*up, *counts), "copy-ranges")
    up, total = [F.bit_xor(f"{s}{i}").alias(f"{s}{i}") for s in "ab" for i in (1, 2)], [F.sum(f"n{s}").alias(f"n{s}") for s in "ab"]
    differ = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")) | (F.col("na") != F.col("nb"))
    open_ranges: DataFrame | None = None
    for bits in range(0, TREE_BITS + 1, STEP_BITS):
        ranges = leaves.groupBy(F.shiftrightunsigned("_range", TREE_BITS - bits).alias("_range")).agg(*up, *total).where(differ)
        if open_ranges is not None:
            ranges = ranges.join(F.broadcast(open_ranges.select(F.col("_range").alias("_above"))), F.shiftrightunsigned("_range", STEP_BITS) == F.col("_above"), "left_semi")
        open_ranges = ranges.select("_range")
    inside = records.withColumn("_range", number(TREE_BITS)).join(F.broadcast(open_ranges), "_range", "left_semi")
    alike = F.col("a1").eqNullSafe(F.col("b1")) & F.col("a2").eqNullSafe(F.col("b2"))
    return scratch.write(inside.where(~alike).select("_place").distinct(), "copy-differing")


def _renamed(df: DataFrame, names: dict[str, str], version: str, types: dict[str, DataType]) -> DataFrame:
    """Names of our own, so that a column of any name can be compared; a column df lacks is null."""
    there = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*[there.get(c, F.lit(None).cast(types[c])).alias(own) for c, own in names.items()], there[version].alias("v"))


def compare_copies(left: DataFrame, right: DataFrame, spec: CopySpec, missing_left: str = "missing_in_left", missing_right: str = "missing_in_right") -> DataFrame:
    """One row per record that one side lacks and per column whose values differ.

    Result: the keys, field_name ('*' where a whole record is missing) and diff_kind (missing_left,
    missing_right or 'differs'). All columns but keys and version are compared, whatever their names; one
    that only one side has is compared with null. Empty tables give a row per record of the other side.
    """
    types = {f.name: f.dataType for df in (right, left) for f in df.schema}
    keys = [f"k{i}" for i in range(len(spec.keys))]
    compared = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in (*spec.keys, spec.version)]
    columns = {f"c{i}": c for i, c in enumerate(compared)}
    names = dict(zip(spec.keys, keys, strict=True)) | {c: own for own, c in columns.items()}
    own = lambda group: tuple(names[c] for c in group if c in names)
    inner = CopySpec(tuple(keys), "v", own(spec.folded_keys), own(spec.unordered), own(spec.seconds), {names[c]: t for c, t in spec.tolerance.items() if c in names})
    left, right = (_renamed(df, names, spec.version, types) for df in (left, right))
    rows = _side(left, list(columns), inner, 0).unionByName(_side(right, list(columns), inner, 1))
    scratch = Scratch()
    differing = _mismatched(rows.select("_side", "_place", "_h1", "_h2", "_version", *keys), keys, scratch)
    value = F.struct(*columns, F.lit(True).alias("_there"))
    # differing is a table of known size: small, it is broadcast and the rows of other records go no further
    pairs = rows.join(differing, "_place", "left_semi").groupBy("_place", *keys).agg(_latest(value, 0).alias("_a"), _latest(value, 1).alias("_b"))

    def differs(c: str) -> Column:
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        if c in inner.tolerance:
            return ~a.eqNullSafe(b) & F.coalesce(F.abs(a - b) > inner.tolerance[c], F.lit(True))
        return ~a.eqNullSafe(b)

    case = lambda name, kind: F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("diff_kind"))
    found = F.array_compact(F.array(*[F.when(differs(c), case(name, "differs")) for c, name in columns.items()])) if columns else F.array().cast("array<struct<field_name:string,diff_kind:string>>")
    each = F.when(F.col("_a").isNull(), F.array(case("*", missing_left))).when(F.col("_b").isNull(), F.array(case("*", missing_right))).otherwise(found)
    with scratch:
        return materialize(pairs.select(*[F.col(k).alias(c) for c, k in zip(spec.keys, keys, strict=True)], F.inline(each)), "copy-differences")
