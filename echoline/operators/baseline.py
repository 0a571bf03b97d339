"""Accepted groups: building, comparing, filtering and pruning a baseline.

A baseline is a table (fingerprint, lines, path, count), a multiset of accepted occurrences by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.functions.fingerprint import is_baseline_fingerprint

KEYS = ["fingerprint", "path"]


def build(groups: DataFrame, files: DataFrame) -> DataFrame:
    """The baseline that accepts all groups."""
    named = groups.join(files.select("file_id", "path"), "file_id")
    return named.groupBy(F.col("baseline_fingerprint").alias("fingerprint"), F.col("effective_lines").alias("lines"), "path").agg(F.count("*").alias("count"))


def is_project_path(path: Column) -> Column:
    """A path relative to the project: no root, drive, back slash, NUL, empty, '.' or '..' component."""
    parts = F.forall(F.split(path, "/", -1), lambda c: ~c.isin("", ".", ".."))
    return F.coalesce(parts & ~path.rlike(r"^[A-Za-z]:|\\|\x00"), F.lit(False))


def problems(baseline: DataFrame) -> DataFrame:
    """Rows that no baseline may have, with the reason; a valid one gives none."""
    reason = (
        F.when(~is_baseline_fingerprint(F.col("fingerprint")), "invalid fingerprint")
        .when(F.coalesce(F.col("lines"), F.lit(0)) < 1, "no lines")
        .when(~is_project_path(F.col("path")), "invalid path")
        .when(F.coalesce(F.col("count"), F.lit(0)) < 1, "no occurrences")
    )
    rows = baseline.withColumn("reason", reason).where("reason IS NOT NULL").select(*KEYS, "reason")
    twice = baseline.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS, F.lit("duplicate path").alias("reason"))
    several = baseline.groupBy("fingerprint").agg(F.countDistinct("lines").alias("n")).where("n > 1").select("fingerprint", F.lit(None).cast("string").alias("path"), F.lit("duplicate group").alias("reason"))
    return rows.unionByName(twice).unionByName(several)


def compare(current: DataFrame, accepted: DataFrame) -> DataFrame:
    """fingerprint, lines, path and how many occurrences are accepted, active (new) and stale (gone)."""
    a = current.select(*KEYS, F.col("lines").alias("_lines"), F.col("count").alias("_now"))
    b = accepted.select(*KEYS, F.col("lines").alias("_old_lines"), F.col("count").alias("_old"))
    now, old = F.coalesce("_now", F.lit(0)), F.coalesce("_old", F.lit(0))
    return a.join(b, KEYS, "full_outer").select(
        "fingerprint",
        F.coalesce("_lines", "_old_lines").alias("lines"),
        "path",
        F.least(now, old).cast("bigint").alias("accepted"),
        F.greatest(now - old, F.lit(0)).cast("bigint").alias("active"),
        F.greatest(old - now, F.lit(0)).cast("bigint").alias("stale"),
    )


def totals(status: DataFrame) -> DataFrame:
    return status.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("accepted", "active", "stale")])


def active_groups(groups: DataFrame, status: DataFrame) -> DataFrame:
    """All occurrences of the groups that have a new one in some path."""
    new = status.where("active > 0").select(F.col("fingerprint").alias("baseline_fingerprint")).distinct()
    return groups.join(new, "baseline_fingerprint", "left_semi")


def prune(current: DataFrame, accepted: DataFrame) -> DataFrame:
    """The baseline without what is gone: the smaller count of each path, never more than accepted."""
    now = current.select(*KEYS, F.col("count").alias("_now"))
    return accepted.join(now, KEYS).select("fingerprint", "lines", "path", F.least("count", "_now").alias("count")).where("count > 0")


def json_lines(baseline: DataFrame) -> DataFrame:
    """Every accepted group as one JSON document, its paths in order; a fingerprint with several lengths is refused."""
    checked = F.when(F.min("lines") == F.max("lines"), F.min("lines")).otherwise(F.raise_error(F.concat(F.lit("duplicate group "), F.first("fingerprint"))).cast("int"))
    rows = baseline.groupBy("fingerprint").agg(checked.alias("lines"), F.sort_array(F.collect_list(F.struct("path", "count"))).alias("occurrences"))
    return rows.select("fingerprint", F.to_json(F.struct("fingerprint", "lines", "occurrences")).alias("document"))


def by_group(status: DataFrame) -> DataFrame:
    """The sums of each group, and the exit status (1 where any occurrence is active)."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("accepted", "active", "stale")]
    return status.groupBy("fingerprint", "lines").agg(F.count("*").alias("paths"), *sums).withColumn("exit_status", (F.col("active") > 0).cast("int"))
