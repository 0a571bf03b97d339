"""Figures over files, lines and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def redundant_lines(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id and nline of every effective line in an occurrence other than its group's first.

    Lines of several groups count once. groups: as from detect, which marks each group's first occurrence.
    """
    spread = groups.where(~F.col("canonical")).select("file_id", F.explode(F.sequence("nstart", F.col("nstart") + F.col("nlen") - 1)).alias("nline")).distinct()
    return spread.join(lines.where("effective").select("file_id", "nline"), ["file_id", "nline"], "left_semi")


def summary(files: DataFrame, lines: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: files, source_lines, analyzed_lines, duplicate_groups, duplicate_lines, duplication_percent.

    files needs source_lines. The first three describe the whole corpus, whatever groups are left.
    """
    whole = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("source_lines"), F.lit(0)).cast("bigint").alias("source_lines"))
    analyzed = lines.agg(F.count_if("effective").alias("analyzed_lines"))
    found = groups.agg(F.countDistinct("fingerprint").alias("duplicate_groups"))
    redundant = redundant_lines(groups, lines).agg(F.count("*").alias("duplicate_lines"))
    percent = F.when(F.col("analyzed_lines") == 0, 0.0).otherwise(F.col("duplicate_lines") / F.col("analyzed_lines") * 100)
    # four tables of one row each
    return whole.crossJoin(analyzed).crossJoin(found).crossJoin(redundant).withColumn("duplication_percent", percent)


def path_counts(groups: DataFrame, files: DataFrame) -> DataFrame:
    """How often each group occurs in each path."""
    return groups.join(files.select("file_id", "path"), "file_id").groupBy("fingerprint", "path").count()


def class_counts(findings: DataFrame) -> DataFrame:
    """Findings by distribution, by context and by scope, each in a row of its own kind."""
    kinds = ["distribution", "context", "scope"]
    rows = findings.groupingSets([[k] for k in kinds], *kinds).agg(F.count("*").alias("findings"), *[F.grouping(k).alias(f"_{k}") for k in kinds])
    kind = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in kinds])
    value = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.col(k)) for k in kinds])
    return rows.select(kind.alias("kind"), value.alias("value"), "findings")


def length_buckets(findings: DataFrame) -> DataFrame:
    """Shortest and longest finding, and how many have 4 to 9, 10 to 19, and 20 or more lines."""
    between = lambda low, high: F.count_if(F.col("lines").between(low, high))
    return findings.agg(
        F.min("lines").alias("shortest"), F.max("lines").alias("longest"),
        between(4, 9).alias("lines_4_9"), between(10, 19).alias("lines_10_19"), F.count_if(F.col("lines") >= 20).alias("lines_20_up"),
    )


def touching(locations: DataFrame, part: str, suffix: bool = False, every: str | None = None) -> DataFrame:
    """Each fingerprint and whether one of its locations' paths contains (or ends with) part; with `every`, also whether all contain that."""
    hit = F.col("path").endswith(part) if suffix else F.col("path").contains(part)
    more = [F.min(F.col("path").contains(every)).alias("within")] if every else []
    return locations.groupBy("fingerprint").agg(F.max(hit).alias("touches"), *more)


def invalid_groups(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """fingerprint and reason of every rule that a group breaks; detected groups give none.

    Rules: at least two occurrences, none twice, all of one length, in files that are there, within their lines.
    """
    sizes = lines.groupBy("file_id").agg((F.max("nline") + 1).alias("_lines"))
    at = groups.join(sizes, "file_id", "left")
    inside = (F.col("nstart") >= 0) & (F.col("nlen") > 0) & (F.col("nstart") + F.col("nlen") <= F.col("_lines"))
    each = at.groupBy("fingerprint", "file_id", "nstart", "nlen").agg(F.count("*").alias("n"), F.max(F.col("_lines").isNull()).alias("unknown"), F.min(F.coalesce(inside, F.lit(True))).alias("inside"))
    per = each.groupBy("fingerprint").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.min("nlen").alias("low"), F.max("nlen").alias("high"), F.max("unknown").alias("unknown"), F.min("inside").alias("inside"))
    rules = {"too few occurrences": F.col("all") < 2, "duplicate occurrence": F.col("most") > 1, "different lengths": F.col("low") < F.col("high"), "unknown file": F.col("unknown"), "out of range": ~F.col("inside")}
    return per.select("fingerprint", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))).alias("reason"))
