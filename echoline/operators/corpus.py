"""The corpus as tables: files in path order, line dictionary, token stream, suffix order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.operators.numbering import numbered


def path_key(path: Column | str) -> Column:
    """Paths compare by their components: a/b comes before a.b."""
    return F.split(path, "/", -1)


def duplicate_paths(files: DataFrame) -> DataFrame:
    """Paths that stand more than once; a corpus must have none."""
    return files.groupBy("path").count().where("count > 1").select("path")


def ordered_files(files: DataFrame) -> DataFrame:
    """files with file_id: their place in path order."""
    return numbered(files.withColumn("_key", path_key("path")), ["_key"], "file_id").drop("_key")


def invalid_segments(lines: DataFrame) -> DataFrame:
    """Files whose lines are not dense from 0, or whose segments are not runs of lines."""
    per = lines.groupBy("file_id", "segment_id").agg(F.min("nline").alias("low"), F.max("nline").alias("high"), F.count("*").alias("n"))
    odd = per.where(F.col("high") - F.col("low") + 1 != F.col("n")).select("file_id")
    whole = lines.groupBy("file_id").agg(F.min("nline").alias("low"), F.max("nline").alias("high"), F.count("*").alias("n"))
    return odd.unionByName(whole.where((F.col("low") != 0) | (F.col("high") + 1 != F.col("n"))).select("file_id")).distinct()


def line_dictionary(lines: DataFrame) -> DataFrame:
    """text and line_id of each distinct line, numbered by first appearance in the corpus."""
    first = lines.groupBy("text").agg(F.min(F.struct("file_id", "nline")).alias("_first"))
    return numbered(first, ["_first"], "line_id").select("text", "line_id")


def tokens(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The token stream: pos, token, file_id, nline and segment_id; a unique sentinel ends each segment.

    A sentinel's file_id and nline are null. Its token follows the dictionary's, in segment order.
    """
    n = dictionary.count()
    read = lines.join(dictionary, "text").select("file_id", "segment_id", "nline", F.col("line_id").alias("token"), F.lit(False).alias("is_sentinel"))
    ends = lines.groupBy("file_id", "segment_id").agg((F.max("nline") + 1).alias("nline"))
    ends = numbered(ends, ["file_id", "segment_id"], "_k").select("file_id", "segment_id", "nline", (F.col("_k") + n).alias("token"), F.lit(True).alias("is_sentinel"))
    placed = numbered(read.unionByName(ends), ["file_id", "segment_id", "nline"], "pos")
    real = lambda c: F.when(~F.col("is_sentinel"), F.col(c)).alias(c)
    return placed.select("pos", "token", real("file_id"), real("nline"), real("segment_id"), "is_sentinel")


def suffixes(stream: DataFrame) -> DataFrame:
    """pos, suffix rank and common prefix with the suffix before, of every position.

    A suffix is cut behind its segment's sentinel, which is unique, so the order is that of the whole
    stream. Detection doesn't need this order; it is here for comparison on corpora of short segments.
    """
    spans = stream.where("is_sentinel").select(F.col("pos").alias("_end"))
    spans = numbered(spans, ["_end"], "_span")
    starts = spans.select((F.col("_span") + 1).alias("_span"), (F.col("_end") + 1).alias("_begin"))
    bounds = spans.join(starts, "_span", "left").select("_span", F.coalesce("_begin", F.lit(0)).alias("_begin"), "_end")
    whole = bounds.withColumn("pos", F.explode(F.sequence("_begin", "_end"))).join(stream.select("pos", "token"), "pos")
    rows = whole.groupBy("_span", "_begin").agg(F.sort_array(F.collect_list(F.struct("pos", "token")))["token"].alias("_all"))
    each = rows.select("_begin", F.posexplode("_all").alias("_k", "_t"), "_all")
    cut = each.select((F.col("_begin") + F.col("_k")).alias("pos"), F.slice("_all", F.col("_k") + 1, F.size("_all")).alias("suffix"))
    ranked = numbered(cut, ["suffix"], "rank")
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("suffix").alias("_before"))
    differ = F.array_position(F.zip_with("suffix", "_before", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    lcp = F.when(F.col("_before").isNull(), 0).when(differ > 0, differ - 1).otherwise(F.least(F.size("suffix"), F.size("_before")))
    return ranked.join(before, "rank", "left").select("pos", "rank", F.coalesce(lcp, F.lit(0)).cast("bigint").alias("lcp"))
