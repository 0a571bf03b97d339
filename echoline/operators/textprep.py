"""Physical and normalized lines of plain texts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.functions.text import strip_blank


def without_mark(source: Column) -> Column:
    """source without one leading byte order mark."""
    return F.regexp_replace(source, r"^\x{FEFF}", "")


def line_count(source: Column) -> Column:
    """Physical lines: a last line feed ends a line and begins none."""
    ended = (source == "") | source.endswith("\n")
    return F.size(F.split(source, "\n", -1)) - F.when(ended, 1).otherwise(0)


def is_effective(text: Column) -> Column:
    """Whether a line holds a letter, a digit or an underscore."""
    return text.rlike(r"[\p{IsAlphabetic}\p{N}_]")


def physical_lines(files: DataFrame) -> DataFrame:
    """file_id, source_line (from 0) and content of every line, without its line end."""
    split = files.where("source IS NOT NULL").select("file_id", F.posexplode(F.split(without_mark(F.col("source")), "\n", -1)).alias("source_line", "content"))
    return split.withColumn("content", F.regexp_replace("content", "\r$", ""))


def normalized_lines(files: DataFrame, directive: str | None = None) -> DataFrame:
    """Lines left after trimming and dropping empty ones: file_id, nline, segment_id, source_line, text, effective.

    directive: where lines may consist of '# <directive>: disable' or '...: enable'. Such lines are
    dropped, lines between them are suppressed, and every disable that takes effect ends a segment.
    """
    lines = physical_lines(files).withColumn("text", strip_blank(F.col("content"))).drop("content")
    if directive:
        order = Window.partitionBy("file_id").orderBy("source_line")
        event = F.regexp_extract("text", rf"^#\s*{directive}: (disable|enable)$", 1)
        lines = lines.withColumn("_event", F.when(event != "", event))
        state = F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        lines = lines.withColumn("_off", F.coalesce(state == "disable", F.lit(False)))
        barrier = ((F.col("_event") == "disable") & ~F.col("_off")).cast("int")
        lines = lines.withColumn("_segment", F.coalesce(F.sum(barrier).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        lines = lines.where(F.col("_event").isNull() & ~F.col("_off"))
    else:
        lines = lines.withColumn("_segment", F.lit(0))
    kept = lines.where("text <> ''")
    order = Window.partitionBy("file_id").orderBy("source_line")
    dense = F.dense_rank().over(Window.partitionBy("file_id").orderBy("_segment")) - 1
    return kept.select(
        "file_id", (F.row_number().over(order) - 1).alias("nline"), dense.cast("int").alias("segment_id"), "source_line", "text", is_effective(F.col("text")).alias("effective")
    )
