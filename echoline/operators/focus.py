"""Choosing groups by path, replacing sources, and excluding paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """path and each folder above it."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def matched(files: DataFrame, selectors: DataFrame) -> DataFrame:
    """file_id and selector of every file a selector names: an equality join on the folders of its path."""
    named = selectors.select(F.regexp_replace("selector", "/+$", "").alias("selector")).distinct()
    return files.select("file_id", F.explode(ancestors(F.col("path"))).alias("selector")).join(named, "selector")


def unmatched(files: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors that name no source; a scan refuses them."""
    named = selectors.select(F.regexp_replace("selector", "/+$", "").alias("selector")).distinct()
    return named.join(matched(files, selectors).select("selector").distinct(), "selector", "left_anti")


def focused(groups: DataFrame, files: DataFrame, selectors: DataFrame) -> DataFrame:
    """All occurrences of the groups that have one in a selected file."""
    chosen = groups.join(matched(files, selectors).select("file_id").distinct(), "file_id", "left_semi")
    return groups.join(chosen.select("fingerprint").distinct(), "fingerprint", "left_semi")


def overlay(files: DataFrame, virtual: DataFrame) -> DataFrame:
    """files, where a virtual source replaces the one of its path or is added."""
    return files.join(virtual.select("path"), "path", "left_anti").unionByName(virtual)
