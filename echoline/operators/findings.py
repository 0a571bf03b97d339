"""Findings and their locations, as flat tables that keep any number of occurrences."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.operators.numbering import numbered

#: Code of every finding (fixed value).
CODE = "DUP001"


def findings(groups: DataFrame) -> DataFrame:
    """One row per group: code, fingerprint, lines, context, scope, occurrences, files, distribution.

    context and scope are those of all lines, or 'mixed'. distribution: same-file, cross-file, or hybrid
    where some file has several occurrences.
    """
    folded = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).when(F.count(c) > 0, F.lit("mixed")).alias(c)
    rows = groups.groupBy("fingerprint", F.col("effective_lines").alias("lines")).agg(
        folded("context"), folded("scope"), F.count("*").alias("occurrences"), F.countDistinct("file_id").alias("files")
    )
    kind = F.when(F.col("files") <= 1, "same-file").when(F.col("occurrences") > F.col("files"), "hybrid").otherwise("cross-file")
    return rows.select(F.lit(CODE).alias("code"), "fingerprint", "lines", "context", "scope", "occurrences", "files", kind.alias("distribution"))


def locations(groups: DataFrame, files: DataFrame) -> DataFrame:
    """fingerprint, path, start_line and end_line (from 1) of every occurrence."""
    return groups.join(files.select("file_id", "path"), "file_id").select("fingerprint", "path", "start_line", "end_line")


def nested(found: DataFrame, places: DataFrame) -> DataFrame:
    """Findings with their locations, in order of path, start and end.

    A row holds all locations of its finding, as a document does; keep to the flat tables where a finding may
    have more than fit in a row.
    """
    columns = [c for c in ("path", "start_line", "end_line", "source") if c in places.columns]
    lists = places.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("locations"))
    return found.join(lists, "fingerprint")


def ordered(found: DataFrame) -> DataFrame:
    """Nested findings with their place in a report: by first path and line, longer ones first, then by all locations."""
    keys = {"_path": F.col("locations")[0]["path"], "_line": F.col("locations")[0]["start_line"], "_less": -F.col("lines"), "_all": F.transform("locations", lambda x: F.struct(x["path"], x["start_line"], x["end_line"]))}
    return numbered(found.withColumns(keys), [*keys, "fingerprint"], "place").drop(*keys)


def json_lines(found: DataFrame) -> DataFrame:
    """Nested findings as JSON documents, one a row."""
    columns = ("code", "fingerprint", "lines", "context", "scope", "occurrences", "files", "distribution", "locations")
    return found.select("fingerprint", F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("document"))


def rendered(found: DataFrame, kind: str) -> DataFrame:
    """Nested findings, each rendered as in a report of that kind: text, markdown or sarif (compact JSON)."""
    from echoline.plans import render

    def one(f: dict) -> str:
        if kind == "text":
            return "\n".join(render.finding_text(f)) + "\n"
        if kind == "markdown":
            return "\n".join(render.finding_markdown(f))
        return json.dumps(render.finding_sarif(f), ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fingerprint": batch["fingerprint"], "document": [one(f | json.loads(more)) for f, more in zip(batch.drop(columns="_at").to_dict("records"), batch["_at"], strict=True)]})

    rows = found.withColumn("_at", F.to_json(F.struct("locations"))).drop("locations")
    return rows.mapInPandas(run, "fingerprint string, document string")


def snippets(found: DataFrame, files: DataFrame) -> DataFrame:
    """Locations with their source: the physical lines of the occurrence."""
    text = F.regexp_replace(F.regexp_replace("source", r"^\x{FEFF}", ""), "\r(?=\n|$)", "")
    part = F.slice(F.split(text, "\n", -1), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return found.join(files.select("path", "source"), "path").withColumn("source", F.array_join(part, "\n"))


def largest(found: DataFrame, top: int = 10) -> DataFrame:
    """The findings of most lines; ties go to the smaller fingerprint."""
    return found.orderBy(F.col("lines").desc(), "fingerprint").limit(top)
