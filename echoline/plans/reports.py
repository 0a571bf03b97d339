"""Queries on the tables of scan reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoline.operators.copy_diff import CopySpec, compare_copies
from echoline.operators.schema_drift import consistent_table, drift, union_schema, union_types
from echoline.session import table

REPORT_COPIES = CopySpec(
    keys=("project", "run_no"),
    folded_keys=("project",),
    version="loaded_at",
    unordered=("findings",),
    seconds=("produced_at",),
    tolerance={"duplication_percent": 0.000001},
)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return compare_copies(
        table(spark, directory, "reports"),
        table(spark, directory, "reports_mirror"),
        REPORT_COPIES,
        missing_left="missing_in_reports",
        missing_right="missing_in_mirror",
    )


def _drift(spark: SparkSession, directory: str):
    files = table(spark, directory, "report_files")
    types = {r["field_path"]: r["value_type"] for r in table(spark, directory, "report_fields").collect()}
    return files, types, drift(files, list(types))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return _drift(spark, directory)[2][0]


def p1_types(spark: SparkSession, directory: str) -> DataFrame:
    """Every field of the delivered reports with its types and their promotion."""
    _, _, (_, signed, names) = _drift(spark, directory)
    return union_types(signed, names)


def p1_union(spark: SparkSession, directory: str) -> DataFrame:
    """All delivered reports as one table, cast to the union schema: every field has the type its values in all files promote to."""
    files, types, (_, _, names) = _drift(spark, directory)
    return consistent_table(files, names, union_schema(files, names, types))


def p1_table(spark: SparkSession, directory: str) -> DataFrame:
    """All delivered reports as one table with the fields and types of report_fields; what these can't hold stands beside them."""
    files, types, (_, _, names) = _drift(spark, directory)
    return consistent_table(files, names, types)
