"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.llm import foreign_source, format_duplicates, packing, shared_spans, subjects, tokenizing
from echoline.session import fresh_path, materialize, table


#: For tables of this size; one bucket should hold some hundred thousand keys.
LEDGER_BUCKETS = 8


def _copies(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the prepared files and their ledger; files that were loaded late come as a second batch.

    The ledger is stored after each batch, and opened again for the next one.
    """
    files = table(spark, directory, "prepared_files")
    late = F.coalesce(F.col("loaded_at") > F.col("prepared_at") + F.expr("INTERVAL 2 DAYS"), F.lit(True))
    keys = materialize(format_duplicates.keyed(files.withColumn("_late", late), "file_id", "normalized", "option_json", buckets=LEDGER_BUCKETS, keep=["_late"]), "copy-keys")
    folder = fresh_path(spark, "ledger")
    for which in (~F.col("_late"), F.col("_late")):
        format_duplicates.Ledger(spark, folder).update(keys.where(which).drop("_late"))
    return keys.drop("_late"), format_duplicates.Ledger(spark, folder).load()


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Copies among the prepared files."""
    return format_duplicates.copies_of(*_copies(spark, directory))


def p3_copies(spark: SparkSession, directory: str) -> DataFrame:
    """Each record once, by its first_id, with how many files say the same (itself included); files without a key have no row."""
    return _copies(spark, directory)[1].select("first_id", "copies")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    files = table(spark, directory, "prepared_files")
    return shared_spans.shared_spans(files, "file_id", "normalized", min_lines=8).withColumnRenamed("id", "file_id")


def p4_shares(spark: SparkSession, directory: str) -> DataFrame:
    """How much of each prepared file is shared: file_id, n_lines, shared_lines and share; files without a normalized text have no lines and no row."""
    files = table(spark, directory, "prepared_files")
    spans = shared_spans.shared_spans(files, "file_id", "normalized", min_lines=8)
    return shared_spans.shared_shares(files, spans, "file_id", "normalized").withColumnRenamed("id", "file_id")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A file of the public tokenizers' folder, which the environment may name."""
    return os.path.join(os.environ.get("ECHOLINE_TOKENIZERS", "/opt/tokenizers"), name)


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokenizing.encode(table(spark, directory, "documents"), "doc_id", "text", tokenizer_file()).withColumnRenamed("id", "doc_id")


def _sizes(spark: SparkSession, directory: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    counts = tokenizing.token_counts(table(spark, directory, "documents"), "doc_id", "text", tokenizer_file())
    return counts, [(r["pack_class"], r["capacity"]) for r in table(spark, directory, "pack_sizes").collect()]


def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    """One packing of all documents into containers of all classes, chosen jointly."""
    return packing.pack(*_sizes(spark, directory)).withColumnRenamed("id", "doc_id")


def p7_by_class(spark: SparkSession, directory: str) -> DataFrame:
    """A packing of all documents for each class, into containers of that class alone."""
    counts, classes = _sizes(spark, directory)
    counts = materialize(counts, "pack-sizes")
    return reduce(DataFrame.unionByName, [packing.pack(counts, [c]) for c in classes]).withColumnRenamed("id", "doc_id")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    kinds = foreign_source.classify(table(spark, directory, "source_files"), table(spark, directory, "packages"))
    return kinds.withColumnRenamed("id", "file_id")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    found = subjects.subjects_of(table(spark, directory, "documents"), table(spark, directory, "subject_labels"), table(spark, directory, "subject_areas"))
    return found.select(F.col("id").alias("doc_id"), "subject")
