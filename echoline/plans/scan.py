"""Queries of the block scanner on the prepared files and lines, and on texts as corpora."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.operators import baseline, corpus, detect, findings, focus, metrics, textprep
from echoline.session import materialize, table
from echoline.sources import discovery, patterns, python_frontend, settings

FOCUS = ("amber-flint/src", "brisk-grove")
NO_FOCUS = ("amber-flint/nowhere/", "brisk-grove/src/none.py", "amber")
EXCLUDE = ("build/**", "docs/conf.py", "third_party/", ".venv/", "**/_vendor/**", "*_wire.py", "src/gen/", "!src/gen/keep.py", "lib/**/tables/", "*.min.js", "tests/unit/*/[a-m]*.py")


def files_of(spark: SparkSession, directory: str) -> DataFrame:
    path = F.concat(F.coalesce("project", F.lit("unknown")), F.lit("/"), "path")
    return table(spark, directory, "prepared_files").select("file_id", path.alias("path"), "source", "source_lines")


def delivered_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The prepared lines; late deliveries repeat rows, of which detection takes one."""
    return table(spark, directory, "prepared_lines").select("file_id", "nline", "segment_id", "source_line", "text", "effective", "context", "scope")


def lines_of(spark: SparkSession, directory: str) -> DataFrame:
    """The prepared lines, each once."""
    return delivered_lines(spark, directory).dropDuplicates(["file_id", "nline"])


def texts_of(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as files."""
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return table(spark, directory, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("source"))


def groups_of(spark: SparkSession, directory: str, min_lines: int = 4, same_file: bool = True) -> DataFrame:
    return detect.detect(delivered_lines(spark, directory), min_lines, same_file)


def _shape(groups: DataFrame) -> DataFrame:
    return groups.groupBy("fingerprint", F.col("effective_lines").alias("lines"), "nlen").agg(F.count("*").alias("occurrences"), F.countDistinct("file_id").alias("files"))


def source_line_counts(spark: SparkSession, d: str) -> DataFrame:
    texts = texts_of(spark, d).where("source IS NOT NULL")
    return texts.select("file_id", textprep.line_count(F.col("source")).cast("bigint").alias("source_lines"))


def physical_lines(spark: SparkSession, d: str) -> DataFrame:
    return textprep.physical_lines(texts_of(spark, d))


def normalized_lines(spark: SparkSession, d: str) -> DataFrame:
    return textprep.normalized_lines(texts_of(spark, d))


def effective_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).groupBy("file_id").agg(F.count("*").alias("lines"), F.count_if("effective").alias("effective_lines"))


def file_order(spark: SparkSession, d: str) -> DataFrame:
    paths = files_of(spark, d).select("path").distinct()
    return corpus.ordered_files(paths)


def duplicate_paths(spark: SparkSession, d: str) -> DataFrame:
    """File names that a corpus of all prepared files in one folder would hold twice."""
    return corpus.duplicate_paths(files_of(spark, d).select(F.regexp_extract("path", "[^/]+$", 0).alias("path")))


def invalid_segments(spark: SparkSession, d: str) -> DataFrame:
    """Files whose lines are no corpus any more once those without content are taken out."""
    return corpus.invalid_segments(lines_of(spark, d).where("effective"))


def line_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.line_dictionary(lines_of(spark, d))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return corpus.tokens(lines, materialize(corpus.line_dictionary(lines), "dictionary"))


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)


def suffix_order(spark: SparkSession, d: str) -> DataFrame:
    return corpus.suffixes(materialize(_tokens(spark, d), "tokens"))


def repeated_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every position whose four lines stand elsewhere as well, and whether a block may begin or end there."""
    files = materialize(detect.corpus_files(delivered_lines(spark, d)), "query-files")
    seeded = detect.seeds(files, 4)
    found = seeded.join(materialize(detect.repeated_seeds(seeded), "query-seeds"), ["s1", "s2"])
    return found.join(files.select("file_id", "first"), "file_id").select("file_id", (F.col("first") + F.col("pos")).alias("nline"), "starts", "ends")


def candidate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _shape(detect.candidates(delivered_lines(spark, d)))


def contained_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups that lie wholly inside a longer one, where every group of five lines or more also stands without its
    first and last line, once with all occurrences (-inner) and once with one more elsewhere (-more)."""
    groups = materialize(groups_of(spark, d).select("fingerprint", "size", "file_id", "nstart", "nlen", "canonical"), "query-groups")
    long = groups.where("nlen >= 5").withColumns({"nstart": F.col("nstart") + 1, "nlen": F.col("nlen") - 2})
    inner = long.withColumn("fingerprint", F.concat("fingerprint", F.lit("-inner")))
    away = long.where("canonical").withColumn("nstart", F.col("nstart") + 1_000_000)
    more = long.unionByName(away).withColumns({"fingerprint": F.concat("fingerprint", F.lit("-more")), "size": F.col("size") + 1})
    return detect.contained(groups.unionByName(inner).unionByName(more))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return _shape(groups_of(spark, d))


def duplicate_groups_min2(spark: SparkSession, d: str) -> DataFrame:
    return _shape(groups_of(spark, d, min_lines=2))


def duplicate_groups_cross_file(spark: SparkSession, d: str) -> DataFrame:
    return _shape(groups_of(spark, d, same_file=False))


def duplicate_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return groups_of(spark, d).select("fingerprint", "file_id", "nstart", "nlen")


def text_groups(spark: SparkSession, d: str) -> DataFrame:
    """Repeated blocks of documents, whose lines are taken as they are."""
    return _shape(detect.detect(textprep.normalized_lines(texts_of(spark, d))))


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    return findings.findings(groups_of(spark, d))


def finding_locations(spark: SparkSession, d: str) -> DataFrame:
    return findings.locations(groups_of(spark, d), files_of(spark, d))


def ten_largest(spark: SparkSession, d: str) -> DataFrame:
    return findings.largest(findings.findings(groups_of(spark, d))).select("fingerprint", "lines", "occurrences")


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_counts(findings.findings(groups_of(spark, d)))


def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.length_buckets(findings.findings(groups_of(spark, d)))


def groups_touching_path(spark: SparkSession, d: str) -> DataFrame:
    return metrics.touching(findings.locations(groups_of(spark, d), files_of(spark, d)), "/tests/")


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(files_of(spark, d), lines_of(spark, d), materialize(groups_of(spark, d), "query-groups"))


def redundant_lines(spark: SparkSession, d: str) -> DataFrame:
    return metrics.redundant_lines(groups_of(spark, d), lines_of(spark, d))


def path_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.path_counts(groups_of(spark, d), files_of(spark, d))


def _baselines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups now, their baseline, and one accepted by a scan with min_lines 3 for blocks of several files."""
    files, now = files_of(spark, d), groups_of(spark, d)
    return now, baseline.build(now, files), baseline.build(groups_of(spark, d, min_lines=3, same_file=False), files)


def baseline_build(spark: SparkSession, d: str) -> DataFrame:
    return baseline.build(groups_of(spark, d), files_of(spark, d))


def baseline_status(spark: SparkSession, d: str) -> DataFrame:
    _, now, old = _baselines(spark, d)
    return baseline.compare(now, old)


def baseline_totals(spark: SparkSession, d: str) -> DataFrame:
    return baseline.totals(baseline_status(spark, d))


def baseline_active_groups(spark: SparkSession, d: str) -> DataFrame:
    groups, now, old = _baselines(spark, d)
    return baseline.active_groups(groups, baseline.compare(now, old)).select("fingerprint", "file_id", "nstart")


def baseline_prune(spark: SparkSession, d: str) -> DataFrame:
    _, now, old = _baselines(spark, d)
    return baseline.prune(now, old)


def baseline_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a baseline that is broken in a way told by the first digit of each fingerprint."""
    rows = baseline_build(spark, d)
    digit = F.substr("fingerprint", F.lit(8), F.lit(1))
    broken = rows.select(
        F.when(digit == "0", F.upper("fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(digit == "1", 0).when((digit == "5") & (F.length("path") % 2 == 0), F.col("lines") + 1).otherwise(F.col("lines")).alias("lines"),
        F.when(digit == "2", F.concat(F.lit("/"), "path")).when(digit == "6", F.concat("path", F.lit("/../x"))).otherwise(F.col("path")).alias("path"),
        F.when(digit == "3", 0).otherwise(F.col("count")).alias("count"),
    )
    return baseline.problems(broken.unionByName(broken.where(F.substr("fingerprint", F.lit(8), F.lit(1)) == "4")))


def focused_groups(spark: SparkSession, d: str) -> DataFrame:
    selectors = spark.createDataFrame([(s,) for s in FOCUS], "selector string")
    return focus.focused(groups_of(spark, d), files_of(spark, d), selectors).select("fingerprint", "file_id", "nstart")


def virtual_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Documents over prepared files: one path that is replaced for each of the first's paths, the rest added."""
    files = files_of(spark, d).select("path", F.lit("disk").alias("origin")).distinct()
    raw = table(spark, d, "source_files").select(F.concat(F.coalesce("project", F.lit("unknown")), F.lit("/"), "path").alias("path"), F.lit("virtual").alias("origin")).distinct()
    return focus.overlay(files, raw)


def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    """Python files that patterns of all kinds leave over."""
    files = table(spark, d, "source_files").select("file_id", "path")
    return files.where(patterns.is_python_path(F.col("path")) & ~patterns.is_excluded(F.col("path"), list(EXCLUDE)))


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    names = list(python_frontend.NormalizationOptions.__dataclass_fields__)
    read = F.from_json(F.lower(F.translate("option_json", "-", "_")), "struct<" + ", ".join(f"{n}: boolean" for n in names) + ">")
    files = table(spark, d, "prepared_files").select("file_id", "path", "source", read.alias("o"))
    return python_frontend.prepared(files.select("file_id", "path", "source", *[F.coalesce(f"o.{n}", F.lit(True)).alias(n) for n in names]), option_columns=True)


def python_lines(spark: SparkSession, d: str) -> DataFrame:
    """Normalized lines of every prepared file: made anew where its source parses, as delivered where it doesn't."""
    done = materialize(_prepared(spark, d), "query-prepared")
    columns = ["file_id", "nline", "source_line", "text", "effective"]
    delivered = lines_of(spark, d).join(done.where("error IS NOT NULL").select("file_id"), "file_id", "left_semi")
    return python_frontend.prepared_lines(done).select(columns).unionByName(delivered.select(columns))


def keep_going_errors(spark: SparkSession, d: str) -> DataFrame:
    """Prepared files that have no normalized text by either way: their source doesn't parse, and none was delivered."""
    missing = table(spark, d, "prepared_files").where("normalized IS NULL").select("file_id")
    return python_frontend.preparation_errors(_prepared(spark, d)).join(missing, "file_id", "left_semi").select("file_id", "path", "kind")


def directive_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents in which each paragraph's end turns comparison off and each list item turns it on again."""
    off, on = "# echoline: disable", "# echoline: enable"
    text = F.replace(F.replace("source", F.lit("\n- "), F.lit(f"\n{on}\n- ")), F.lit("\n\n"), F.lit(f"\n{off}\n"))
    return textprep.normalized_lines(texts_of(spark, d).withColumn("source", text), directive="echoline")


def project_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each project: its own values before the defaults, paths from its root."""
    return settings.resolved(table(spark, d, "scan_settings").withColumnRenamed("exclude_patterns", "exclude"))


def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Python files of each project, in a table of all its files, that its settings leave over."""
    listing = table(spark, d, "source_files").select("file_id", "project", "path")
    return discovery.discovered(listing, project_settings(spark, d)).select("project", "path").distinct()


def undiscovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that are there less those a scan would find."""
    return table(spark, d, "source_files").select("project", "path").subtract(discovered_files(spark, d))


def unmatched_selectors(spark: SparkSession, d: str) -> DataFrame:
    chosen = spark.createDataFrame([(s,) for s in (*FOCUS, *NO_FOCUS)], "selector string")
    return focus.unmatched(files_of(spark, d), chosen)


def groups_within_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether one of a group's paths ends in .pyi, and whether all of them lie below src."""
    places = findings.locations(groups_of(spark, d), files_of(spark, d))
    return metrics.touching(places, ".pyi", suffix=True, every="/src/")


def invalid_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rules that groups break which were damaged in a way told by the last digit of the fingerprint."""
    groups = groups_of(spark, d).select("fingerprint", "file_id", "nstart", "nlen")
    digit = F.right("fingerprint", F.lit(1))
    damaged = groups.select(
        "fingerprint",
        F.when(digit == "0", F.col("file_id") + 1_000_000_000).otherwise(F.col("file_id")).alias("file_id"),
        F.when(digit == "1", F.col("nstart") + 1_000_000).otherwise(F.col("nstart")).alias("nstart"),
        F.when((digit == "2") & (F.col("file_id") % 2 == 0), F.col("nlen") + 1).otherwise(F.col("nlen")).alias("nlen"),
    )
    return metrics.invalid_groups(damaged.unionByName(damaged.where(digit == "3")), lines_of(spark, d))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    groups = materialize(groups_of(spark, d), "query-groups")
    return findings.nested(findings.findings(groups), findings.locations(groups, files_of(spark, d)))


def finding_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each finding in a report, from 0."""
    return findings.ordered(_nested(spark, d)).select("fingerprint", "place")


def finding_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The source lines of every occurrence."""
    return findings.snippets(findings.locations(groups_of(spark, d), files_of(spark, d)), files_of(spark, d))


def report_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every finding as one JSON document: a report of any size, written by all tasks."""
    return findings.json_lines(_nested(spark, d))


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """Every finding as the lines of a text report."""
    return findings.rendered(_nested(spark, d), "text")


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    return findings.rendered(_nested(spark, d), "markdown")


def report_sarif(spark: SparkSession, d: str) -> DataFrame:
    """Every finding as a SARIF result."""
    return findings.rendered(_nested(spark, d), "sarif")


def baseline_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every accepted group as one JSON document, its paths in order."""
    return baseline.json_lines(baseline_build(spark, d))


def baseline_status_groups(spark: SparkSession, d: str) -> DataFrame:
    """Accepted, active and stale occurrences of each group, and the exit status that its active ones ask for."""
    return baseline.by_group(baseline_status(spark, d))


@cache
def names() -> tuple[str, ...]:
    """Queries of this module, in the order of a scan."""
    own = [k for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]
    return tuple(k for k in own if k not in ("files_of", "delivered_lines", "lines_of", "texts_of", "groups_of", "names"))
