"""Duplicates hidden by formatting: a ledger of canonical keys, stored by bucket, updated batch by batch.

A key's bucket follows from the key. The ledger is a folder with one part per update and bucket, and a
manifest that names the part each bucket is in. An update aggregates its batch, reads the parts of the
batch's buckets only, joins, and writes new parts for these; then one small manifest, put in place by a
rename, makes them valid. Other buckets are neither read nor written, and an update that is lost half-way
leaves the ledger as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.session import spread

#: Names of the options that belong to a record's identity (fixed values).
OPTIONS = ("ignore_comments", "ignore_docstrings", "ignore_imports", "ignore_signatures")

LEDGER_SCHEMA = "bucket int, key string, copies bigint, first_id bigint"


def canonical_text(text: Column) -> Column:
    """Letters, digits and underscores of text in lower case; null where none is left."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")
    return F.when(kept != "", kept)


def canonical_options(json: Column) -> Column:
    """One character per option, in fixed order: '0' where the JSON object sets it to false, else '1'.

    Names differ at will in case and in hyphen or underscore; what is not named, null, or named in
    text that is no JSON object counts as true. If one option is named twice, the last one holds.
    """
    read = F.from_json(json, "map<string,string>")
    names = F.transform(F.map_keys(read), lambda k: F.translate(F.lower(k), "-", "_"))
    return F.concat(*[
        F.when(F.lower(F.try_element_at(F.map_values(read), (F.array_size(names) - F.array_position(F.reverse(names), o) + 1).cast("int"))) == "false", "0").otherwise("1")
        for o in OPTIONS
    ])


def keyed(records: DataFrame, id_column: str, text_column: str, options_column: str | None, buckets: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Columns bucket, key and id, and those of `keep`, of every record that has a key.

    The key is a SHA-256 digest of the canonical form, so that texts of any length weigh 64
    characters in a shuffle. Records without a letter, digit or underscore, and null texts, have none.
    """
    options = F.col(options_column) if options_column else F.lit(None).cast("string")
    rows = spread(records.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("_text"), options.alias("_options"), *(keep or [])))
    named = canonical_options(F.col("_options")) if options_column else F.lit("")
    return (
        rows.select("id", F.sha2(F.concat(named, F.lit(":"), canonical_text(F.col("_text"))), 256).alias("key"), *(keep or []))
        .where("key IS NOT NULL")
        .select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "id", *(keep or []))
    )


def updated(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a ledger's buckets after one more batch of keyed records.

    The batch is aggregated first, map-side and then by key, so a key that a third of all rows hold reaches
    the shuffle once per task. Counts are added, and of both representatives the earliest (smallest id)
    stays. Feeding the same records in any split and order gives the same ledger.
    """
    fresh = batch.groupBy("bucket", "key").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    a, b = held.alias("a"), fresh.alias("b")
    return a.join(b, ["bucket", "key"], "full_outer").select(
        "bucket",
        "key",
        (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).cast("bigint").alias("copies"),
        F.least("a.first_id", "b.first_id").alias("first_id"),
    )


class Ledger:
    """A ledger in a folder that all executors reach; opened again, it is as it was left.

    One writer at a time. Batches must be keyed with the same number of buckets, which is at most MOST_BUCKETS,
    so that the manifest stays a small file however many keys there are.
    """

    MOST_BUCKETS = 100_000

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.version, self.parts = self._manifest()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """The latest version and, for each bucket that has keys, its part."""
        root = self._path("")
        fs = root.getFileSystem(self.conf)
        if not fs.exists(root):
            return 0, {}
        versions = [int(name[9:]) for s in fs.listStatus(root) if (name := s.getPath().getName()).startswith("manifest-") and name[9:].isdigit()]
        if not versions:
            return 0, {}
        stream = fs.open(self._path(f"manifest-{max(versions)}"))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return max(versions), {int(k): v for k, v in json.loads(text).items()}

    def load(self, buckets: list[int] | None = None) -> DataFrame:
        """The ledger, or only the given buckets of it: just their files are listed and read."""
        paths = [f"{self.folder}/{part}/folder={b}" for b, part in sorted(self.parts.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*paths)

    def update(self, batch: DataFrame) -> list[int]:
        """Adds keyed records; returns the buckets that were read and replaced."""
        buckets = sorted(r["bucket"] for r in batch.select("bucket").distinct().limit(self.MOST_BUCKETS + 1).collect())
        if len(buckets) > self.MOST_BUCKETS:
            raise ValueError(f"more than {self.MOST_BUCKETS} buckets")
        if not buckets:
            return []
        version = self.version + 1
        part = f"part-{version}"
        # the bucket's number is a column of its files as well, since each folder is read by itself
        rows = updated(self.load(buckets), batch).withColumn("folder", F.col("bucket"))
        rows.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.folder}/{part}")
        self._commit(version, self.parts | dict.fromkeys(buckets, part))
        return buckets

    def _commit(self, version: int, parts: dict[int, str]) -> None:
        new = self._path(f"manifest-{version}.new")
        fs = new.getFileSystem(self.conf)
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        if not fs.rename(new, self._path(f"manifest-{version}")):
            raise RuntimeError(f"version {version} of the ledger is there already; it has another writer")
        self.version, self.parts = version, parts


def copies_of(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each record that is a copy of an earlier one: first_id and copy_id.

    Only keys with several copies are joined, each with one ledger row, so the result is linear in
    the records. A partition of a hot key is split by adaptive execution, as only the record side of
    this inner join is large. A record whose id repeats its representative's is no other copy.
    """
    several = ledger.where("copies > 1").select("bucket", "key", "first_id")
    return (
        records.join(several, ["bucket", "key"])
        .where(F.col("id") != F.col("first_id"))
        .select("first_id", F.col("id").alias("copy_id"))
    )
