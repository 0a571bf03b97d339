"""Detection after each batch of a stream."""

from echoline.streaming.rescan import rescan

SCHEMA = "file_id bigint, nline int, segment_id int, text string, effective boolean"


def test_groups_follow_the_lines(spark, tmp_path):
    source, seen = str(tmp_path / "in"), {}

    def feed(files):
        rows = [(f, n, 0, t, True) for f in files for n, t in enumerate("abcd")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema(SCHEMA).parquet(source)
        query = rescan(lines, str(tmp_path / "table"), str(tmp_path / "state"), lambda groups, n: seen.update({n: groups.count()}))
        query.awaitTermination(120)

    feed([1])
    feed([2, 1])
    feed([3])
    assert seen == {0: 0, 1: 2, 2: 3}
