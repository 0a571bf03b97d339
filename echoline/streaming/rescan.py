"""Detection over a growing corpus.

New lines may split or join groups, so findings have no append-only form: each micro-batch of lines is
added to a table, and the groups of the whole table are found again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from echoline.operators.detect import detect


def rescan(lines: DataFrame, table_path: str, state_path: str, on_groups: Callable[[DataFrame, int], None], min_lines: int = 4, same_file: bool = True) -> StreamingQuery:
    """Start a query that stores streamed lines below table_path and calls on_groups(groups, batch) after each batch.

    A batch that is run again after a failure replaces its own part, and of a line that was delivered
    several times one counts, so groups are those of the lines seen, each once.
    """
    schema = lines.schema

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        whole = batch.sparkSession.read.schema(schema).parquet(table_path).select(*schema.names)
        on_groups(detect(whole.dropDuplicates(["file_id", "nline"]), min_lines, same_file), number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", state_path).trigger(availableNow=True).start()
