"""Dense numbers in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.session import materialize


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... in the given order, which must be total.

    Rows are range-partitioned and sorted; each partition counts its own rows, and only one count per
    partition is summed up in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    # one row per partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")
