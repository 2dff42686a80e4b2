"""Global order: the number of each row in a sorted table, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.storage import materialise


def with_row_number(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of the columns ``order``; rows that tie in all of them are numbered in any order.

    Rows are range-partitioned and sorted, so every task numbers its own; what goes through the driver is one count a
    partition. The table is written once, since a range partitioning that runs again may cut elsewhere.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    rows = materialise(rows, "row-numbers")
    part = F.shiftright("_place", 33)
    starts, total = [], 0
    for r in rows.groupBy(part.alias("_part")).count().orderBy("_part").collect():
        starts.append((r["_part"], total))
        total += r["count"]
    start = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    number = F.col("_start") + F.col("_place") - F.shiftleft("_part", 33) + 1
    return rows.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn(name, number).drop("_part", "_start", "_place")


def by_row_number(a: DataFrame, a_order: list[str], b: DataFrame, b_order: list[str]) -> DataFrame:
    """Rows of ``a`` beside the rows of ``b`` with the same number; surplus rows of either are left out."""
    return with_row_number(a, a_order).join(with_row_number(b, b_order), "row_no")
