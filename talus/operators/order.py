"""Places in a total order without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.session import written

ROW_BITS = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """``rows`` with their place from 1 in ``order``; equal rows get places of their own.

    Rows are range-sorted and stored once with their task's number and their row in it. Each task's rows
    are counted; the counts, one small row a task, give the places where tasks begin.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(ranged.withColumn(name, F.monotonically_increasing_id()), "numbered")
    task = F.shiftright(name, ROW_BITS)
    counts = held.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begin"))
    # one row a task: bounded by the number of partitions
    joined = held.join(F.broadcast(begins), task == F.col("task")).drop("task")
    place = F.col("begin") + F.col(name).bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return joined.withColumn(name, place).drop("begin")
