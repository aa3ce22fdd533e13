"""Dense codes in key order for any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.plans.scratch import Scratch

#: Up to so many rows, one task numbers them; beyond, a range partitioning does.
ONE_TASK_ROWS = 2_000_000


def range_parts(spark: SparkSession, bound: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), bound // ONE_TASK_ROWS)


def numbered(rows: DataFrame, order: list[str], name: str, rows_bound: int | None = None, scratch: Scratch | None = None, dealt: bool = False) -> DataFrame:
    """``rows`` with consecutive numbers from 0 in ascending order of the columns ``order``, which must be unique.

    ``rows_bound``: a known upper bound of the row count; else the rows are counted.  ``dealt``: many rows lie in the
    ``range_parts`` tasks of a range partitioning by ``order`` already.
    """
    bound = rows_bound if rows_bound is not None else rows.count()
    if bound <= ONE_TASK_ROWS:
        return rows.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    spark = rows.sparkSession
    parts = range_parts(spark, bound)
    ranged = (rows if dealt else rows.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
    # a row's place within its sorted task is the low part of its id, so no second shuffle numbers the rows
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    # partition numbers must not change between the two uses; without a run to belong to, the table stays with the result
    placed = scratch.table(ranged) if scratch else Scratch(spark, "numbered").keep(ranged)
    counts = {r._part: r.n for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, at = [], 0
    for part in range(parts):
        starts.append(at)
        at += counts.get(part, 0)
    # a constant and not a join, so that Spark still knows how small a numbered table is
    start = F.get(F.array(*(F.lit(v).cast("long") for v in starts)), F.col("_part"))
    return placed.withColumn(name, start + F.col("_at")).drop("_part", "_at")
