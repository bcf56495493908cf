"""Consecutive numbers for rows without a sort in one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A row's number in its partition, and above these bits the partition's number.
ROW_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a local session gets one of its own; on a cluster that is an error, as no folder of the
    driver's machine would do. What is written there stays until the application has ended; whoever set the
    folder deletes it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="strandkit-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint, so that it is computed once and for all."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def number_rows(df: DataFrame, order: list[str], name: str = "rn", by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with name, the place (from 0) of its row in the given order, among the rows with equal values of by.

    Rows are sorted into ranges; a row's place is that in its range, plus the rows of the same by in ranges before it.
    Only the counts per range and by are summed in one place. Neither hot nor sparse keys make a large task. Nulls in by are equal;
    rows with equal values of order are numbered in any order; an empty table gives no rows.
    """
    at = F.monotonically_increasing_id()
    given = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    keys, places = [f"by_{i}" for i in range(len(by))], [f"order_{i}" for i in range(len(order))]
    named = df.select(given, *[F.col(c).alias(k) for c, k in zip(by, keys)], *[F.col(c).alias(k) for c, k in zip(order, places)])
    placed = settled(named.repartitionByRange(*keys, *places).sortWithinPartitions(*keys, *places).select("row", *keys, at.alias("at")))
    placed = placed.withColumn("range", F.shiftright("at", ROW_BITS)).withColumn("at", F.col("at").bitwiseAND((1 << ROW_BITS) - 1))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    runs = placed.groupBy("range", *keys).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    runs = runs.select(F.col("range").alias("of_range"), *[F.col(k).alias(f"of_{k}") for k in keys], (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    same = F.col("range") == F.col("of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return placed.join(runs, same).select(*[F.col(f"row.`{c}`") for c in df.columns if c != name], (F.col("at") + F.col("shift")).alias(name))


def running_sums(df: DataFrame, order: list[str], weight: str, name: str = "until", by: list[str] = []) -> DataFrame:  # noqa: B006
    """df with name, the sum of weight over the rows up to its own in the given order, among the rows with equal values of by.

    Rows are sorted into ranges, summed within each, and what the ranges before hold is added; so no group is one task. Equal
    values of order should be one row. Nulls in by are equal.
    """
    keys, places = [f"by_{i}" for i in range(len(by))], [f"order_{i}" for i in range(len(order))]
    given = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    named = df.select(given, F.col(weight).alias("weight"), *[F.col(c).alias(k) for c, k in zip(by, keys)], *[F.col(c).alias(k) for c, k in zip(order, places)])
    placed = settled(named.repartitionByRange(*keys, *places).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    runs = placed.groupBy("range", *keys).agg(F.sum("weight").alias("n"))
    runs = runs.select(F.col("range").alias("of_range"), *[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.sum("weight").over(Window.partitionBy("range", *keys).orderBy(*places).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("range") == F.col("of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return placed.withColumn("within", within).join(runs, same).select(*[F.col(f"row.`{c}`") for c in df.columns if c != name], (F.col("within") + F.col("shift")).alias(name))
