"""Tables, written intermediates and distributed ranks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.session import scratch_path

#: Rows per Arrow batch where a row holds a whole text; keeps a worker's batch small.
TEXT_ROWS_PER_BATCH = 500

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = (1 << 33) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches, for Python workers that read whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Writes ``df`` in total order with its place: ``pid`` (range partition) and ``idx`` (row in it).

    Ranges are cut on all of ``order``, so a hot leading key is spread over
    many partitions. The places are written with the rows; a task that is run
    again later cannot number them differently.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumns(
        {
            "pid": F.spark_partition_id(),
            "idx": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)),
        }
    )
    return materialize(placed, name)


def with_places(placed: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 in the order of :func:`number_rows`. One count per partition is joined."""
    counts = placed.groupBy("pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(materialize(offsets, "offsets"), "pid").withColumn(name, F.col("_offset") + F.col("idx")).drop("_offset", "pid", "idx")


def running_start(placed: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one within ``keys``.

    ``placed`` comes from :func:`number_rows` with ``keys`` leading its order.
    Two levels: sums per (keys, partition) give offsets, a window inside the
    partition gives the rest. The offsets have one row per key and partition.
    """
    parts = placed.groupBy(*keys, "pid").agg(F.sum(value).alias("_part"))
    before = Window.orderBy("pid") if not keys else Window.partitionBy(*keys).orderBy("pid")
    offsets = parts.withColumn(
        "_offset", F.coalesce(F.sum("_part").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_part")
    offsets = materialize(offsets, "offsets")
    inside = Window.partitionBy(*keys, "pid").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [*keys, "pid"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )
