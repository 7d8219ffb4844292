"""Streaming counterparts: period aggregates, duplicates, panel refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators.timeseries import add_time_series_features


def stream_period_aggregate(
    stream: DataFrame,
    ts: str,
    keys: list[str],
    value: str,
    unique: str | None = None,
    period: str = "1 day",
    delay: str = "1 day",
) -> DataFrame:
    """Sum, count, mean (and approximate uniques) per key and period of a stream.

    ``period`` is a window length such as "1 day", or "month". Months have no
    fixed length, so they are grouped by their first day and need the update or
    complete output mode.
    """
    marked = stream.withWatermark(ts, delay)
    aggregates = [
        F.coalesce(F.sum(value), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.avg(value).alias("avg_ticket"),
    ]
    if unique:
        aggregates.append(F.approx_count_distinct(unique).alias("approx_customers"))
    if period == "month":
        return marked.groupBy(*keys, F.trunc(ts, "month").alias("ds")).agg(*aggregates)
    grouped = marked.groupBy(*keys, F.window(ts, period).alias("_w")).agg(*aggregates)
    return grouped.withColumn("ds", F.to_date("_w.start")).drop("_w")


def stream_dedup_events(stream: DataFrame, ts: str, ids: list[str], delay: str = "1 day") -> DataFrame:
    """First arrival per id; repeats within the delay are dropped and state expires with the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)


def run_to_table(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Drains the available input into a parquet table; further calls go on where the last one stopped.

    The checkpoint belongs to the table: by default it lies beside ``path``. In
    append mode the file sink is exactly-once. In complete mode each micro-batch
    replaces the table. In update mode each writes the rows that changed under
    its own number, and :func:`read_updates` gives the latest row of each key.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint or f"{path.rstrip('/')}.checkpoint")
    if mode == "append":
        query = writer.format("parquet").start(path)
    elif mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order; a partial aggregate, so a key with many versions is no hot key."""
    columns = [c for c in rows.columns if c not in keys]
    lead = [*order, *[c for c in columns if c not in order]]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("_last"))
    return newest.select(*keys, "_last.*").select(*rows.columns)


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that update mode has written: of each key the row of its last micro-batch."""
    return latest(spark.read.parquet(path), keys, ["batch"]).drop("batch")


class PanelRefresher:
    """``foreachBatch`` handler that upserts arriving period rows into a panel.

    The panel is a base and numbered arrivals; the last arrival of a period
    counts, and within a batch the last in the order of ``arrival`` (then of the
    other columns). A batch writes its arrivals only, never the whole panel.
    Features are recomputed for the touched series, from the first touched
    period on as far as lags, windows and yearly growth reach, and handed to
    ``score``. A replayed batch, also after a restart, repeats the same work
    into the same folders.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: list[str],
        settings: Settings = Settings(),
        arrival: str | None = None,
        score: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.keys, self.settings = spark, path, keys, settings
        self.arrival, self.score = arrival, score
        #: Rows that a period's features look back, and so how far a correction reaches.
        self.reach = max([*settings.lag_periods, *settings.rolling_windows, 12])

    def start_from(self, panel: DataFrame) -> "PanelRefresher":
        panel.write.mode("overwrite").parquet(f"{self.path}/rows/batch=-1")
        return self

    def current(self, batch_id: int | None = None) -> DataFrame:
        """The panel after a batch, by default after the last one."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if batch_id is not None:
            rows = rows.filter(F.col("batch") <= batch_id)
        return latest(rows, [*self.keys, "ds"], ["batch"]).drop("batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        columns = self.spark.read.parquet(f"{self.path}/rows/batch=-1").columns
        ids = [*self.keys, "ds"]
        order = [self.arrival] if self.arrival else []
        arrived_path = f"{self.path}/rows/batch={batch_id}"
        latest(batch, ids, order).select(*columns).write.mode("overwrite").parquet(arrived_path)
        # the stored batch decides which rows are touched, also after a retry
        arrived = self.spark.read.parquet(arrived_path)
        touched = arrived.withColumn("_one", F.lit(1)).groupBy("_one", *self.keys).agg(F.min("ds").alias("_from"), F.max("ds").alias("_to"))
        panel = self.current(batch_id).withColumn("_one", F.lit(1)).join(touched, ["_one", *self.keys])
        # features count rows: as many before the first touched period, and after the last one, as they reach
        before, after = F.col("ds") < F.col("_from"), F.col("ds") > F.col("_to")
        side = F.when(before, -1).when(after, 1).otherwise(0)
        away = F.row_number().over(
            Window.partitionBy(*self.keys, "_side").orderBy(F.when(before, -F.unix_date("ds")).otherwise(F.unix_date("ds")))
        )
        near = panel.withColumn("_side", side).withColumn("_away", away).filter((F.col("_side") == 0) | (F.col("_away") <= self.reach))
        changed = near.filter(F.col("_side") >= 0).select(*ids)
        featured = add_time_series_features(near.select(*columns), self.settings, self.keys).join(changed, ids, "left_semi")
        out = self.score(featured) if self.score else featured
        out.write.mode("overwrite").parquet(f"{self.path}/features/batch={batch_id}")

    def features(self) -> DataFrame:
        """The recomputed feature rows of all batches, the last of each period."""
        return read_updates(self.spark, f"{self.path}/features", [*self.keys, "ds"])


def stream_panel_refresh(stream: DataFrame, refresher: PanelRefresher) -> None:
    """Feeds a stream of period rows to the refresher until the input is drained."""
    query = (
        stream.writeStream.foreachBatch(refresher)
        .option("checkpointLocation", f"{refresher.path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
