"""The reward log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import work_dir

WRITTEN = "window_start timestamp, run bigint, component string, n bigint, mean double, batch bigint"


def windowed_means(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Mean of each component per run and time window; the same expression on batch and stream."""
    timed = log.withWatermark("ts", lateness) if log.isStreaming else log
    return (
        timed.groupBy(F.window("ts", window).alias("w"), "run", "component")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
        .select(F.col("w.start").alias("window_start"), "run", "component", "n", "mean")
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had closed, over the batches of a query."""
    return sum(int(state.numRowsDroppedByWatermark) for done in query.recentProgress for state in done.stateOperators)


def drain(means: DataFrame, out: str, checkpoint: str) -> int:
    """Run windowed means over what their stream holds by now; the number of late rows.

    Each micro-batch writes the windows that it changed to a folder of its own below ``out``, which a repeated batch writes anew.
    The state lives in ``checkpoint``: the next call with both goes on where this one ended.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        means.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return late_rows(query)


def last_windows(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each window that ``drain`` wrote, those still open included."""
    written = spark.read.schema(WRITTEN).parquet(out)
    last = F.max_by(F.struct("n", "mean"), "batch").alias("last")
    return written.groupBy("window_start", "run", "component").agg(last).select(
        "window_start", "run", "component", "last.n", "last.mean"
    )


def reward_by_step_stream(
    log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Drain a streaming log ``run, component, value, ts`` and return all its windows, those still open at the end included.

    Closed windows leave the state, so it holds the open ones only. Give ``out`` and ``checkpoint`` to go on in a later call.
    """
    spark: SparkSession = log.sparkSession
    out, checkpoint = out or work_dir(spark, "stream-out"), checkpoint or work_dir(spark, "stream-state")
    drain(windowed_means(log, window, lateness), out, checkpoint)
    return last_windows(spark, out)
