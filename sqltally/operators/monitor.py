"""Training-log monitors over ``(run, step, component, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .running import carried


def reward_by_step(log: DataFrame, every: int = fixed.LOGGING_STEPS) -> DataFrame:
    """Mean of each component per logged step, and its share of the step's total.

    The share is a frame over the components of one step, a handful of aggregated rows.
    """
    means = log.groupBy("run", F.floor(F.col("step") / every).cast("bigint").alias("logged"), "component").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    total = F.sum("mean").over(Window.partitionBy("run", "logged"))
    return means.withColumn("share", F.when(total != 0, F.col("mean") / total))


def reward_saturation(
    log: DataFrame, threshold: float, watched: str = "syntax", goal: str = "execution", every: int = fixed.LOGGING_STEPS
) -> DataFrame:
    """Flag logged steps where ``watched`` is saturated while ``goal`` did not improve.

    The previous goal is the last one logged before the step, however many steps lie between. It is carried over block by
    block: a window over a whole run would put that run in one task.
    """
    means = (
        log.where(F.col("component").isin(watched, goal))
        .groupBy("run", F.floor(F.col("step") / every).cast("bigint").alias("logged"))
        .agg(
            F.avg(F.when(F.col("component") == watched, F.col("value"))).alias("watched_mean"),
            F.avg(F.when(F.col("component") == goal, F.col("value"))).alias("goal_mean"),
        )
    )
    saturated = (F.col("watched_mean") >= threshold) & (F.col("goal_mean") <= F.col("previous_goal"))
    previous = carried(means, ["run"], "logged", "goal_mean", "previous_goal")
    return previous.withColumn("flagged", F.coalesce(saturated, F.lit(False)))
