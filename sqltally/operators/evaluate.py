"""Accuracy figures over prediction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .corpus import question_key
from .running import carried, running



def is_correct(verdict: str = "correct") -> Column:
    """A missing verdict counts as wrong."""
    return F.coalesce(F.col(verdict), F.lit(False))


def accuracy() -> Column:
    return F.coalesce(F.avg(is_correct().cast("double")), F.lit(0.0))


def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if(is_correct()).alias("correct")]


def attach_difficulty(predictions: DataFrame, raw: DataFrame) -> DataFrame:
    """Tier of each prediction from the raw example at the same ``idx``; unknown without one."""
    tiers = raw.select("idx", X.difficulty(F.col("sql")).alias("difficulty"))
    return predictions.join(tiers, "idx", "left").withColumn(
        "difficulty", F.coalesce("difficulty", F.lit(fixed.UNKNOWN_TIER))
    )


def ex_overall(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(by or [])).agg(*counts(), accuracy().alias("ex"))


def ex_by_difficulty(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(by or []), "difficulty").agg(*counts(), accuracy().alias("ex"))


def eval_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by`` with totals and a map of accuracy per tier.

    Rows are counted per tier once; totals add up those few counts.
    """
    known = predictions.withColumn("difficulty", F.coalesce("difficulty", F.lit(fixed.UNKNOWN_TIER)))
    tiers = known.groupBy(*by, "difficulty").agg(*counts())
    entry = F.struct("difficulty", (F.col("correct") / F.col("total")).alias("ex"))
    return (
        tiers.groupBy(*by)
        .agg(
            F.sum("total").alias("total"),
            F.sum("correct").alias("correct"),
            F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_difficulty"),
        )
        .withColumn("overall_ex", F.col("correct") / F.col("total"))
    )


def running_ex(predictions: DataFrame, by: list[str], batch: int = fixed.EVAL_BATCH_ROWS) -> DataFrame:
    """Cumulative accuracy after each batch of rows in ``idx`` order.

    Rows are counted per batch first. The running sums then go block by block, since a long run
    still has many batches.
    """
    batches = predictions.groupBy(*by, F.floor(F.col("idx") / batch).cast("bigint").alias("batch")).agg(*counts())
    summed = running(batches, by, "batch", {"processed": "total", "solved": "correct"})
    return summed.select(*by, "batch", "processed", "solved", (F.col("solved") / F.col("processed")).alias("ex"))


def devset_accuracy(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean score; a row whose scoring failed (NULL) counts as 0."""
    return scores.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("evaluated"), F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("accuracy")
    )


def exact_vs_execution(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of predictions with the same text as the reference against the share with its result."""
    same = question_key(F.col("pred_sql")) == question_key(F.col("gold_sql"))
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(same.cast("double")).alias("exact_match"),
        F.avg(F.coalesce("matched", F.lit(False)).cast("double")).alias("execution_accuracy"),
    )


def accuracy_ci(predictions: DataFrame, by: list[str], z: float = 1.96) -> DataFrame:
    """Accuracy with the half-width of its normal confidence interval."""
    p = F.col("ex")
    return ex_overall(predictions, by).withColumn("half_width", F.lit(z) * F.sqrt(p * (1 - p) / F.col("total")))


def condition_table(predictions: DataFrame, splits: list[str]) -> DataFrame:
    """One row per method, one accuracy column per split."""
    return predictions.groupBy("method").pivot("split", splits).agg(F.avg(is_correct().cast("double")))


def metric_by_setting(predictions: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Accuracy curve per setting, with the final and the best point of each."""
    curve = predictions.groupBy(*by, step).agg(F.avg(is_correct().cast("double")).alias("ex"))
    return curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by("ex", step).alias("final_ex"),
        F.max("ex").alias("best_ex"),
        # Of equal points the earliest counts.
        F.max_by(step, F.struct("ex", (-F.col(step)).alias("early"))).alias("best_step"),
    )


def threshold_gate(predictions: DataFrame, by: list[str], gate: float = fixed.GATE_ACCURACY) -> DataFrame:
    """Groups that reach the gate."""
    return ex_overall(predictions, by).where(F.col("ex") >= gate)


def converged(points: DataFrame, run: str, step: str, gain: float = fixed.CONVERGENCE_GAIN) -> DataFrame:
    """Per run and step: were this gain and the one before it both below ``gain``?

    ``points(run, step, ex)`` has one row per optimiser iteration; ``step`` is a whole number. The two points before each are carried over
    block by block, so a long run is no single task.
    """
    before = carried(points, [run], step, "ex", "_last")
    before = carried(before, [run], step, "_last", "_before_last")
    small = (F.col("ex") - F.col("_last") < gain) & (F.col("_last") - F.col("_before_last") < gain)
    return before.withColumn("converged", F.coalesce(small, F.lit(False))).drop("_last", "_before_last")
