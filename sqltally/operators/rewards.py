"""Reward components, their weighted sums, and group-relative advantages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


@dataclass(frozen=True)
class Component:
    """A reward: a name, a weight and a column over scored completions.

    ``score`` may return any DOUBLE column, a pandas UDF included.
    """

    name: str
    weight: float
    score: Callable[[DataFrame], Column]


def execution_score(df: DataFrame) -> Column:
    return F.coalesce(F.col("matched"), F.lit(False)).cast("double")


def success_score(df: DataFrame) -> Column:
    return F.coalesce(F.col("status").isin("ok", "empty"), F.lit(False)).cast("double")


SCORES: dict[str, Callable[[DataFrame], Column]] = {
    "execution": execution_score,
    "success": success_score,
    "syntax": lambda df: X.syntax_valid(F.col("text")),
    "schema_f1": lambda df: X.schema_f1(F.col("pred_sql"), F.col("gold_sql")),
    "format": lambda df: X.format_compliance(F.col("text"), F.col("pred_sql")),
}


def components(weights: Mapping[str, float]) -> list[Component]:
    return [Component(name, weight, SCORES[name]) for name, weight in weights.items()]


def with_reward(scored: DataFrame, parts: list[Component], name: str = "reward") -> DataFrame:
    """Add each component and their weighted sum."""
    valued = scored.withColumns({p.name: p.score(scored) for p in parts})
    total = F.lit(0.0)
    for p in parts:
        total = total + F.lit(p.weight) * F.col(p.name)
    return valued.withColumn(name, total)


def reward_phase1(scored: DataFrame) -> DataFrame:
    return with_reward(scored, components(fixed.PHASE1_WEIGHTS))


def reward_phase2(scored: DataFrame) -> DataFrame:
    return with_reward(scored, components(fixed.PHASE2_WEIGHTS))


def reward_weighted_long(values: DataFrame, weights: Mapping[str, float], by: str = "cid") -> DataFrame:
    """Weighted sum of any components held as rows ``(by, component, value)``.

    The weights are a literal map: no join. Sums are partial before the one shuffle. ``unweighted`` counts the rows
    whose component has no weight; they add nothing to the sum.
    """
    pairs = [F.lit(x) for item in weights.items() for x in item]
    weight = F.try_element_at(F.create_map(*pairs), F.col("component"))
    return values.groupBy(by).agg(
        F.sum(F.col("value") * F.coalesce(weight, F.lit(0.0))).alias("reward"), F.count_if(weight.isNull()).alias("unweighted")
    )


def group_advantage(rewarded: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """``(reward - group mean) / group deviation``; 0 where a group has no spread.

    Group figures come from a partial aggregate and are joined back, so a group of any size is
    never gathered in one task as a window would.
    """
    figures = rewarded.groupBy(group).agg(
        F.avg(reward).alias("group_mean"),
        F.stddev_samp(reward).alias("group_std"),
        (F.min(reward) == F.max(reward)).alias("flat"),
    )
    advantage = F.when(F.col("flat") | F.col("group_std").isNull(), 0.0).otherwise(
        (F.col(reward) - F.col("group_mean")) / F.col("group_std")
    )
    named = figures.withColumnRenamed(group, "_group")
    return (
        rewarded.join(named, rewarded[group].eqNullSafe(named["_group"]), "left")
        .withColumn("advantage", advantage)
        .drop("flat", "_group")
    )


def no_signal_groups(rewarded: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Groups whose rewards are all equal, hence teach nothing."""
    return (
        rewarded.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.min(reward).alias("low"), F.max(reward).alias("high"))
        .where(F.col("low") == F.col("high"))
        .select(group, "n", F.col("low").alias("reward"))
    )
