"""Method and tier reports, samples and batches."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .evaluate import counts, is_correct
from .running import first_rows, rank_rows


def sampling_key(identity: Column) -> Column:
    """Stable pseudo-random order of rows."""
    return F.md5(identity.cast("string"))


def method_by_difficulty(predictions: DataFrame, methods: list[str]) -> DataFrame:
    """Accuracy in percent, a row per tier and a column per method; 0 where a method has no row."""
    tiers = (
        predictions.where(F.col("difficulty").isin(fixed.TIERS))
        .groupBy("difficulty")
        .pivot("method", methods)
        .agg(F.avg(is_correct().cast("double")) * 100)
    )
    order = predictions.sparkSession.createDataFrame([(t,) for t in fixed.TIERS], "difficulty string")
    return order.join(tiers, "difficulty", "left").fillna(0.0, methods)


def method_delta(predictions: DataFrame, baseline: str) -> DataFrame:
    """Change of accuracy in points against the baseline, per tier and overall; a tier without rows counts as 0.

    Rows are counted per method and tier first, so the rollup expands a few counts only.
    """
    counted = predictions.groupBy("method", "difficulty").agg(*counts())
    rolled = (
        counted.rollup("method", "difficulty")
        .agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.grouping("difficulty").alias("all_tiers"))
        .where(F.col("method").isNotNull())
        .select(
            "method",
            F.when(F.col("all_tiers") == 1, "overall").otherwise(F.col("difficulty")).alias("difficulty"),
            (F.col("correct") / F.col("total") * 100).alias("ex"),
        )
    )
    # Methods times tiers: both are dimensions of a few entries.
    tiers = rolled.agg(F.collect_set("difficulty")).scalar()
    grid = rolled.select("method").distinct().select("method", F.explode(tiers).alias("difficulty"))
    full = grid.join(rolled, ["method", "difficulty"], "left").withColumn("ex", F.coalesce("ex", F.lit(0.0)))
    base = F.coalesce(F.max(F.when(F.col("method") == baseline, F.col("ex"))).over(Window.partitionBy("difficulty")), F.lit(0.0))
    return full.withColumn("delta", F.col("ex") - base).where(F.col("method") != baseline)


def discordant_methods(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that exactly one of two methods solves; one conditional aggregate, no self join."""
    solved = (
        predictions.where(F.col("method").isin(first, second))
        .groupBy("idx")
        .agg(
            F.bool_or((F.col("method") == first) & is_correct()).alias("a"),
            F.bool_or((F.col("method") == second) & is_correct()).alias("b"),
        )
    )
    return solved.where(F.col("a") != F.col("b")).select("idx", F.when(F.col("a"), first).otherwise(second).alias("solved_by"))


def stratified_sample(
    rows: DataFrame, n: int, tier: str = "difficulty", identity: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """``n`` rows per tier, and per ``by``, in a stable pseudo-random order; ``n`` rows per group leave a task."""
    return first_rows(rows, [*(by or []), tier], [sampling_key(F.col(identity)), F.col(identity)], n)


def mixed_batches(
    rows: DataFrame, batch_rows: int, tier: str = "difficulty", identity: str = "idx", by: list[str] | None = None
) -> DataFrame:
    """Deal the rows of every tier round-robin to batches of about ``batch_rows`` rows, for each ``by`` on its own.

    There are only a few tiers, so the rank inside a tier is put together from hash buckets instead
    of one window per tier.
    """
    by = by or []
    keyed = rows.withColumn("_key", sampling_key(F.col(identity)))
    ranked = rank_rows(keyed, [*by, tier], [F.col("_key"), F.col(identity)], F.substring("_key", 1, 4), "rank")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / batch_rows), F.lit(1)).cast("bigint").alias("_batches")
    sizes = rows.groupBy(*by).agg(needed)
    if by:
        sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_batches")
        same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        ranked = ranked.join(sizes, same).drop(*[f"_by_{c}" for c in by])
    else:
        ranked = ranked.withColumn("_batches", sizes.scalar())
    return ranked.withColumn("batch", F.pmod(F.col("rank") - 1, F.col("_batches"))).drop("_key", "rank", "_batches")
