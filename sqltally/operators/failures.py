"""Failure taxonomy over scored predictions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .running import first_rows


def failures_only(predictions: DataFrame) -> DataFrame:
    """Rows not marked correct, unmarked ones included."""
    return predictions.where(~F.coalesce("correct", F.lit(False)))


def identifier_diff(df: DataFrame, pred_sql: str = "pred_sql", gold_sql: str = "gold_sql") -> DataFrame:
    """Names missing from and added to the prediction, keywords and functions aside."""
    sets = F.struct(
        X.schema_names(X.identifier_set(F.col(pred_sql))).alias("pred"),
        X.schema_names(X.identifier_set(F.col(gold_sql))).alias("gold"),
    )
    both = X.let(
        sets,
        lambda s: F.struct(
            F.array_except(s["gold"], s["pred"]).alias("missing"), F.array_except(s["pred"], s["gold"]).alias("extra")
        ),
    )
    return df.withColumn("_diff", both).select(*df.columns, "_diff.missing", "_diff.extra")


def identifier_overlap(pred_sql: Column, gold_sql: Column) -> Column:
    return F.array_intersect(X.identifier_set(pred_sql), X.identifier_set(gold_sql))


def failure_class() -> Column:
    """Category of a failed row ``(pred_sql, gold_sql, error, n_rows, gold_rows)``; first rule wins."""
    pred, gold = F.upper(F.coalesce("pred_sql", F.lit(""))), F.upper(F.coalesce("gold_sql", F.lit("")))

    def mentions(sql: Column, marker: str) -> Column:
        return F.contains(sql, F.lit(marker))

    def aggregates(sql: Column) -> Column:
        return functools.reduce(operator.or_, [mentions(sql, m) for m in fixed.AGGREGATE_MARKERS])

    def differ(marker: str) -> Column:
        return mentions(pred, marker) != mentions(gold, marker)

    sets = F.struct(
        X.schema_names(X.identifier_set(F.col("pred_sql"))).alias("pred"),
        X.schema_names(X.identifier_set(F.col("gold_sql"))).alias("gold"),
    )
    # Equal sets have equal sizes and nothing missing.
    same_names = X.let(
        sets, lambda s: (F.size(s["pred"]) == F.size(s["gold"])) & (F.size(F.array_except(s["gold"], s["pred"])) == 0)
    )
    return (
        F.when(~X.has_select(pred), "syntax_error")
        .when(F.coalesce("error", F.lit("")) != "", "execution_error")
        .when(~same_names, "wrong_table")
        .when(aggregates(pred) | aggregates(gold), "wrong_aggregation")
        .when(differ("ORDER BY"), "wrong_order")
        .when(differ("WHERE"), "wrong_filter")
        .when(differ("JOIN"), "wrong_join")
        .when((F.col("n_rows") == 0) & (F.col("gold_rows") > 0), "empty_result")
        .otherwise("other")
    )


def failure_class3() -> Column:
    syntax, execution, result = fixed.COARSE_CATEGORIES
    return (
        F.when(~X.has_select(F.col("pred_sql")), syntax)
        .when(F.coalesce("error", F.lit("")) != "", execution)
        .otherwise(result)
    )


def category_order(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "ord int, category string")


def category_counts(classified: DataFrame, names: list[str], category: str = "category") -> DataFrame:
    """Count and percentage of every category in ``names``, absent ones with 0."""
    found = classified.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    listed = category_order(classified.sparkSession, names).join(found, "category", "left")
    full = listed.withColumn("n", F.coalesce("n", F.lit(0)))
    # A frame over the fixed list of categories, not over data rows.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    pct = F.when(total > 0, F.col("n") / total * 100).otherwise(0.0)
    return full.select("ord", "category", "n", pct.alias("pct"))


def failure_counts(failures: DataFrame) -> DataFrame:
    return category_counts(failures.select(failure_class().alias("category")), fixed.FAILURE_CATEGORIES)


def failure_share3(failures: DataFrame) -> DataFrame:
    return category_counts(failures.select(failure_class3().alias("category")), fixed.COARSE_CATEGORIES)


def ordered_categories(counted: DataFrame) -> DataFrame:
    """Categories by count, largest first, ties in declared order."""
    return counted.orderBy(F.desc("n"), F.asc("ord"))


def top_failures(failures: DataFrame, categories: int = 3, rows: int = 2, chars: int = 80) -> DataFrame:
    """First rows of the largest categories, texts cut for display; the question too where there is one.

    Per category at most ``rows`` rows leave a task.
    """
    question = F.left("question", F.lit(chars)) if "question" in failures.columns else F.lit(None).cast("string")
    classified = failures.select("cid", question.alias("question"), "gold_sql", "pred_sql", failure_class().alias("category"))
    largest = (
        ordered_categories(category_counts(classified, fixed.FAILURE_CATEGORIES).where("n > 0"))
        .limit(categories)
        .select("category", "n", "ord")
    )
    firsts = first_rows(classified, ["category"], [F.col("cid")], rows)
    return firsts.join(largest, "category").select(
        "category",
        "n",
        "rk",
        "cid",
        "question",
        F.left("gold_sql", F.lit(chars)).alias("gold_sql"),
        F.left("pred_sql", F.lit(chars)).alias("pred_sql"),
    )


def category_by_method(failures: DataFrame, baseline: str) -> DataFrame:
    """Failures per category and method, 0 included, and the reduction against the baseline method."""
    found = failures.groupBy("method", failure_class().alias("category")).agg(F.count(F.lit(1)).alias("n"))
    # Methods times categories: both are dimensions of a few entries.
    names = F.explode(F.array(*[F.lit(c) for c in fixed.FAILURE_CATEGORIES])).alias("category")
    grid = found.select("method").distinct().select("method", names)
    counted = grid.join(found, ["method", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    base = F.max(F.when(F.col("method") == baseline, F.col("n"))).over(Window.partitionBy("category"))
    return counted.withColumn("reduction", F.coalesce(base, F.lit(0)) - F.col("n"))
