"""Loading and evaluating in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as C
from ..operators import corpus, evaluate
from ..sources import splits
from .scoring import score_completions


def load_examples(
    spark: SparkSession, split: str, data_dir: str, schemas: DataFrame, filtered_path: str | None = None
) -> DataFrame:
    """Model-ready rows ``idx, prompt, gold_sql, db_id, db_path, question`` of a split.

    They come from the filtered corpus if there is one, else from the raw split, with the same columns either way.
    ``schemas`` holds ``db_id, schema_text``.
    """
    rows = splits.read_filtered_or_raw(spark, filtered_path, data_dir, split).where(F.col("split") == split)
    return corpus.attach_schema(rows, schemas).select(
        "idx",
        X.prompt_messages(F.col("question"), F.col("schema_text")).alias("prompt"),
        "gold_sql",
        "db_id",
        X.split_path(data_dir, F.col("split"), F.col("db_id")).alias("db_path"),
        "question",
    )


def evaluate_run(
    box: C.Sandbox, predictions: DataFrame, raw: DataFrame, by: list[str], cache: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records of ``predictions(idx, db_id, question, gold_sql, pred_sql, *by)`` and their summary.

    Records add ``correct``, ``difficulty`` (from ``raw(idx, sql)``) and ``pred_error``; both can go to ``write_eval``.
    """
    given = ["idx", "db_id", "question", "gold_sql", "pred_sql", *by]
    scored = score_completions(box, predictions.select(*given).withColumnRenamed("pred_sql", "text"), cache=cache)
    records = evaluate.attach_difficulty(scored.withColumn("correct", evaluate.is_correct("matched")), raw).select(
        *given, "correct", "difficulty", F.col("error").alias("pred_error")
    )
    return records, evaluate.eval_summary(records, by)
