"""Scoring completions as they come: the text components on a stream, appended to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def text_scores(completions: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the extracted SQL and the components that need no execution; the same expressions on batch and stream."""
    found = completions.withColumn("pred_sql", X.extract_sql(F.col("text")))
    scores: dict[str, Column] = {
        "syntax": X.syntax_valid(F.col("text")),
        "format": X.format_compliance(F.col("text"), F.col("pred_sql")),
        "schema_f1": X.schema_f1(F.col("pred_sql"), F.col("gold_sql")),
    }
    return found.select(*keep, "pred_sql", *[c.alias(name) for name, c in scores.items()])


def score_stream(completions: DataFrame, keep: list[str], path: str, checkpoint: str) -> DataFrame:
    """Score what a stream of completions holds by now and append it to the table at ``path``, which is returned.

    Each completion is scored once: the next call with the same ``checkpoint`` goes on behind the last one, also after one that was
    cut off, and the table lists only whole batches.
    """
    scored = text_scores(completions, keep)
    query = (
        scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return completions.sparkSession.read.schema(scored.schema).parquet(path)
