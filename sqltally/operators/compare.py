"""Compare result sets as multisets, by distributed aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import candidates as C


def signed_match(gold: DataFrame, pred: DataFrame, by: list[str], row: list[str]) -> DataFrame:
    """Per ``by``: do both sides hold the same rows, each as often?

    Gold rows count +1 and predicted rows -1; the sides agree when every distinct row adds up to
    zero. The first shuffle spreads on key and row together, so one huge result set is shared by all
    tasks; the second only moves one flag per key and task. Columns in ``row`` decide what a row
    is: add a dense position to them to compare in order.
    """
    names = [*by, *row]
    signed = gold.select(*names, F.lit(1).alias("w")).union(pred.select(*names, F.lit(-1).alias("w")))
    return (
        signed.groupBy(*names)
        .agg(F.sum("w").alias("left_over"))
        .groupBy(*by)
        .agg(F.bool_and(F.col("left_over") == 0).alias("matched"))
    )


def result_match(
    examples: DataFrame, gold: DataFrame, pred: DataFrame, by: str, row: list[str], position: str | None = None
) -> DataFrame:
    """One row per example with ``matched``; no rows on either side is a match.

    With ``position`` (dense from 0 on both sides) the order counts too.
    """
    row = [*row, position] if position else row
    compared = signed_match(gold, pred, [by], row)
    return examples.join(compared, by, "left").withColumn("matched", F.coalesce("matched", F.lit(True)))


def rows_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference of two results."""
    return left.exceptAll(right)


def match_pairs(
    box: C.Sandbox, pairs: DataFrame, gold: DataFrame, pred: DataFrame, cached: DataFrame | None = None
) -> DataFrame:
    """``gold_key, pred_key, matched`` for distinct pairs ``gold_key, pred_key, ordered``.

    ``gold`` and ``pred`` are outcomes. Texts with the same plan match. Otherwise row count and digest
    rule out wrong pairs without moving a row, and small results compare by the SHA-256 over their
    rows. Only large or ordered results that still agree are run again, and SHA-256 over all their rows decides (``candidates.proofs``): a sum
    that is the same in any order, or one over rows with their positions.
    ``cached`` holds the rows of references that were not run.
    """
    known = ["key", "status", "n_rows", "digest", "bag", "seq", "plan"]
    gold_side, pred_side = (
        df.select(known).toDF(*[f"{side}_{c}" for c in known]) for side, df in (("gold", gold), ("pred", pred))
    )
    ran = ["ok", "empty"]
    judged = (
        pairs.join(gold_side, "gold_key", "left")
        .join(pred_side, "pred_key", "left")
        .select(
            "gold_key",
            "pred_key",
            "ordered",
            F.when(~F.coalesce(F.col("gold_status").isin(ran) & F.col("pred_status").isin(ran), F.lit(False)), "no")
            .when(F.col("gold_plan") == F.col("pred_plan"), "yes")
            .when((F.col("gold_n_rows") != F.col("pred_n_rows")) | (F.col("gold_digest") != F.col("pred_digest")), "no")
            .when(F.col("gold_n_rows") == 0, "yes")
            .when(F.col("gold_bag") != F.col("pred_bag"), "no")
            .when(~F.col("ordered") & (F.col("gold_bag") == F.col("pred_bag")), "yes")
            # Without a hash of their order, as texts that run without their ORDER BY are, ordered results are compared by it.
            .when(F.col("ordered") & (F.col("gold_seq") == F.col("pred_seq")), "yes")
            .when(F.col("ordered") & (F.col("gold_seq") != F.col("pred_seq")), "no")
            .otherwise("prove")
            .alias("verdict"),
        )
    )
    unproven = kept(judged.where(F.col("verdict") == "prove").select("gold_key", "pred_key", "ordered"), "unproven")
    asked = unproven.select("ordered", "gold_key").union(unproven.select("ordered", "pred_key")).distinct().toDF("ordered", "key")
    asked = kept(asked, "asked")
    salt, run = uuid.uuid4().hex, asked
    if cached is not None:
        # A key is that of a text, so cached and new rows of one key are rows of one result: never both.
        run = asked.join(cached.select("key").distinct(), "key", "left_anti")
    texts = gold.unionByName(pred).groupBy("key").agg(F.first("db_id").alias("db_id"), F.first("sql").alias("sql"), F.max("n_rows").alias("n_rows"))
    told = C.proofs(box, texts.join(run, "key"), salt)
    if cached is not None:
        told = told.unionByName(C.row_proofs(cached.join(asked, "key"), salt))
    told = kept(told, "proved")
    gold_told, pred_told = (told.select("ordered", F.col("key").alias(f"{s}_key"), F.col("proof").alias(f"{s}_proof")) for s in ("gold", "pred"))
    proved = unproven.join(gold_told, ["ordered", "gold_key"]).join(pred_told, ["ordered", "pred_key"]).select(
        "gold_key", "pred_key", (F.col("gold_proof") == F.col("pred_proof")).alias("matched")
    )
    return judged.join(proved, ["gold_key", "pred_key"], "left").select(
        "gold_key",
        "pred_key",
        F.when(F.col("verdict") == "prove", F.coalesce("matched", F.lit(False)))
        .otherwise(F.col("verdict") == "yes")
        .alias("matched"),
    )
