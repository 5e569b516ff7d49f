"""Mixing sources to target weights by nested hash-threshold histograms. No sort of documents.

A source whose target is between whole multiples of its size takes every document that many times, and once
more the documents whose hash lies below a threshold. The threshold is found digit by digit: tokens are summed
by source and hash bucket, the bucket in which the budget ends is found, and only that bucket is split again.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents with the same id
have the same hash and are taken together; a source without words has target 0; an empty table gives an empty
answer; other columns are kept by ``mixed`` and ignored by ``shares``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltally.llm.words import n_words
from sqltally.session import kept

#: 60 hash bits, read in four digits of 15.
DIGIT, LEVELS = 15, 4


def hash_of(doc_id: Column) -> Column:
    """60 bits of the id's MD5 as a whole number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast(
        "bigint"
    )


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Adds ``target`` to one row per source (``_key, source, source_size``).

    A target is ``least(most * size, weight * level)`` with the level at which the targets sum up to the share:
    the end of resharing every excess by weight. Sources reach their limit in the order of limit by weight, so
    the level comes from the sums before each source in that order.
    """
    every = Window.partitionBy()
    named = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (place + 1).cast("int"))
    limit = F.col("source_size") * most
    weighed = sources.withColumn("_weight", weight).withColumn("_limit", limit)
    by_ratio = (
        Window.partitionBy()
        .orderBy((F.col("_limit") / F.col("_weight")), F.col("_key"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    budget = F.sum("source_size").over(every) * share[0] / F.lit(float(share[1]))
    level = (budget - F.coalesce(F.sum("_limit").over(by_ratio), F.lit(0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0))
    )
    # Sources at their limit come first; the level of the first one below it holds for all that follow.
    levelled = weighed.withColumn("_level", level).withColumn(
        "_below", F.col("_weight") * F.col("_level") < F.col("_limit")
    )
    common = F.min(F.when(F.col("_below"), F.struct(F.col("_limit") / F.col("_weight"), F.col("_key"), F.col("_level"))))
    return levelled.withColumn("_common", common.over(every)["_level"]).select(
        "_key",
        "source_size",
        F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_weight") * F.col("_common"), F.col("_limit").cast("double"))).alias("target"),
    )


def _cuts(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash ``_cut`` below which documents fill the budget, and ``_with``: the cut's own documents too."""
    state = budgets.select("_key", "rest", F.lit(0).cast("bigint").alias("_prefix"), F.lit(0).cast("bigint").alias("_before"))
    for digit in range(LEVELS):
        below = DIGIT * (LEVELS - 1 - digit)
        bucket = F.shiftright("_hash", below)
        rows = sized.withColumn("_prefix", F.shiftright("_hash", below + DIGIT))
        sums = rows.join(state.select("_key", "_prefix"), ["_key", "_prefix"]) if digit else rows
        counts = sums.groupBy("_key", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        ordered = Window.partitionBy("_key").orderBy("_bucket")
        ends = counts.join(state, "_key").withColumn("_end", F.col("_before") + F.sum("_sum").over(ordered))
        first = F.min(F.when(F.col("_end") > F.col("rest"), F.struct("_bucket", "_end", "_sum")))
        state = kept(
            ends.groupBy("_key", "rest").agg(first.alias("_at")).where("_at IS NOT NULL").select(
                "_key",
                "rest",
                F.col("_at._bucket").alias("_prefix"),
                (F.col("_at._end") - F.col("_at._sum")).alias("_before"),
                F.col("_at._end").alias("_end"),
            ),
            f"mix-level-{digit}",
        ).select("_key", "rest", "_prefix", "_before", "_end")
    nearer = (F.col("_end") - F.col("rest")) < (F.col("rest") - F.col("_before"))
    return state.select("_key", F.col("_prefix").alias("_cut"), nearer.alias("_with"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> tuple[DataFrame, DataFrame]:
    """The sized documents, and one row per source: ``_key, source_size, target, _whole, _cut, _with``."""
    sized = kept(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).select(
            "doc_id", "size", "source", source_key(F.col("source")).alias("_key"), hash_of(F.col("doc_id")).alias("_hash")
        ),
        "mix-sizes",
    )
    sources = kept(
        sized.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-sources"
    )
    aimed = targets(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    budgets = kept(
        aimed.withColumn("_whole", whole).withColumn("rest", F.col("target") - F.col("_whole") * F.col("source_size")),
        "mix-budgets",
    )
    cuts = _cuts(sized, budgets.where("rest > 0"))
    return sized, kept(budgets.join(cuts, "_key", "left").drop("rest"), "mix-cuts")


def _times() -> Column:
    below = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & F.col("_with"))
    return F.col("_whole") + F.when(F.coalesce(below, F.lit(False)), 1).otherwise(0)


def shares(docs: DataFrame, **how) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; taken counts repeated words as often."""
    sized, cuts = plan(docs, **how)
    return sized.join(cuts, "_key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("bigint").alias("taken")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    _, cuts = plan(docs, **how)
    rows = docs.select(F.struct("*").alias("row"), source_key(F.col("source")).alias("_key"), hash_of(F.col("doc_id")).alias("_hash"))
    return (
        rows.join(cuts, "_key").withColumn("_times", _times()).where("_times > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .select("row.*")
    )
