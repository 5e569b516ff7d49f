"""Whole jobs: score completions, filter a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import candidates as C
from ..operators import compare, corpus
from ..session import kept


def as_text(completions: DataFrame) -> DataFrame:
    """Completions whose ``text`` is a string; given as an array of messages ``{role, content}`` it becomes one."""
    if isinstance(completions.schema["text"].dataType, T.ArrayType):
        return completions.withColumn("text", X.completion_text(F.col("text")))
    return completions


def with_keys(completions: DataFrame) -> DataFrame:
    db = F.col("db_id")
    return as_text(completions).withColumn("pred_sql", X.extract_sql(F.col("text"))).withColumns(
        {"gold_key": C.text_key(db, F.col("gold_sql")), "pred_key": C.text_key(db, F.col("pred_sql"))}
    )


def asked_key() -> Column:
    """Key of what a completion asks, ``db_id, gold_sql, text``: their sizes, -1 for a missing one, tell where each ends."""
    names = ["db_id", "gold_sql", "text"]
    sizes = [F.coalesce(F.length(n), F.lit(-1)).cast("string") for n in names]
    return F.sha2(F.concat_ws("\n", *sizes, *names), 256)


def execute_pairs(
    box: C.Sandbox, pairs: DataFrame, match: bool = True, cache: DataFrame | None = None
) -> DataFrame:
    """Outcome of distinct ``(gold_key, pred_key, db_id, gold_sql, pred_sql)`` pairs.

    References with a usable result in ``cache`` (as ``cache_gold_results`` makes it) are not run.
    """
    gold = pairs.select(F.col("gold_key").alias("key"), "db_id", F.col("gold_sql").alias("sql")).distinct()
    pred = pairs.select(F.col("pred_key").alias("key"), "db_id", F.col("pred_sql").alias("sql")).distinct()
    known = None
    if cache is not None:
        cache = kept(corpus.usable_cache(cache), "cache")
        known = corpus.cached_outcomes(cache)
        gold = gold.join(known.select("key"), "key", "left_anti")
    outcomes = C.run_candidates(box, gold.union(pred) if match else pred)
    found = outcomes.select(F.col("key").alias("pred_key"), "status", "error", "n_rows")
    if not match:
        return pairs.select("gold_key", "pred_key").join(found, "pred_key", "left")
    gold_outcomes, cached = outcomes, None
    if known is not None:
        gold_outcomes = outcomes.join(gold, "key", "left_semi").unionByName(known)
        cached = corpus.cached_rows(cache)
    references = gold_outcomes.select(
        F.col("key").alias("gold_key"), F.col("status").alias("gold_status"), F.col("n_rows").alias("gold_rows")
    )
    keyed = pairs.select("gold_key", "pred_key", X.is_ordered(F.col("gold_sql")).alias("ordered"))
    matched = compare.match_pairs(box, keyed, gold_outcomes, outcomes, cached)
    return matched.join(found, "pred_key", "left").join(references, "gold_key", "left")


def score_completions(
    box: C.Sandbox, completions: DataFrame, match: bool = True, cache: DataFrame | None = None
) -> DataFrame:
    """Completions with ``pred_sql, status, error, n_rows, gold_status, gold_rows, matched``.

    One pass finds the distinct completions of a reference, from which SQL is extracted once each, a second one joins their
    outcomes back by one hash per row. A completion is a string or an array of messages. Execution work grows with the distinct texts, not with the completions.
    ``match=False`` leaves the references and the comparison out. References with a whole result in ``cache`` are
    not run; those with a missing or broken one are.
    """
    given = as_text(completions)
    keyed = kept(with_keys(given.select("db_id", "gold_sql", "text").distinct()).withColumn("_asked", asked_key()), "texts")
    # A missing reference and an empty one have the same key, so they are one pair.
    gold = F.coalesce("gold_sql", F.lit("")).alias("gold_sql")
    pairs = kept(keyed.select("gold_key", "pred_key", "db_id", gold, "pred_sql").dropDuplicates(["gold_key", "pred_key"]), "pairs")
    results = execute_pairs(box, pairs, match, cache if match else None)
    told = keyed.select("_asked", "pred_sql", "gold_key", "pred_key").join(results, ["gold_key", "pred_key"], "left").drop("gold_key", "pred_key")
    return given.withColumn("_asked", asked_key()).join(kept(told, "results"), "_asked", "left").drop("_asked")


def judge_corpus(box: C.Sandbox, examples: DataFrame, run_db: str | None = None) -> DataFrame:
    """Examples with the outcome of their reference SQL."""
    db = F.lit(run_db) if run_db else F.col("db_id")
    outcomes = C.run_candidates(box, examples.select(db.alias("db_id"), F.col("gold_sql").alias("sql")))
    return corpus.with_outcome(examples, outcomes, db)


def filter_corpus(
    box: C.Sandbox, examples: DataFrame, run_db: str | None = None, remove_empty: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runnable examples, the report of what was dropped, and the cached results of their references.

    Each reference is run once for all three.
    """
    db = F.lit(run_db) if run_db else F.col("db_id")
    cache, outcomes = cache_gold_results(box, examples, run_db)
    judged = corpus.with_outcome(examples, outcomes, db)
    stay = corpus.keep_runnable(judged, remove_empty).drop("status", "error")
    used = cache.join(stay.select(F.col("gold_key").alias("key")).distinct(), "key", "left_semi")
    return stay, corpus.filter_report(judged, remove_empty), used


def cache_gold_results(box: C.Sandbox, examples: DataFrame, run_db: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cached results of the distinct reference texts, and their outcomes; each text is run once."""
    db = F.lit(run_db) if run_db else F.col("db_id")
    outcomes, rows = C.run_and_keep(box, examples.select(db.alias("db_id"), F.col("gold_sql").alias("sql")))
    return corpus.gold_results(outcomes, rows), outcomes
