"""Corpus preparation: prompts, demonstrations, filtering, leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..session import kept
from . import candidates as C
from .running import first_rows


def conversation_text(turns: DataFrame) -> DataFrame:
    """``conv_id, completion_text`` from long-form ``turns(conv_id, turn, role, text)``.

    The last assistant turn comes from a partial aggregate of fixed size. Only conversations
    without one are brought together to join their turns.
    """
    place = F.struct("turn", "text")
    last = turns.groupBy("conv_id").agg(
        F.max_by("text", F.when(F.col("role") == "assistant", place)).alias("last_text"),
        F.bool_or(F.col("role") == "assistant").alias("answered"),
    )
    answered = last.where("answered").select("conv_id", F.coalesce("last_text", F.lit("")).alias("completion_text"))
    rest = turns.join(answered.select("conv_id"), "conv_id", "left_anti")
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    joined = rest.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("completion_text")
    )
    return answered.unionByName(joined)


def attach_schema(examples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Schema text by database. One row per database on the right: adaptive execution broadcasts it
    when its measured size allows and splits a hot database's examples when it does not."""
    return examples.join(schemas.select("db_id", "schema_text"), "db_id", "left")


def program_examples(examples: DataFrame, limit: int | None = None) -> DataFrame:
    """Examples in the shape a prompt program takes, optionally the first ``limit`` in file order."""
    shaped = examples.select(
        "idx", "question", F.col("schema_text").alias("db_schema"), F.col("gold_sql").alias("sql_query"), "db_id", "db_path"
    )
    return head_rows(shaped, limit) if limit else shaped


def head_rows(df: DataFrame, n: int, order: str = "idx") -> DataFrame:
    return df.orderBy(order).limit(n)


def positional_split(examples: DataFrame, share: float = 0.8) -> DataFrame:
    """First ``int(share * n)`` rows train, the rest dev; ``idx`` is dense, so no global window."""
    cut = examples.agg(F.floor(F.lit(share) * F.count(F.lit(1))).cast("bigint").alias("cut")).scalar()
    return examples.withColumn("part", F.when(F.col("idx") < cut, "train").otherwise("dev"))


# --- few-shot -------------------------------------------------------------------------------------


def fewshot_demos(databases: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """``db_id, demos``: up to ``k`` demonstrations for each target database.

    Rows of the same database first, then the first rows of other databases, both in file order.
    A database gives at most ``k`` rows, so among the first ``2k`` of the kept rows at least ``k``
    belong to others whichever database is excluded: that short list serves every target, and no
    target is paired with the whole pool.
    """
    first = first_rows(train.select("db_id", "idx", "question", "gold_sql"), ["db_id"], [F.col("idx")], k)
    own = kept(first, "demos")
    entry = F.struct("idx", "db_id", "question", "gold_sql")
    own_lists = own.groupBy("db_id").agg(F.sort_array(F.collect_list(entry)).alias("own"))
    head = own.orderBy("idx").limit(2 * k).agg(F.sort_array(F.collect_list(entry)).alias("head")).scalar()
    others = F.filter(F.col("head"), lambda d: ~d["db_id"].eqNullSafe(F.col("db_id")))
    listed = F.when(F.col("own").isNull(), others).otherwise(F.concat("own", others))
    return (
        databases.select("db_id")
        .distinct()
        .join(own_lists, "db_id", "left")
        .withColumn("head", head)
        .select("db_id", F.slice(listed, 1, k).alias("demos"))
    )


def demo_text(demos: Column) -> Column:
    return F.array_join(
        F.transform(
            demos,
            lambda d: F.concat(F.lit("Question: "), d["question"], F.lit("\nSQL: "), d["gold_sql"], F.lit("\n\n")),
        ),
        "",
    )


def fewshot_prompt(examples: DataFrame, schemas: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """Examples with a few-shot ``prompt``; demonstration text is built once per database."""
    demos = fewshot_demos(examples, train, k).select("db_id", demo_text(F.col("demos")).alias("demo_text"))
    return (
        attach_schema(examples, schemas)
        .join(demos, "db_id", "left")
        .withColumn("prompt", X.prompt_messages(F.col("question"), F.col("schema_text"), F.col("demo_text")))
        .drop("schema_text", "demo_text")
    )


# --- filtering ------------------------------------------------------------------------------------


def drop_reason(remove_empty: bool = True) -> Column:
    """Why a row is dropped, NULL when it stays. A row without an outcome was not shown to run."""
    failed = F.col("error").isNotNull() | F.col("status").isNull()
    reason = F.when(F.contains("error", F.lit(fixed.TIMEOUT)), "timeout").when(failed, "error")
    return reason.when(F.col("n_rows") == 0, "empty_result") if remove_empty else reason


def with_outcome(examples: DataFrame, outcomes: DataFrame, run_db: Column | None = None) -> DataFrame:
    """Examples with ``status, error, n_rows`` of their reference SQL."""
    keyed = examples.withColumn(
        "gold_key", C.text_key(F.col("db_id") if run_db is None else run_db, F.col("gold_sql"))
    )
    known = outcomes.select(F.col("key").alias("gold_key"), "status", "error", "n_rows")
    return keyed.join(known, "gold_key", "left")


def keep_runnable(judged: DataFrame, remove_empty: bool = True) -> DataFrame:
    return judged.where(drop_reason(remove_empty).isNull())


def filter_report(judged: DataFrame, remove_empty: bool = True) -> DataFrame:
    """One row of counts: original, kept, removed and removed per reason."""
    reason = drop_reason(remove_empty)
    return judged.agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason.isNotNull()).alias("removed"),
        *[
            F.count_if(F.coalesce(reason, F.lit("")) == name).alias(name)
            for name in ("empty_result", "timeout", "error")
        ],
    )


# --- cached reference results -----------------------------------------------------------------------


#: Rows of a reference result in one text of its cache.
CHUNK_ROWS = 500


def gold_results(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, db_id, sql, n_rows, chunk, gold_result``: reference results as JSON texts of comparable rows, in order.

    A result of any size is whole: it takes as many chunks as it needs, and no chunk gathers more than
    ``CHUNK_ROWS`` rows. The texts hold the very values that results are compared under, so no type is guessed
    when they are read back.
    """
    placed = C.dense_positions(rows).withColumn("chunk", F.floor(F.col("pos") / CHUNK_ROWS).cast("bigint"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "r")))
    texts = placed.groupBy(F.col("key").alias("plan"), "chunk").agg(
        F.to_json(F.transform(listed, lambda p: p["r"])).alias("body")
    )
    ran = outcomes.where(F.col("status").isin("ok", "empty")).select("key", "db_id", "sql", "n_rows", "plan")
    return ran.join(texts, "plan", "left").select(
        "key",
        "db_id",
        "sql",
        "n_rows",
        F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk"),
        F.coalesce("body", F.lit("[]")).alias("gold_result"),
    )


def parsed_rows(gold_result: Column) -> Column:
    """Comparable rows of a cached JSON text, NULL when it is not a list of rows."""
    rows = F.from_json(gold_result, "array<array<string>>")
    return F.when(~F.exists(rows, lambda row: row.isNull()), rows)


def usable_cache(cache: DataFrame) -> DataFrame:
    """Chunks of the references all of whose chunks can be read and add up to the result."""
    read = cache.withColumn("_rows", F.size(parsed_rows(F.col("gold_result"))))
    whole = read.groupBy("key").agg(F.bool_and(F.col("_rows").isNotNull() & (F.col("_rows") >= 0)).alias("fine"),
                                    F.sum("_rows").alias("got"), F.max("n_rows").alias("wanted"))
    fine = whole.where("fine AND got = wanted").select("key")
    return cache.join(fine, "key", "left_semi")


def cached_rows(cache: DataFrame) -> DataFrame:
    """``key, part, at, r`` of a usable cache."""
    return cache.select("key", "chunk", F.posexplode(parsed_rows(F.col("gold_result"))).alias("at", "r")).select(
        "key", F.col("chunk").alias("part"), F.col("at").cast("bigint").alias("at"), "r"
    )


def cached_outcomes(cache: DataFrame) -> DataFrame:
    """Outcomes of the references of a usable cache, without running them.

    The digest is the same sum modulo 2**64 that a run makes. Results of one chunk have the hashes over their rows
    too; longer ones are compared by their rows where the digest agrees.
    """
    marks = F.transform("r", lambda row: F.sha2(F.to_json(row), 256))
    zero = F.lit(0).cast("decimal(38,0)")
    part = F.aggregate("r", zero, lambda total, row: (total + F.xxhash64(row).cast("decimal(38,0)")).cast("decimal(38,0)"))
    wrap = F.lit(str(2**64)).cast("decimal(38,0)")
    half = F.lit(str(2**63)).cast("decimal(38,0)")
    total = F.sum("part").cast("decimal(38,0)")
    single = F.count(F.lit(1)) == 1
    chunks = cache.withColumn("r", parsed_rows(F.col("gold_result"))).withColumn("marks", marks).select(
        "key", "db_id", "sql", F.size("r").cast("bigint").alias("n"), part.alias("part"),
        F.sha2(F.array_join(F.array_sort("marks"), ""), 256).alias("bag"), F.sha2(F.array_join("marks", ""), 256).alias("seq"),
    )
    n_rows = F.sum("n")
    return chunks.groupBy("key", "db_id", "sql").agg(
        F.when(n_rows == 0, "empty").otherwise("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        n_rows.alias("n_rows"),
        (F.pmod(total + half, wrap) - half).cast("bigint").alias("digest"),
        F.when(single & (n_rows > 0), F.max("bag")).alias("bag"),
        F.when(single & (n_rows > 0), F.max("seq")).alias("seq"),
        F.lit(None).cast("string").alias("plan"),
    )


def beside_results(examples: DataFrame, results: DataFrame) -> DataFrame:
    """Examples with each chunk of their reference's result, by ``gold_key``; those without a result are left out.

    The chunks are the side that is walked: a chunk comes out once for each of its examples in a row, so a writer that
    encodes repeated values keeps its text once and not once per example.
    """
    return results.hint("merge").join(examples, "gold_key")


def attach_gold(candidates: DataFrame, cache: DataFrame, run_db: Column | None = None) -> DataFrame:
    """Candidates with the cached result of their reference SQL, by database and text; a row per chunk."""
    keyed = candidates.withColumn(
        "gold_key", C.text_key(F.col("db_id") if run_db is None else run_db, F.col("gold_sql"))
    )
    known = kept(
        cache.select(F.col("key").alias("gold_key"), F.col("n_rows").alias("gold_rows"), "chunk", "gold_result"), "gold"
    )
    rest = keyed.join(known.select("gold_key").distinct(), "gold_key", "left_anti")
    return beside_results(keyed, known).unionByName(rest, allowMissingColumns=True)


# --- leak checks ------------------------------------------------------------------------------------


def split_leak_db(examples: DataFrame) -> DataFrame:
    """Databases that appear in more than one split, with the splits; one aggregate, no join."""
    return (
        examples.groupBy("db_id")
        .agg(F.sort_array(F.collect_set("split")).alias("splits"), F.count(F.lit(1)).alias("n"))
        .where(F.size("splits") > 1)
        .select("db_id", F.array_join("splits", ",").alias("splits"), "n")
    )


def question_key(question: Column) -> Column:
    """Question without case, punctuation of spacing and outer blanks."""
    return F.lower(X.strip(F.regexp_replace(question, r"[ \t\n\r\f\x0B]+", " ")))


def split_leak_question(examples: DataFrame, train: str = "train", held_out: str = "dev") -> DataFrame:
    """Held-out rows whose question also occurs in train."""
    # Digests travel, not texts of any length.
    keyed = examples.select("idx", "split", "db_id", F.sha2(question_key(F.col("question")), 256).alias("q"))
    seen = keyed.where(F.col("split") == train).select("q").distinct()
    return keyed.where(F.col("split") == held_out).join(seen, "q", "left_semi").select("idx", "db_id")
