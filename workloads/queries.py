"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.functions import fixed
from sqltally.functions import text as X
from sqltally.operators import candidates as C
from sqltally.operators import compare, corpus, evaluate, failures, monitor, reports, rewards
from sqltally.plans import loading, scoring
from sqltally.session import work_dir
from sqltally.sources import schemas, splits
from sqltally.streaming import rewards as stream
from sqltally.streaming import scoring as stream_scoring

from .fixtures import FIXTURES, RUNAWAY, fixture, table, warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATA_DIR = "/data/corpus"
TIME_LIMIT = 60.0  # of one candidate in the jobs below, generous for a cold start
SHORT_LIMIT = 5.0  # where running out of time is the point
METHODS = ["zero_shot", "few_shot", "tuned"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def sandbox(spark: SparkSession, sf: str, time_limit: float = TIME_LIMIT) -> C.Sandbox:
    return C.Sandbox(spark, warehouse(sf), time_limit=time_limit)


def scored(spark: SparkSession, sf: str, match: bool = True) -> DataFrame:
    return scoring.score_completions(sandbox(spark, sf), fixture(spark, sf, "completions"), match)


def failed(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("correct", F.col("matched"))
    return failures.failures_only(rows).withColumn("method", F.concat(F.lit("gen"), F.col("gen").cast("string")))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.judge_corpus(sandbox(spark, sf), fixture(spark, sf, "examples"), "warehouse")


def schema_texts(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.schema_text(fixture(spark, sf, "statements"))


def write_json_arrays(rows: DataFrame, order: str, columns: list[str], path: str, per_file: int = 512) -> None:
    """JSON-array part files of a few hundred rows each."""
    listed = F.sort_array(F.collect_list(F.struct(order, F.struct(*columns).alias("row"))))
    chunk = F.lpad(F.floor(F.col(order) / per_file).cast("string"), 12, "0")
    (
        rows.groupBy(chunk.alias("chunk"))
        .agg(F.to_json(F.transform(listed, lambda r: r["row"])).alias("value"))
        .write.partitionBy("chunk")
        .text(path)
    )


# --- sources and sinks ----------------------------------------------------------------------------


def raw_examples(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "examples").withColumnRenamed("gold_sql", "query")


SPLIT_COLUMNS = ["db_id", "question", "query"]


@query
def read_split(spark, sf):
    folder = work_dir(spark, "split")
    dev = raw_examples(spark, sf).where("split = 'dev'")
    write_json_arrays(dev, "idx", SPLIT_COLUMNS, f"{folder}/dev.json")
    return splits.read_split(spark, "dev", folder).select("idx", "db_id", "question", "gold_sql", "split")


@query
def read_split_others(spark, sf):
    folder = work_dir(spark, "split")
    train = raw_examples(spark, sf).where("split = 'train'")
    write_json_arrays(train.where("idx % 3 > 0"), "idx", SPLIT_COLUMNS, f"{folder}/train.json")
    write_json_arrays(train.where("idx % 3 = 0"), "idx", SPLIT_COLUMNS, f"{folder}/train_others.json")
    return splits.read_split(spark, "train", folder).select("idx", "part", "db_id", "question", "gold_sql")


@query
def read_schema_text(spark, sf):
    return schema_texts(spark, sf)


@query
def parse_schema_file(spark, sf):
    script = fixture(spark, sf, "scripts")
    lines = script.select("db_id", "doc_id", F.posexplode(F.split("script", "\n")).alias("pos", "line")).select(
        "db_id", (F.col("doc_id") * 1000000 + F.col("pos")).alias("line_no"), "line"
    )
    return schemas.parse_schema_script(lines)


@query
def schema_text_or_script(spark, sf):
    # Each database has statements, rows of metadata or a script only.
    kind = F.ascii(F.right("db_id", F.lit(1))) % 3
    written = fixture(spark, sf, "statements").where(kind == 0).select("db_id", "ord", "ddl")
    listed = schemas.statements_of_columns(fixture(spark, sf, "columns_of").where(kind == 1))
    script = fixture(spark, sf, "scripts")
    lines = script.select("db_id", "doc_id", F.posexplode(F.split("script", "\n")).alias("pos", "line")).select(
        "db_id", (F.col("doc_id") * 1000000 + F.col("pos")).alias("line_no"), "line"
    )
    return schemas.schema_text_or_script(written.unionByName(listed), lines)


@query
def read_filtered_or_raw(spark, sf):
    folder = work_dir(spark, "corpus")
    train = raw_examples(spark, sf).where("split = 'train'")
    write_json_arrays(train, "idx", SPLIT_COLUMNS, f"{folder}/train.json")
    splits.write_filtered(fixture(spark, sf, "examples"), f"{folder}/filtered")
    columns = ["idx", "db_id", "question", "gold_sql", "split"]
    present = splits.read_filtered_or_raw(spark, f"{folder}/filtered", folder).select(F.lit("filtered").alias("found"), *columns)
    absent = splits.read_filtered_or_raw(spark, f"{folder}/nothing", folder).select(F.lit("raw").alias("found"), *columns)
    return splits.append_rows(present, absent)


@query
def read_predictions(spark, sf):
    folder = work_dir(spark, "predictions")
    preds = fixture(spark, sf, "predictions").select(
        F.col("idx").alias("index"), F.col("method").alias("db_id"), "difficulty", "correct"
    )
    columns = ["index", "db_id", "difficulty", "correct"]
    write_json_arrays(preds.where("db_id <> 'tuned'"), "index", columns, f"{folder}/lists", 4096)
    chunk = F.floor(F.col("index") / 4096)
    (
        preds.where("db_id = 'tuned'")
        .groupBy(F.lpad(chunk.cast("string"), 12, "0").alias("chunk"))
        .agg(F.to_json(F.struct(F.lit("m").alias("model"), F.collect_list(F.struct(*columns)).alias("predictions"))).alias("value"))
        .write.partitionBy("chunk")
        .text(f"{folder}/objects")
    )
    return splits.read_predictions(spark, folder).select(*columns)


@query
def write_filtered(spark, sf):
    path = work_dir(spark, "filtered")
    keep, _, results = scoring.filter_corpus(sandbox(spark, sf), fixture(spark, sf, "examples"), "warehouse")
    splits.write_filtered(keep, path, results)
    cached = spark.read.parquet(f"{path}-results").select("gold_key", "chunk", "gold_result")
    return corpus.beside_results(spark.read.parquet(path), cached).select(
        "idx", "db_id", "gold_sql", "split", "n_rows", "chunk", "gold_result"
    )


@query
def write_eval(spark, sf):
    path = work_dir(spark, "eval")
    preds = fixture(spark, sf, "predictions").withColumnRenamed("method", "mode")
    splits.write_eval(preds, evaluate.eval_summary(preds, ["split", "mode"]), path)
    return spark.read.parquet(f"{path}/summary").select("split", "mode", "total", "correct", "overall_ex")


@query
def cache_gold_result(spark, sf):
    cache, _ = scoring.cache_gold_results(sandbox(spark, sf), fixture(spark, sf, "examples"), "warehouse")
    return cache.select(F.col("sql").alias("gold_sql"), "n_rows", "chunk", "gold_result")


@query
def load_examples(spark, sf):
    folder = work_dir(spark, "load")
    train = raw_examples(spark, sf).where("split = 'train'")
    write_json_arrays(train, "idx", SPLIT_COLUMNS, f"{folder}/train.json")
    rows = loading.load_examples(spark, "train", folder, schema_texts(spark, sf))
    tail = F.element_at(F.split("db_path", "/"), -1)
    return rows.select("idx", "db_id", tail.alias("db_file"), "gold_sql", F.col("prompt")[1]["content"].alias("user_text"))


@query
def evaluate_run(spark, sf):
    rows = fixture(spark, sf, "completions").select(
        F.col("cid").alias("idx"), "db_id", F.lit("?").alias("question"), "gold_sql", F.col("text").alias("pred_sql"),
        F.concat(F.lit("gen"), F.col("gen").cast("string")).alias("mode"),
    )
    records, summary = loading.evaluate_run(sandbox(spark, sf), rows, fixture(spark, sf, "sql_structs"), ["mode"])
    path = work_dir(spark, "run")
    splits.write_eval(records.withColumn("split", F.lit("dev")), summary.withColumn("split", F.lit("dev")), path)
    written = spark.read.parquet(f"{path}/predictions")
    totals = spark.read.parquet(f"{path}/summary").select("mode", F.col("correct").alias("right"))
    return written.join(totals, "mode").select(
        "idx", "mode", "correct", "difficulty", F.col("pred_error").isNotNull().alias("failed"), "right"
    )


# --- projections and filters ------------------------------------------------------------------------


@query
def completion_text(spark, sf):
    return corpus.conversation_text(table(spark, sf, "conversations"))


@query
def extract_sql(spark, sf):
    return fixture(spark, sf, "completions").select("cid", X.extract_sql(F.col("text")).alias("pred_sql"))


@query
def syntax_valid(spark, sf):
    return fixture(spark, sf, "completions").select("cid", X.syntax_valid(F.col("text")).alias("syntax"))


@query
def format_compliance(spark, sf):
    return fixture(spark, sf, "completions").select("cid", X.format_compliance(F.col("text")).alias("format"))


@query
def identifier_set(spark, sf):
    names = F.array_join(F.array_sort(X.identifier_set(F.col("text"))), " ")
    return fixture(spark, sf, "completions").select("cid", names.alias("identifiers"))


@query
def schema_f1(spark, sf):
    f1 = X.schema_f1(X.extract_sql(F.col("text")), F.col("gold_sql"))
    return fixture(spark, sf, "completions").select("cid", F.round(f1, 9).alias("schema_f1"))


@query
def normalise_value(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 8).alias("price"),
        F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n")).alias("priority"),
        (F.col("o_totalprice") > 100000).alias("large"),
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
    )
    kinds = {f.name: f.dataType for f in orders.schema.fields}
    return orders.select("o_orderkey", *[X.normalise_value(n, kinds[n]).alias(n) for n in kinds if n != "o_orderkey"],
                         X.normalise_value("o_orderkey", kinds["o_orderkey"]).alias("key_text"))


def prompted(spark, sf):
    examples = corpus.attach_schema(fixture(spark, sf, "examples"), schema_texts(spark, sf))
    return examples.withColumn("prompt", X.prompt_messages(F.col("question"), F.col("schema_text")))


@query
def prompt_messages(spark, sf):
    p = F.col("prompt")
    return prompted(spark, sf).select(
        "idx", F.size(p).cast("bigint").alias("n"), p[0]["role"].alias("role0"), p[0]["content"].alias("system_text"),
        p[1]["role"].alias("role1"), p[1]["content"].alias("user_text"),
    )


@query
def sft_messages(spark, sf):
    m = X.sft_messages(F.col("prompt"), F.col("gold_sql"))
    return prompted(spark, sf).select("idx", m.alias("m")).select(
        "idx",
        F.array_join(F.transform("m", lambda x: x["role"]), " ").alias("roles"),
        F.element_at("m", -1)["content"].alias("answer"),
    )


def located(spark, sf):
    return fixture(spark, sf, "examples").withColumn("db_path", X.split_path(DATA_DIR, F.col("split"), F.col("db_id")))


@query
def program_examples(spark, sf):
    return corpus.program_examples(corpus.attach_schema(located(spark, sf), schema_texts(spark, sf)))


@query
def split_path(spark, sf):
    preds = fixture(spark, sf, "predictions").select("method", "idx", "split")
    return preds.withColumn("db_path", X.split_path(DATA_DIR, F.col("split"), F.col("method")))


@query
def keep_runnable(spark, sf):
    return corpus.keep_runnable(judged(spark, sf)).select("idx", "db_id", "n_rows")


@query
def drop_reason(spark, sf):
    rows = judged(spark, sf).withColumn("reason", corpus.drop_reason())
    return rows.where("reason IS NOT NULL").select("idx", "reason")


@query
def failures_only(spark, sf):
    return failures.failures_only(fixture(spark, sf, "predictions")).select("method", "idx")


@query
def difficulty(spark, sf):
    return fixture(spark, sf, "sql_structs").select("idx", X.difficulty(F.col("sql")).alias("difficulty"))


@query
def failure_class(spark, sf):
    return failed(spark, sf).select("cid", failures.failure_class().alias("category"))


@query
def failure_class3(spark, sf):
    return failed(spark, sf).select("cid", failures.failure_class3().alias("category"))


# --- candidate execution ----------------------------------------------------------------------------


@query
def run_candidates(spark, sf):
    texts = fixture(spark, sf, "completions").select("db_id", X.extract_sql(F.col("text")).alias("sql"))
    return C.run_candidates(sandbox(spark, sf), texts).select("sql", "status", "n_rows")


@query
def guard_readonly(spark, sf):
    box = sandbox(spark, sf)
    rows = fixture(spark, sf, "hostile").withColumn("sql", X.strip(F.substring_index("sql", ";", 1)))
    return C.outcome_table(rows, C.run_candidates(box, rows)).select("cid", "status", "n_rows")


@query
def time_limit(spark, sf):
    rows = fixture(spark, sf, "mixed_speed")
    outcomes = C.run_candidates(sandbox(spark, sf, SHORT_LIMIT), rows)
    return C.outcome_table(rows, outcomes).select("cid", "status", "error", "n_rows")


@query
def outcome_table(spark, sf):
    return scored(spark, sf, match=False).select("cid", "status", "n_rows")


# --- joins --------------------------------------------------------------------------------------------


@query
def attach_schema(spark, sf):
    return corpus.attach_schema(fixture(spark, sf, "examples"), schema_texts(spark, sf)).select("idx", "db_id", "schema_text")


@query
def attach_difficulty(spark, sf):
    raw = fixture(spark, sf, "sql_structs")
    preds = fixture(spark, sf, "predictions").drop("difficulty")
    return evaluate.attach_difficulty(preds, raw).select("method", "idx", "difficulty")


@query
def attach_gold(spark, sf):
    examples = fixture(spark, sf, "examples")
    cache, _ = scoring.cache_gold_results(sandbox(spark, sf), examples, "warehouse")
    return corpus.attach_gold(examples, cache, F.lit("warehouse")).select("idx", "gold_rows", "chunk", "gold_result")


def fewshot_inputs(spark, sf):
    rows = fixture(spark, sf, "fewshot")
    return rows.where("split = 'dev'"), rows.where("split = 'train'")


@query
def fewshot_demos(spark, sf):
    rows = fixture(spark, sf, "fewshot")
    demos = corpus.fewshot_demos(rows, rows.where("split = 'train'"), 5)
    return demos.select("db_id", F.posexplode("demos").alias("rk", "d")).select(
        "db_id", F.col("rk").cast("bigint").alias("rk"), F.col("d.idx").alias("demo_idx"), F.col("d.db_id").alias("demo_db")
    )


@query
def fewshot_prompt(spark, sf):
    dev, train = fewshot_inputs(spark, sf)
    prompts = corpus.fewshot_prompt(dev, schema_texts(spark, sf), train, 3)
    return prompts.select("idx", F.col("prompt")[1]["content"].alias("user_text"))


@query
def split_leak_db(spark, sf):
    return corpus.split_leak_db(fixture(spark, sf, "fewshot"))


@query
def split_leak_question(spark, sf):
    return corpus.split_leak_question(fixture(spark, sf, "examples"))


@query
def discordant_methods(spark, sf):
    return reports.discordant_methods(fixture(spark, sf, "predictions"), "few_shot", "tuned")


# --- aggregations -------------------------------------------------------------------------------------


@query
def result_match(spark, sf):
    gold, pred = fixture(spark, sf, "gold_rows"), fixture(spark, sf, "pred_rows")
    examples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ex"))
    return compare.result_match(examples, gold, pred, "ex", ["a", "b"])


@query
def execution_accuracy(spark, sf):
    rows = scored(spark, sf)
    return rows.select("cid", rewards.execution_score(rows).alias("execution"))


@query
def execution_accuracy_cached(spark, sf):
    # Reference results come from the cache; some of their texts are cut short, and those references run again.
    box, rows = sandbox(spark, sf), fixture(spark, sf, "completions")
    cache, _ = scoring.cache_gold_results(box, rows)
    cut = F.when(F.pmod(F.xxhash64("key"), F.lit(7)) == 0, F.left("gold_result", F.lit(5))).otherwise(F.col("gold_result"))
    found = scoring.score_completions(box, rows, cache=cache.withColumn("gold_result", cut))
    return found.select("cid", rewards.execution_score(found).alias("execution"))


@query
def execution_accuracy_large(spark, sf):
    # Results too large for hashes per row that look alike are compared by their rows.
    found = scoring.score_completions(sandbox(spark, sf), fixture(spark, sf, "large_results"))
    return found.select("cid", "gold_rows", rewards.execution_score(found).alias("execution"))


@query
def execution_success(spark, sf):
    rows = scored(spark, sf, match=False)
    return rows.select("cid", rewards.success_score(rows).alias("success"))


@query
def reward_phase1(spark, sf):
    return rewards.reward_phase1(scored(spark, sf)).select("cid", F.round("reward", 6).alias("reward"))


@query
def reward_phase2(spark, sf):
    return rewards.reward_phase2(scored(spark, sf)).select(
        "cid", *fixed.PHASE2_WEIGHTS, F.round("reward", 6).alias("reward")
    ).withColumn("schema_f1", F.round("schema_f1", 9))


@F.pandas_udf(T.DoubleType())
def brevity(text: pd.Series) -> pd.Series:
    return 1.0 / (1.0 + text.str.len())


@query
def reward_custom_component(spark, sf):
    # A component in Arrow batches beside built-in ones.
    rows = fixture(spark, sf, "completions").withColumn("pred_sql", X.extract_sql(F.col("text")))
    parts = rewards.components({"syntax": 0.2, "schema_f1": 0.2}) + [rewards.Component("brevity", 2.0, lambda df: brevity(F.col("text")))]
    found = rewards.with_reward(rows, parts)
    return found.select("cid", "syntax", F.round("brevity", 9).alias("brevity"), F.round("reward", 6).alias("reward"))


@query
def score_messages(spark, sf):
    # Completions as arrays of messages, scored from end to end.
    listed = F.sort_array(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("message"))))
    asked = F.concat(F.lit("SELECT r_name FROM region WHERE r_regionkey = "), (F.col("conv_id") % 5).cast("string"))
    rows = fixture(spark, sf, "chats").groupBy("conv_id").agg(F.transform(listed, lambda t: t["message"]).alias("text")).select(
        F.col("conv_id").alias("cid"), F.col("conv_id").alias("prompt_id"), F.lit("warehouse").alias("db_id"), asked.alias("gold_sql"), "text"
    )
    found = scoring.score_completions(sandbox(spark, sf), rows)
    return found.select(
        "cid", F.length("text").cast("bigint").alias("chars"), rewards.execution_score(found).alias("execution"),
        rewards.success_score(found).alias("success"),
    )


@query
def reward_weighted_long(spark, sf):
    total = rewards.reward_weighted_long(fixture(spark, sf, "reward_log"), fixed.PHASE2_WEIGHTS, "user_id")
    return total.select("user_id", F.round("reward", 4).alias("reward"), "unweighted")


@query
def filter_report(spark, sf):
    return corpus.filter_report(judged(spark, sf))


@query
def ex_overall(spark, sf):
    return evaluate.ex_overall(fixture(spark, sf, "predictions"), ["method"])


@query
def ex_by_difficulty(spark, sf):
    return evaluate.ex_by_difficulty(fixture(spark, sf, "predictions"), ["method"])


@query
def eval_summary(spark, sf):
    rows = evaluate.eval_summary(fixture(spark, sf, "predictions"), ["method"])
    return rows.select("method", "total", "correct", "overall_ex", *[F.col("by_difficulty")[t].alias(t) for t in fixed.TIERS])


@query
def failure_counts(spark, sf):
    return failures.failure_counts(failed(spark, sf)).drop("ord").withColumn("pct", F.round("pct", 6))


@query
def method_by_difficulty(spark, sf):
    return reports.method_by_difficulty(fixture(spark, sf, "predictions"), METHODS)


@query
def method_delta(spark, sf):
    rows = reports.method_delta(fixture(spark, sf, "predictions"), "zero_shot")
    return rows.withColumns({"ex": F.round("ex", 9), "delta": F.round("delta", 9)})


@query
def failure_share3(spark, sf):
    return failures.failure_share3(failed(spark, sf)).drop("ord").withColumn("pct", F.round("pct", 6))


@query
def devset_accuracy(spark, sf):
    scores = fixture(spark, sf, "predictions").withColumn("score", F.col("correct").cast("double"))
    return evaluate.devset_accuracy(scores, ["method"])


@query
def exact_vs_execution(spark, sf):
    return evaluate.exact_vs_execution(scored(spark, sf), ["gen"])


@query
def accuracy_ci(spark, sf):
    rows = evaluate.accuracy_ci(fixture(spark, sf, "predictions"), ["method", "difficulty"])
    return rows.withColumn("half_width", F.round("half_width", 9))


@query
def condition_table(spark, sf):
    return evaluate.condition_table(fixture(spark, sf, "predictions"), ["dev", "test"])


@query
def category_by_method(spark, sf):
    return failures.category_by_method(failed(spark, sf), "gen4")


@query
def metric_by_setting(spark, sf):
    return evaluate.metric_by_setting(fixture(spark, sf, "predictions"), ["method", "split"])


@query
def threshold_gate(spark, sf):
    return evaluate.threshold_gate(fixture(spark, sf, "predictions"), ["method", "difficulty", "step"])


# --- windows and samples ------------------------------------------------------------------------------


@query
def running_ex(spark, sf):
    return evaluate.running_ex(fixture(spark, sf, "predictions"), ["method"])


@query
def top_failures(spark, sf):
    asked = failed(spark, sf).withColumn("question", F.concat(F.lit("Prompt "), F.col("prompt_id").cast("string")))
    return failures.top_failures(asked).withColumn("rk", F.col("rk").cast("bigint"))


@query
def group_advantage(spark, sf):
    rows = rewards.group_advantage(rewards.reward_phase1(scored(spark, sf)))
    return rows.select("cid", "prompt_id", F.round("advantage", 6).alias("advantage"))


@query
def no_signal_groups(spark, sf):
    rows = rewards.reward_phase1(scored(spark, sf))
    return rewards.no_signal_groups(rows, "gen").withColumn("reward", F.round("reward", 6))


@query
def stratified_sample(spark, sf):
    failed_rows = failures.failures_only(fixture(spark, sf, "predictions"))
    return reports.stratified_sample(failed_rows, 50, by=["method"]).select("method", "difficulty", "idx", F.col("rk").cast("bigint").alias("rk"))


@query
def mixed_batches(spark, sf):
    rows = fixture(spark, sf, "predictions")
    return reports.mixed_batches(rows, 32, by=["method"]).select("method", "idx", "difficulty", "batch")


@query
def converged(spark, sf):
    points = evaluate.ex_overall(fixture(spark, sf, "predictions"), ["method", "step"])
    rows = evaluate.converged(points, "method", "step")
    return rows.select("method", "step", "ex", "converged")


@query
def reward_by_step(spark, sf):
    rows = monitor.reward_by_step(fixture(spark, sf, "reward_log"))
    return rows.withColumns({"mean": F.round("mean", 6), "share": F.round("share", 6)})


@query
def reward_saturation(spark, sf):
    rows = monitor.reward_saturation(fixture(spark, sf, "reward_log"), threshold=50.0)
    return rows.select("run", "logged", "flagged", *[F.round(c, 6).alias(c) for c in ("watched_mean", "goal_mean", "previous_goal")])


# --- sorts, limits, set operations ----------------------------------------------------------------------


@query
def head_rows(spark, sf):
    return corpus.head_rows(fixture(spark, sf, "examples"), 10).select("idx", "db_id", "gold_sql")


@query
def positional_split(spark, sf):
    return corpus.positional_split(fixture(spark, sf, "examples")).select("idx", "part")


@query
def ordered_categories(spark, sf):
    counted = failures.category_counts(failed(spark, sf).select(failures.failure_class().alias("category")), fixed.FAILURE_CATEGORIES)
    return failures.ordered_categories(counted).select("category", "n")


@query
def append_rows(spark, sf):
    rows = fixture(spark, sf, "examples").select("idx", "db_id", "split")
    return splits.append_rows(rows.where("split = 'dev'"), rows.where("split = 'train'"))


@query
def identifier_diff(spark, sf):
    rows = scoring.with_keys(fixture(spark, sf, "completions"))
    return failures.identifier_diff(rows).select(
        "cid",
        F.array_join(F.array_sort("missing"), " ").alias("missing"),
        F.array_join(F.array_sort("extra"), " ").alias("extra"),
    )


@query
def identifier_overlap(spark, sf):
    both = failures.identifier_overlap(X.extract_sql(F.col("text")), F.col("gold_sql"))
    return fixture(spark, sf, "completions").select("cid", F.array_join(F.array_sort(both), " ").alias("shared"))


@query
def rows_minus(spark, sf):
    gold, pred = fixture(spark, sf, "gold_rows"), fixture(spark, sf, "pred_rows")
    return splits.append_rows(
        compare.rows_minus(gold, pred).withColumn("side", F.lit("gold")),
        compare.rows_minus(pred, gold).withColumn("side", F.lit("pred")),
    )


# --- SQL constructs of executed queries -------------------------------------------------------------------

CONSTRUCTS = {
    "q_where": """
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
        WHERE (o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority LIKE '%H%')
           OR (o_orderstatus IN ('P') AND o_custkey < 50 AND o_orderpriority IS NOT NULL)""",
    "q_inner_join": """
        SELECT T1.c_name, T2.o_orderkey, T3.n_name FROM customer AS T1
        JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey JOIN nation AS T3 ON T1.c_nationkey = T3.n_nationkey
        WHERE T3.n_regionkey = 1""",
    "q_outer_join": """
        SELECT c.c_custkey, o.o_orderkey FROM customer c
        LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'""",
    "q_group": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
          MIN(l_shipdate) AS first_ship, MAX(l_extendedprice) AS top_price, ROUND(AVG(l_discount), 6) AS avg_discount
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "q_having": """
        SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12""",
    "q_distinct": """
        SELECT c_mktsegment, COUNT(DISTINCT c_nationkey) AS nations FROM (SELECT DISTINCT c_mktsegment, c_nationkey
        FROM customer) d GROUP BY c_mktsegment""",
    "q_order_limit": """
        SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
    "q_union": """
        SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier""",
    "q_intersect": """
        SELECT l_partkey AS partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25""",
    "q_except": """
        SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""",
    "q_in_subquery": """
        SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
        AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "q_exists": """
        SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l
        WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)""",
    "q_scalar_subquery": """
        SELECT p_partkey, p_size FROM part WHERE p_size > (SELECT AVG(p_size) FROM part)
        AND p_retailprice = (SELECT MAX(q.p_retailprice) FROM part q WHERE q.p_size = part.p_size)""",
    "q_case": """
        SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band,
          COUNT(*) AS n FROM orders GROUP BY 1""",
}


# Rows that a construct returns are a table's worth, so each is run over the whole tables.
def construct(name: str) -> Query:
    """The construct as a candidate: screened, then its comparable rows, with positions where it is ordered."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        box = sandbox(spark, sf)
        text = table(spark, sf, "region").limit(1).select(F.lit("warehouse").alias("db_id"), F.lit(CONSTRUCTS[name]).alias("sql"))
        outcomes = C.run_candidates(box, text)
        rows = C.dense_positions(C.result_rows(box, outcomes.where("status = 'ok'")))
        counted = rows.join(outcomes.select("key", "n_rows"), "key")
        place = F.col("pos") if name == "q_order_limit" else F.lit(None).cast("bigint")
        return counted.select("n_rows", place.alias("pos"), F.array_join("r", "|").alias("row"))

    run.__name__ = name
    return run


for _name in CONSTRUCTS:
    query(construct(_name))


@query
def q_cross_runaway(spark, sf):
    texts = table(spark, sf, "nation").select(F.lit("warehouse").alias("db_id"), F.lit(RUNAWAY).alias("sql"))
    return C.run_candidates(sandbox(spark, sf, SHORT_LIMIT), texts).select("status", "error")


# --- stream -----------------------------------------------------------------------------------------------


def streamed_log(events: DataFrame) -> DataFrame:
    return events.select(
        (F.col("user_id") % 3).alias("run"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("component")
    )


def shown_windows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query
def reward_by_step_stream(spark, sf):
    events = table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    return shown_windows(stream.reward_by_step_stream(streamed_log(source), "6 hours", "10 minutes"))


@query
def reward_stream_resumed(spark, sf):
    # The log comes in two parts; the second run goes on with the state and the windows of the first.
    events = table(spark, sf, "events")
    folder, half = work_dir(spark, "log"), events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        events.where(part).write.mode("append").parquet(f"{folder}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        rows = stream.reward_by_step_stream(streamed_log(source), "6 hours", "10 minutes", f"{folder}/out", f"{folder}/state")
    return shown_windows(rows)


@query
def score_stream(spark, sf):
    orders = table(spark, sf, "orders")
    source = spark.readStream.schema(orders.schema).parquet(f"{sf}/orders*.parquet")
    folder = work_dir(spark, "scored")
    completions = spark.sql(FIXTURES["completions"], orders=source)
    rows = stream_scoring.score_stream(completions, ["cid"], f"{folder}/out", f"{folder}/state")
    return rows.withColumn("schema_f1", F.round("schema_f1", 9))
