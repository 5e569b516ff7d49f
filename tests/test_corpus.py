"""Filtering, caching, few-shot selection, leaks, evaluation and failures on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from sqltally.functions import fixed
from sqltally.operators import candidates as C
from sqltally.operators import corpus, evaluate, failures, monitor, reports, rewards
from sqltally.plans import scoring
from sqltally.streaming import rewards as stream


def test_drop_reasons(spark):
    judged = spark.createDataFrame(
        [(0, "ok", None, 3), (1, "empty", None, 0), (2, "timeout", "Timeout", None), (3, "error", "x Timeout y", None), (4, "error", "bad", None)],
        "idx int, status string, error string, n_rows int",
    )
    reasons = {r["idx"]: r["r"] for r in judged.select("idx", corpus.drop_reason().alias("r")).collect()}
    assert reasons == {0: None, 1: "empty_result", 2: "timeout", 3: "timeout", 4: "error"}
    assert [r["idx"] for r in corpus.keep_runnable(judged, remove_empty=False).collect()] == [0, 1]
    assert corpus.filter_report(judged).first().asDict() == {
        "original": 5, "kept": 1, "removed": 4, "empty_result": 1, "timeout": 2, "error": 1,
    }


def test_gold_cache(spark, staff):
    box = C.Sandbox(spark, staff, time_limit=60.0)
    texts = [
        "SELECT name, age, born FROM person ORDER BY person_id",
        "SELECT name FROM person WHERE age > 99",
        "SELECT nope FROM person",
        "SELECT 'a\"b\\\\c', true, 2.50",
    ]
    examples = spark.createDataFrame([(i, "staff", t) for i, t in enumerate(texts)], "idx int, db_id string, gold_sql string")
    cache, outcomes = scoring.cache_gold_results(box, examples)
    found = {r["sql"]: r["gold_result"] for r in cache.collect()}
    assert found[texts[0]] == '[["ann","63.5","ohio"],["bob","41.0","none"],["cid","66.0","iowa"],["dee","37.0","ohio"]]'
    assert found[texts[1]] == "[]"
    assert texts[2] not in found
    # What is read back from the texts equals what is executed.
    back = {(r["key"], r["at"]): r["r"] for r in corpus.cached_rows(cache).collect()}
    live = {(r["key"], r["at"]): r["r"] for r in C.result_rows(box, outcomes.where("status = 'ok'")).collect()}
    assert back == live
    assert len(back) == 5
    attached = corpus.attach_gold(examples, cache)
    assert {r["idx"]: r["gold_rows"] for r in attached.collect()} == {0: 4, 1: 0, 2: None, 3: 1}


def test_large_results_are_cached_whole(spark):
    """More rows than a chunk, decimals without a fraction and with more digits than a double, dates and NULL."""
    numbers = spark.range(12_000).selectExpr("id", "cast(id as decimal(20,2)) + 12345678901234567.12 AS d", "date '2020-01-01' AS day")
    box = C.Sandbox(spark, {"db": {"numbers": numbers}}, time_limit=60.0, small_rows=16)
    gold = ["SELECT id, d FROM numbers ORDER BY id", "SELECT CEIL(2.5)", "SELECT d, day, NULL FROM numbers"]
    rows = [
        (0, gold[0], "SELECT id, d FROM numbers ORDER BY d", True),
        (1, gold[0], "SELECT id, d FROM numbers ORDER BY id DESC", False),
        (2, gold[0], "SELECT id, d + 0.01 FROM numbers ORDER BY id", False),
        (3, gold[1], "SELECT CEIL(2.4)", True),
        (4, gold[2], "SELECT d, day, NULL FROM numbers ORDER BY id DESC", True),
        (5, gold[2], "SELECT CASE WHEN id = 7 THEN d + 0.01 ELSE d END, day, NULL FROM numbers", False),
    ]
    df = spark.createDataFrame(
        [(cid, 0, "db", g, t) for cid, g, t, _ in rows], "cid int, prompt_id int, db_id string, gold_sql string, text string"
    )
    cache, _ = scoring.cache_gold_results(box, df)
    assert cache.groupBy("key").agg(F.max("chunk").alias("last"), F.count(F.lit(1)).alias("n")).where("last + 1 <> n").count() == 0
    expected = {cid: match for cid, _, _, match in rows}
    for known in (None, cache, cache.where("chunk <> 3")):
        found = scoring.score_completions(box, df, cache=known)
        assert {r["cid"]: r["matched"] for r in found.collect()} == expected


def test_unusable_cache(spark):
    cached = spark.createDataFrame(
        [("a", 1, 0, '[["1","2.5"]]'), ("b", 1, 0, '[["1"'), ("c", 1, 0, "null"), ("d", 1, 0, None), ("e", 0, 0, "[]"),
         ("f", 1, 0, '{"k": "v"}'), ("g", 2, 0, '[["1"]]'), ("h", 2, 0, '[["1"]]'), ("h", 2, 1, '[["2"]]')],
        "key string, n_rows bigint, chunk bigint, gold_result string",
    )
    usable = corpus.usable_cache(cached)
    assert {r["key"] for r in usable.collect()} == {"a", "e", "h"}
    assert [(r["key"], r["part"], r["r"]) for r in corpus.cached_rows(usable).orderBy("key", "part").collect()] == [
        ("a", 0, ["1", "2.5"]), ("h", 0, ["1"]), ("h", 1, ["2"]),
    ]


def test_rows_without_a_reference_are_not_runnable(spark, staff):
    box = C.Sandbox(spark, staff, time_limit=60.0)
    examples = spark.createDataFrame(
        [(0, "staff", "SELECT 1"), (1, "staff", None), (2, "staff", ""), (3, None, "SELECT 1")], "idx int, db_id string, gold_sql string"
    )
    keep, report, results = scoring.filter_corpus(box, examples)
    assert [r["idx"] for r in keep.collect()] == [0]
    assert report.first().asDict() == {"original": 4, "kept": 1, "removed": 3, "empty_result": 0, "timeout": 0, "error": 3}
    assert [r["gold_result"] for r in results.collect()] == ['[["1"]]']
    df = spark.createDataFrame([(0, 0, "staff", None, "SELECT 1")], "cid int, prompt_id int, db_id string, gold_sql string, text string")
    scored = [scoring.score_completions(box, df, match).first() for match in (True, False)]
    assert [r["status"] for r in scored] == ["ok", "ok"]
    assert scored[0]["matched"] is False


@pytest.mark.parametrize("seed", range(4))
def test_fewshot_against_plain_python(spark, seed):
    rng = random.Random(seed)
    names = ["hot"] * 20 + [f"d{i}" for i in range(6)]
    train = [(i, rng.choice(names), f"q{i}", f"s{i}") for i in range(40)]
    targets = sorted({t[1] for t in train}) + ["unseen"]
    k = 4
    want = {db: [t[0] for t in sorted(train, key=lambda t: (t[1] != db, t[0]))[:k]] for db in targets}
    rows = spark.createDataFrame(train, "idx bigint, db_id string, question string, gold_sql string").repartition(5)
    dbs = spark.createDataFrame([(d,) for d in targets], "db_id string")
    found = {r["db_id"]: [d["idx"] for d in r["demos"]] for r in corpus.fewshot_demos(dbs, rows, k).collect()}
    assert found == want


def test_fewshot_prompt(spark):
    train = spark.createDataFrame([(0, "a", "q0", "s0"), (1, "b", "q1", "s1")], "idx bigint, db_id string, question string, gold_sql string")
    ask = spark.createDataFrame([(7, "b", "ask")], "idx bigint, db_id string, question string")
    schemas = spark.createDataFrame([("b", "DDL")], "db_id string, schema_text string")
    prompt = corpus.fewshot_prompt(ask, schemas, train, 2).first()["prompt"]
    assert prompt[1]["content"] == (
        "### Database Schema:\nDDL\n\n### Examples:\nQuestion: q1\nSQL: s1\n\nQuestion: q0\nSQL: s0\n\n"
        "### Question:\nask\n\n### SQL:"
    )


def test_conversation_text(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "assistant", "d"), (1, 2, "assistant", "c"), (2, 1, "system", "y"), (2, 0, "user", "x"), (3, 0, "assistant", None)],
        "conv_id int, turn int, role string, text string",
    )
    assert {r[0]: r[1] for r in corpus.conversation_text(turns).collect()} == {1: "d", 2: "x y", 3: ""}


def test_positional_split_and_head(spark):
    rows = spark.range(9).withColumnRenamed("id", "idx")
    assert [r["part"] for r in corpus.positional_split(rows).orderBy("idx").collect()] == ["train"] * 7 + ["dev"] * 2
    assert [r["idx"] for r in corpus.head_rows(rows, 3).collect()] == [0, 1, 2]


def failure(**values):
    return {"pred_sql": "", "gold_sql": "SELECT a FROM t", "error": None, "n_rows": 1, "gold_rows": 1, **values}


@pytest.mark.parametrize(
    "row, category",
    [
        (failure(pred_sql="nothing"), "syntax_error"),
        (failure(pred_sql=None), "syntax_error"),
        (failure(pred_sql="SELECT a FROM t", error="boom"), "execution_error"),
        (failure(pred_sql="SELECT a FROM u"), "wrong_table"),
        (failure(pred_sql="SELECT count(a) FROM t"), "wrong_aggregation"),
        # Substring tests: COUNT is found inside COUNTRY, MIN inside ADMIN.
        (failure(pred_sql="SELECT country FROM t", gold_sql="SELECT country FROM t WHERE 1"), "wrong_aggregation"),
        (failure(pred_sql="SELECT a FROM t ORDER BY a"), "wrong_order"),
        (failure(pred_sql="SELECT a FROM t WHERE a = 1"), "wrong_filter"),
        (failure(pred_sql="SELECT a FROM t JOIN t"), "wrong_join"),
        (failure(pred_sql="SELECT a FROM t WHERE a = 1", gold_sql="SELECT a FROM t WHERE a = 2", n_rows=0), "empty_result"),
        (failure(pred_sql="SELECT a FROM t WHERE a = 1", gold_sql="SELECT a FROM t WHERE a = 2"), "other"),
        # Both aggregate: order, filter and join are not looked at any more.
        (failure(pred_sql="SELECT max(a) FROM t ORDER BY a", gold_sql="SELECT max(a) FROM t"), "wrong_aggregation"),
    ],
)
def test_failure_class(spark, row, category):
    rows = spark.createDataFrame([row], "pred_sql string, gold_sql string, error string, n_rows int, gold_rows int")
    assert rows.select(failures.failure_class().alias("c")).first()["c"] == category


def test_no_failures_at_all(spark):
    rows = spark.createDataFrame([], "pred_sql string, gold_sql string, error string, n_rows int, gold_rows int")
    found = failures.failure_counts(rows).orderBy("ord").collect()
    assert [r["category"] for r in found] == fixed.FAILURE_CATEGORIES
    assert {(r["n"], r["pct"]) for r in found} == {(0, 0.0)}


def test_accuracy_of_nothing_and_gaps(spark):
    empty = spark.createDataFrame([], "idx bigint, difficulty string, correct boolean")
    assert evaluate.ex_overall(empty).first().asDict() == {"total": 0, "correct": 0, "ex": 0.0}
    rows = spark.createDataFrame([(i, "easy", [True, False, None][i % 3]) for i in range(20)], "idx bigint, difficulty string, correct boolean")
    assert failures.failures_only(rows).count() == 13
    curve = evaluate.running_ex(rows.withColumn("m", F.lit(1)), ["m"], batch=8).orderBy("batch").collect()
    assert [(r["processed"], r["solved"]) for r in curve] == [(8, 3), (16, 6), (20, 7)]


def test_advantage(spark):
    rows = spark.createDataFrame(
        [(1, 1.0), (1, 0.0), (1, 0.0), (1, 1.0), (1, 0.0), (1, 1.0), (2, 0.5), (2, 0.5), (3, 1.0)], "prompt_id int, reward double"
    )
    found = rewards.group_advantage(rows)
    assert {r["prompt_id"] for r in rewards.no_signal_groups(rows).collect()} == {2, 3}
    assert {round(r["advantage"], 3) for r in found.where("prompt_id = 1").collect()} == {0.913, -0.913}
    assert {r["advantage"] for r in found.where("prompt_id > 1").collect()} == {0.0}


def test_absent_method_is_zero(spark):
    rows = spark.createDataFrame([("a", "easy", True), ("a", "unknown", True)], "method string, difficulty string, correct boolean")
    found = {r["difficulty"]: (r["a"], r["b"]) for r in reports.method_by_difficulty(rows, ["a", "b"]).collect()}
    assert found == {"easy": (100.0, 0.0), "medium": (0.0, 0.0), "hard": (0.0, 0.0), "extra": (0.0, 0.0)}


def test_every_batch_mixes_tiers(spark):
    rows = spark.range(400).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 8 == 0, "hard").otherwise("easy").alias("difficulty")
    )
    mixed = reports.mixed_batches(rows, 16).groupBy("batch").agg(F.countDistinct("difficulty").alias("d"), F.count("*").alias("n"))
    assert {(r["d"], r["n"]) for r in mixed.collect()} == {(2, 16)}


def test_converged(spark):
    points = spark.createDataFrame([("a", i, x) for i, x in enumerate([0.5, 0.6, 0.605, 0.609, 0.7])], "run string, it int, ex double")
    found = [r["converged"] for r in evaluate.converged(points, "run", "it").orderBy("it").collect()]
    assert found == [False, False, False, True, False]


def test_saturation(spark):
    rows = [(0, s, "syntax", 1.0) for s in range(30)] + [(0, s, "execution", v) for s, v in ((0, 0.2), (10, 0.5), (20, 0.4))]
    log = spark.createDataFrame(rows, "run int, step int, component string, value double")
    found = monitor.reward_saturation(log, 0.9).orderBy("logged").collect()
    assert [r["flagged"] for r in found] == [False, False, True]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("component")
    )
    # Several files in time order, so the stream has several micro-batches' worth of input.
    for i, low in enumerate(range(0, 1000, 250)):
        spark.read.parquet(f"{sf}/events.parquet").where(f"event_id >= {low} AND event_id < {low + 250}").write.parquet(f"{tmp_path}/in/{i}")
    raw = spark.read.parquet(f"{sf}/events.parquet")
    live = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").select(
        F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("component")
    )
    found = {tuple(r)[:4]: r["mean"] for r in stream.reward_by_step_stream(live, "6 hours", "0 seconds").collect()}
    batch = {tuple(r)[:4]: r["mean"] for r in stream.windowed_means(events, "6 hours").collect()}
    assert set(found) == set(batch)
    assert all(found[k] == pytest.approx(batch[k]) for k in found)


def test_many_examples_of_one_reference_share_its_text_on_disk(spark, tmp_path):
    """A result of some chunks beside 3,000 examples: its texts are written about once, not once per example."""
    chunks = [("k", 1000, i, "".join(f"{(i + 1) * (j + 7) ** 5 % 99991:05d}" for j in range(1200))) for i in range(4)]
    cache = spark.createDataFrame(chunks, "sql string, n_rows bigint, chunk bigint, gold_result string").withColumn("db_id", F.lit("w"))
    cache = cache.withColumn("key", C.text_key(F.col("db_id"), F.col("sql")))
    rows = spark.range(3002).select("id", F.lit("w").alias("db_id"), F.when(F.col("id") < 3000, "k").otherwise("absent").alias("gold_sql"))
    found = corpus.attach_gold(rows, cache)
    found.write.parquet(str(tmp_path / "out"))
    written = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    assert written.where("gold_sql = 'k'").groupBy("gold_result").count().collect() and written.count() == 12_002
    assert {(r["chunk"], r["gold_result"]) for r in written.where("id = 17").collect()} == {(c[2], c[3]) for c in chunks}
    assert [r["chunk"] for r in written.where("id = 3001").collect()] == [None]
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1_000_000
