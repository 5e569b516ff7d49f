"""Candidate execution and comparison on a small database."""

import threading
import time

import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from sqltally.operators import candidates as C
from sqltally.operators import compare, rewards
from sqltally.plans import scoring


@pytest.fixture(scope="module")
def box(spark, staff):
    box = C.Sandbox(spark, staff, time_limit=60.0)
    yield box
    box.close()


def run(box, *texts):
    rows = box.spark.createDataFrame([("staff", t) for t in texts], "db_id string, sql string")
    return {r["sql"]: r for r in C.run_candidates(box, rows).collect()}


def score(box, *pairs):
    rows = box.spark.createDataFrame(
        [(i, 0, "staff", g, t) for i, (g, t) in enumerate(pairs)],
        "cid int, prompt_id int, db_id string, gold_sql string, text string",
    )
    return {r["cid"]: r for r in scoring.score_completions(box, rows).collect()}


def test_outcomes(box):
    found = run(
        box,
        "SELECT count(*) FROM person",
        "SELECT name FROM person WHERE age > 1000",
        "SELECT * FROM nonexistent",
        "SELEKT * FROM person",
        "  ",
        "SELECT name FROM person -- trailing comment",
        "WITH h AS (SELECT * FROM person) SELECT h.name, h.name FROM h",
    )
    assert {sql: (r["status"], r["n_rows"]) for sql, r in found.items()} == {
        "SELECT count(*) FROM person": ("ok", 1),
        "SELECT name FROM person WHERE age > 1000": ("empty", 0),
        "SELECT * FROM nonexistent": ("error", None),
        "SELEKT * FROM person": ("error", None),
        "  ": ("error", None),
        "SELECT name FROM person -- trailing comment": ("ok", 4),
        "WITH h AS (SELECT * FROM person) SELECT h.name, h.name FROM h": ("ok", 4),
    }
    assert found["  "]["error"] == "Empty SQL"


def test_prose_and_relations_are_no_queries(box, monkeypatch):
    """They are errors that never reach the driver; whatever may begin a query does."""
    seen, analyse = [], C._analyse
    monkeypatch.setattr(C, "_analyse", lambda box, rows, *more: seen.extend(r["sql"] for r in rows) or analyse(box, rows, *more))
    none = ["person", "person p JOIN team t ON true", "(person)", "The answer is 4, sorted by name.", "Selected rows: SELECT 1", "range(3)", " \t"]
    some = [
        "TABLE person", "VALUES (1), (2)", "FROM person SELECT name", "((SELECT name FROM person) UNION ALL (SELECT name FROM team))",
        "/* all */ SELECT * FROM person", "-- all\nselect * FROM person", "\u00a0 WITH p AS (SELECT 1) TABLE p", "SELECT*FROM person", "select'a'",
        "SELECT.5", "\u017felect 1", "(VALUES(1))", "FROM`person`",
    ]
    prose = "With this the answer is 4"
    found = run(box, *none, *some, prose)
    assert {t: found[t]["error"] for t in none} == {t: "Empty SQL" if t == " \t" else "Not a query" for t in none}
    assert {t: found[t]["status"] for t in none} == dict.fromkeys(none, "error")
    assert {t: found[t]["status"] for t in some} == dict.fromkeys(some, "ok")
    assert found[prose]["status"] == "error" and found[prose]["error"] != "Not a query"
    assert sorted(seen) == sorted([*some, prose])
    with pytest.raises(ValueError, match="Not a query"):
        box.plan("staff", "person")


def test_nothing_but_queries(box, tmp_path):
    hostile = [
        "DROP VIEW person",
        "DELETE FROM person",
        "INSERT INTO person VALUES (9, 'x', 1.0, 'y')",
        "CREATE TABLE t AS SELECT 1",
        "SET spark.sql.ansi.enabled=true",
        f"SELECT * FROM parquet.`{tmp_path}`",
        "SELECT reflect('java.lang.System', 'lineSeparator')",
        "SELECT `java_method` ('java.lang.System', 'lineSeparator')",
        "SELECT 1) DROP VIEW person",
    ]
    assert {r["status"] for r in run(box, *hostile).values()} == {"error"}
    assert run(box, "SELECT * FROM person")["SELECT * FROM person"]["n_rows"] == 4


def test_unknown_database(box):
    rows = box.spark.createDataFrame([("other", "SELECT 1")], "db_id string, sql string")
    assert C.run_candidates(box, rows).first()["status"] == "error"


def test_caller_settings_stay(spark, box):
    before = spark.conf.get("spark.sql.ansi.enabled")
    # A text compared with a number is NULL in the sandbox, an error under the default mode.
    assert run(box, "SELECT 'abc' = 1")["SELECT 'abc' = 1"]["status"] == "ok"
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_runtime_error_does_not_spoil_its_batch(box):
    found = run(box, "SELECT raise_error(name) FROM person", "SELECT name FROM person", "SELECT age FROM person")
    assert [found[t]["status"] for t in sorted(found)] == ["ok", "ok", "error"]


def test_time_limit(spark, sf):
    tables = {"w": {"lineitem": f"{sf}/lineitem.parquet", "region": f"{sf}/region.parquet"}}
    slow = "SELECT count(*) FROM lineitem a, lineitem b, lineitem c WHERE a.l_tax + b.l_tax * c.l_tax > 3"
    box = C.Sandbox(spark, tables, time_limit=4.0)
    texts = spark.createDataFrame([("w", slow), ("w", "SELECT * FROM region")], "db_id string, sql string")
    start = time.time()
    found = {r["sql"]: r for r in C.run_candidates(box, texts).collect()}
    assert time.time() - start < 40
    assert (found[slow]["status"], found[slow]["error"]) == ("timeout", "Timeout")
    assert found["SELECT * FROM region"]["status"] == "ok"


def test_many_late_texts_use_up_their_time_together(spark, sf):
    """Sixteen texts without end, one in each batch: about two limits in all, and their neighbours end as ever."""
    tables = {"w": {"region": f"{sf}/region.parquet"}}
    slow = "SELECT count(*) FROM range(0, 100000000000000, 1, 1) WHERE id % 7 = {}"
    box = C.Sandbox(spark, tables, time_limit=6.0, batch_size=2, parallel_batches=32)
    texts = [t for n in range(16) for t in (slow.format(n), f"SELECT r_name FROM region WHERE r_regionkey <> {n}")]
    rows = spark.createDataFrame([("w", t) for t in texts], "db_id string, sql string").coalesce(1)
    start = time.time()
    found = {r["sql"]: r["status"] for r in C.run_candidates(box, rows).collect()}
    spent = time.time() - start
    assert [found[t] for t in texts] == ["timeout", "ok"] * 16
    assert spent < 8 * 6.0


def test_waiting_does_not_count(spark):
    """A short action that waits for the tasks of a long one is not late."""
    cores = spark.sparkContext.defaultParallelism
    busy = F.udf(lambda i: time.sleep(0.5) or i, "long")
    long = lambda: spark.range(0, 12 * cores, 1, 12 * cores).select(busy("id")).write.format("noop").mode("overwrite").save()
    thread = threading.Thread(target=inheritable_thread_target(spark)(long))
    thread.start()
    time.sleep(1.5)
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    assert C.within(spark, 4.0, lambda: spark.range(10).count()) == 10
    thread.join()


def test_a_failing_text_is_found_by_halves(box):
    texts = [f"SELECT name FROM person WHERE age > {n}" for n in range(12)] + ["SELECT raise_error(name) FROM person"]
    found = run(box, *texts)
    assert [found[t]["status"] for t in texts] == ["ok"] * 12 + ["error"]


def test_many_waves_equal_one(spark, staff, box):
    texts = [f"SELECT name FROM person WHERE age > {n}" for n in range(45, 75, 3)] + ["SELECT x", ""]
    tiny = C.Sandbox(spark, staff, time_limit=60.0, batch_size=1, parallel_batches=2, wave_size=3)

    def shown(found):
        return {sql: (r["status"], r["n_rows"], r["digest"], r["bag"], r["seq"]) for sql, r in found.items()}

    assert shown(run(tiny, *texts)) == shown(run(box, *texts))


def test_same_meaning_runs_once(box):
    found = run(box, "SELECT name FROM person", "select  NAME\nfrom person h", "SELECT born FROM person")
    assert len({r["plan"] for r in found.values()}) == 2


def test_results_are_screened_without_their_last_order(box, monkeypatch):
    """Texts that differ only in a plain ORDER BY at their end run once, unsorted; one that decides which rows come stays."""
    ran, screen = [], C._screen
    monkeypatch.setattr(C, "_screen", lambda box, plans: ran.extend(plan for _, plan in plans) or screen(box, plans))
    texts = ["SELECT name, age FROM person" + end for end in ("", " ORDER BY age", " order by age DESC, 1 nulls last\n", " ORDER BY person.name")]
    found = run(box, *texts)
    assert len(ran) == 1 and "Sort" not in ran[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["status"], r["n_rows"], r["bag"]) for r in found.values()} == {("ok", 4, found[texts[0]]["bag"])}
    assert [found[t]["seq"] is None for t in texts] == [False, True, True, True] and len({r["plan"] for r in found.values()}) == 4
    kept = ["SELECT name FROM person ORDER BY age LIMIT 1", "SELECT name FROM person ORDER BY raise_error(name)", "SELECT name FROM person ORDER BY nope"]
    found = run(box, *kept)
    assert [found[t]["status"] for t in kept] == ["ok", "error", "error"]


PAIRS = [
    # gold, prediction, match
    ("SELECT name FROM person", "SELECT Name FROM person", True),
    ("SELECT name FROM person", "SELECT name FROM person ORDER BY age", True),
    ("SELECT name FROM person ORDER BY age", "SELECT name FROM person ORDER BY age DESC", False),
    ("SELECT name FROM person ORDER BY age", "SELECT name FROM person WHERE age > 0 ORDER BY age", True),
    ("SELECT name FROM person", "SELECT name FROM person UNION ALL SELECT name FROM person", False),
    ("SELECT name, age FROM person", "SELECT age, name FROM person", False),
    ("SELECT person_id FROM person", "SELECT cast(person_id AS double) FROM person", False),
    ("SELECT age FROM person", "SELECT age + 0.0000001 FROM person", True),
    ("SELECT name FROM person WHERE age > 99", "SELECT born FROM person WHERE age > 98", True),
    ("SELECT name FROM person", "SELECT nope FROM person", False),
    ("SELECT nope FROM person", "SELECT name FROM person", False),
    ("SELECT 'none'", "SELECT NULL", True),
    ("SELECT name FROM person", "```sql\nSELECT upper(name) FROM person;\n```", True),
    ("SELECT count(*) FROM person WHERE age > 60", "SELECT count(*) FROM person", False),
    ("SELECT born, count(*) FROM person GROUP BY born", "SELECT born, sum(1) FROM person GROUP BY born", True),
]


@pytest.mark.parametrize("small_rows", [256, 0], ids=["hashed", "proved"])
def test_execution_match(spark, staff, small_rows):
    """Both ways to compare agree: by row hashes, and by the rows themselves."""
    box = C.Sandbox(spark, staff, time_limit=60.0, small_rows=small_rows)
    found = score(box, *[p[:2] for p in PAIRS])
    assert [found[i]["matched"] for i in range(len(PAIRS))] == [p[2] for p in PAIRS]


@pytest.mark.parametrize("small_rows", [256, 0], ids=["hashed", "proved"])
def test_cached_reference_results(spark, staff, small_rows):
    """Cached, missing, broken and null reference results score like live ones."""
    box = C.Sandbox(spark, staff, time_limit=60.0, small_rows=small_rows)
    gold = "SELECT name, age FROM person WHERE age > 60 ORDER BY age"
    asc, desc = "SELECT name, age FROM person WHERE age >= 61 ORDER BY age", "SELECT name, age FROM person WHERE age > 60 ORDER BY age DESC"
    rows = [
        (0, gold, '[["ann","63.5"],["cid","66.0"]]', 2, gold, True),
        (1, gold, None, 2, asc, True),
        (2, gold, None, 2, desc, False),
        (3, "SELECT count(*) FROM person", None, 1, "SELECT 2 + 2", True),
        (4, "SELECT count(*) FROM team", '[["3"', 1, "SELECT 3", True),
        # A kept result is believed, the text behind it is not run.
        (5, "SELECT nope FROM person", '[["4"]]', 1, "SELECT count(*) FROM person", True),
        (6, "SELECT 'x' FROM nowhere", "[]", 0, "SELECT name FROM person WHERE false", True),
        (7, "SELECT 1, 2 FROM nowhere", '[["b"],["a"]]', 2, "SELECT explode(array('A', 'B'))", True),
        (8, "SELECT 9 FROM nowhere", '[["9"]]', 2, "SELECT 9", False),
    ]
    df = spark.createDataFrame(
        [(cid, 0, "staff", g, t) for cid, g, _, _, t, _ in rows], "cid int, prompt_id int, db_id string, gold_sql string, text string"
    )
    known = spark.createDataFrame(
        [("staff", g, n, 0, r) for _, g, r, n, _, _ in rows if r], "db_id string, sql string, n_rows bigint, chunk bigint, gold_result string"
    )
    cache = known.withColumn("key", C.text_key(F.col("db_id"), F.col("sql")))
    found = {r["cid"]: r["matched"] for r in scoring.score_completions(box, df, cache=cache).collect()}
    assert found == {cid: match for cid, *_, match in rows}


def test_repeated_completions_are_read_once(spark, box, monkeypatch):
    """SQL is extracted from distinct completions; missing texts, and texts that only join to the same string, stay apart."""
    seen, with_keys = [], scoring.with_keys
    monkeypatch.setattr(scoring, "with_keys", lambda rows: seen.append(rows.count()) or with_keys(rows))
    gold = "SELECT count(*) FROM team"
    texts = [(gold, "SELECT 3"), (gold, None), (None, gold), (gold, ""), ("", gold), (gold + "\n", "SELECT 3"), (gold, "\nSELECT 3"), (None, None)]
    rows = [(5 * i + j, "staff", g, t) for i, (g, t) in enumerate(texts) for j in range(5)]
    found = scoring.score_completions(box, spark.createDataFrame(rows, "cid int, db_id string, gold_sql string, text string")).collect()
    assert seen == [len(texts)]
    told = {r["cid"]: (r["gold_sql"], r["text"], r["pred_sql"], r["status"], r["matched"]) for r in found}
    right = [("SELECT 3", "ok", True), ("", "error", False), (gold, "ok", False), ("", "error", False), (gold, "ok", False)]
    right += [("SELECT 3", "ok", True), ("SELECT 3", "ok", True), ("", "error", False)]
    assert len(found) == len(rows) and told == {5 * i + j: (*texts[i], *right[i]) for i in range(len(texts)) for j in range(5)}


def test_rewards(spark, box):
    gold = "SELECT count(*) FROM person WHERE age > 60"
    rows = spark.createDataFrame(
        [(0, 0, "staff", gold, gold), (1, 0, "staff", gold, "SELECT count(*) FROM person"), (2, 0, "staff", gold, "SELECT 1 FROM x")],
        "cid int, prompt_id int, db_id string, gold_sql string, text string",
    )
    scored = scoring.score_completions(box, rows)
    simple = {r["cid"]: r["reward"] for r in rewards.reward_phase1(scored).collect()}
    full = {r["cid"]: r for r in rewards.reward_phase2(scored).collect()}
    assert simple == pytest.approx({0: 1.2, 1: 0.2, 2: 0.2})
    assert full[0]["reward"] == pytest.approx(1.7)
    # No part of the reward waits for the SQL to run.
    assert (full[2]["success"], full[2]["syntax"], full[2]["format"]) == (0.0, 1.0, 1.0)


def test_custom_component(spark):
    @F.pandas_udf("double")
    def brevity(text):
        return 1.0 / (1.0 + text.str.len())

    rows = spark.createDataFrame([(1, "abc"), (2, "")], "cid int, text string")
    parts = [rewards.Component("brevity", 2.0, lambda df: brevity(F.col("text")))]
    found = {r["cid"]: r["reward"] for r in rewards.with_reward(rows, parts).collect()}
    assert found == {1: 0.5, 2: 2.0}


def test_signed_match_agrees_with_except_all(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, "c")], "ex int, v string")
    pred = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (2, "b"), (2, "b"), (4, "d")], "ex int, v string")
    examples = spark.createDataFrame([(i,) for i in range(1, 6)], "ex int")
    found = {r["ex"]: r["matched"] for r in compare.result_match(examples, gold, pred, "ex", ["v"]).collect()}
    back = {r["ex"]: r["matched"] for r in compare.result_match(examples, pred, gold, "ex", ["v"]).collect()}
    assert found == back == {1: True, 2: False, 3: False, 4: False, 5: True}
    for ex, same in found.items():
        g, p = gold.where(F.col("ex") == ex), pred.where(F.col("ex") == ex)
        assert same == (compare.rows_minus(g, p).isEmpty() and compare.rows_minus(p, g).isEmpty())


def test_ordered_match_needs_order(spark):
    gold = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "ex int, pos int, v string")
    pred = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "a")], "ex int, pos int, v string")
    examples = spark.createDataFrame([(1,), (2,)], "ex int")
    found = {r["ex"]: r["matched"] for r in compare.result_match(examples, gold, pred, "ex", ["v"], "pos").collect()}
    assert found == {1: False, 2: True}


def test_positions_follow_a_sort_over_many_partitions(spark, sf):
    box = C.Sandbox(spark, {"w": {"orders": spark.read.parquet(f"{sf}/orders.parquet").repartition(6)}}, time_limit=60.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sql = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey"
    rows = spark.createDataFrame([("k", "w", sql)], "key string, db_id string, sql string")
    placed = C.dense_positions(C.result_rows(box, rows)).orderBy("pos").collect()
    expected = [r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_totalprice", "o_orderkey").collect()]
    assert [r["pos"] for r in placed] == list(range(len(expected)))
    assert [int(r["r"][0]) for r in placed] == expected


def test_ordered_results_over_many_partitions(spark, sf):
    """Large ordered results are proved row by row, equal and reversed."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").repartition(5)
    box = C.Sandbox(spark, {"w": {"orders": orders}}, time_limit=60.0, small_rows=4)
    gold = "SELECT o_orderkey FROM orders ORDER BY o_orderkey"
    answers = {
        "SELECT o_orderkey FROM orders WHERE o_orderkey >= 0 ORDER BY o_orderkey": True,
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC": False,
        "SELECT o_orderkey FROM orders WHERE o_orderkey > 0 ORDER BY o_orderkey": False,
    }
    rows = [(i, 0, "w", gold, text) for i, text in enumerate(answers)]
    df = spark.createDataFrame(rows, "cid int, prompt_id int, db_id string, gold_sql string, text string")
    found = {r["cid"]: r["matched"] for r in scoring.score_completions(box, df).collect()}
    assert [found[i] for i in range(3)] == list(answers.values())
    box.close()


def test_proof_of_large_results_writes_few_rows(spark, sf, tmp_path, monkeypatch):
    """Large results that look alike are proved from all their rows, and those of a few ordered ones at most lie on disk at once."""
    from pathlib import Path

    from sqltally.session import work_folder

    monkeypatch.setattr(C, "PROVED_ROWS", 1)
    large, deleted = [], C.delete

    def seen():
        return [p for p in tmp_path.rglob("*.parquet") if p.stat().st_size > 30_000]

    def noted(spark, folder):
        large.append(len({p.parent for p in seen()}))
        deleted(spark, folder)

    monkeypatch.setattr(C, "delete", noted)
    box = C.Sandbox(spark, {"staff": {"lineitem": f"{sf}/lineitem.parquet"}}, time_limit=60.0, small_rows=4)
    rows = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem"
    gold = f"{rows} WHERE l_linenumber < 5"
    swap = "SELECT l_orderkey, if(l_orderkey IN (1, 2), 3 - l_orderkey, l_orderkey) % 2 AS k FROM lineitem"
    pairs = [
        (gold, f"{gold} ORDER BY l_partkey", True),
        (gold, f"{gold} AND l_tax < 0.04 UNION ALL {gold} AND l_tax >= 0.04", True),
        (f"{gold} ORDER BY l_orderkey, l_linenumber", f"{gold} ORDER BY l_orderkey + 0, l_linenumber", True),
        (f"{gold} ORDER BY l_orderkey, l_linenumber", f"{gold} ORDER BY l_orderkey, l_linenumber DESC", False),
        (f"{swap} ORDER BY k, l_orderkey", f"{swap} ORDER BY k, l_orderkey DESC", False),
    ]
    with work_folder(spark, str(tmp_path)):
        found = score(box, *[p[:2] for p in pairs])
        assert [found[i]["matched"] for i in range(len(pairs))] == [p[2] for p in pairs]
        assert large and max(large) == 1
        assert not seen()
    box.close()
