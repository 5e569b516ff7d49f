"""Cases that once gave wrong results."""

import pytest
from pyspark.sql import functions as F

from sqltally.functions import fixed
from sqltally.functions import text as X
from sqltally.operators import candidates as C
from sqltally.operators import evaluate, failures, monitor, reports, rewards
from sqltally.operators.running import carried
from sqltally.sources import schemas


def test_schema_script_strips_before_it_cuts(spark):
    scripts = {
        "lead": " " * 3600 + "CREATE TABLE t (\nx int);",
        "inner": "CREATE TABLE t (" + "\n" * 3600 + "x int);",
        "tail": "CREATE TABLE t (x int" + "\n \n" * 3000,
        "two": "CREATE TABLE a (x int);\nINSERT INTO a VALUES (1);\nCREATE TABLE b (y int);",
        "long": "\n".join(["CREATE TABLE t ("] + [f"c{i} int," for i in range(2000)] + [");"]),
    }
    rows = [(d, n, line) for d, s in scripts.items() for n, line in enumerate(s.split("\n"))]
    found = schemas.parse_schema_script(spark.createDataFrame(rows, "db_id string, line_no bigint, line string"))
    texts = {r["db_id"]: r["schema_text"] for r in found.collect()}

    def cut(text):
        text, limit = text.strip(), fixed.MAX_SCHEMA_CHARS
        return text if len(text) <= limit else text[:limit] + fixed.TRUNCATION_MARK

    wanted = dict(scripts, two="CREATE TABLE a (x int);\n\nCREATE TABLE b (y int);")
    assert texts == {d: cut(s) for d, s in wanted.items()}


def test_schema_statements_of_any_number(spark):
    rows = [("many", i, f"  CREATE TABLE t{i} (x int) ") for i in range(5000)] + [("blank", 0, " "), ("blank", 1, "\nCREATE TABLE u (y int)")]
    found = schemas.schema_text(spark.createDataFrame(rows, "db_id string, ord bigint, ddl string"))
    texts = {r["db_id"]: r["schema_text"] for r in found.collect()}
    whole = "\n\n".join(f"CREATE TABLE t{i} (x int)" for i in range(5000))
    assert texts["many"] == whole[: fixed.MAX_SCHEMA_CHARS] + fixed.TRUNCATION_MARK
    assert texts["blank"] == "\n\nCREATE TABLE u (y int)"


def test_numbers_are_no_names(spark):
    sql = "SELECT a1 FROM t WHERE x > 1e5 AND y < 2.5E-3 AND z = 0x1F"
    found = spark.range(1).select(X.identifier_set(F.lit(sql)).alias("s")).first()["s"]
    assert set(found) == {"a1", "t", "x", "y", "z"}


def test_decimals_keep_their_digits(spark):
    values = ["12345678901234567.89", "12345678901234567.99", "2.50", "3.00", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("decimal(20,2)").alias("v"))
    texts = [r["t"] for r in df.select(X.normalise_value("v", df.schema["v"].dataType).alias("t")).collect()]
    assert texts == ["12345678901234567.89", "12345678901234567.99", "2.5", "3.0", "none"]


@pytest.mark.parametrize(("text", "tier"), [("not json", "unknown"), ("[1]", "unknown"), ("null", "unknown"), ("{}", "easy"), (None, "unknown")])
def test_only_objects_have_a_tier(spark, text, tier):
    assert spark.range(1).select(X.difficulty(F.lit(text).cast("string")).alias("d")).first()["d"] == tier


def test_harmless_texts_may_say_reflect(spark, staff):
    box = C.Sandbox(spark, staff)
    for sql in ("SELECT name FROM person WHERE name LIKE '%reflect(%'", "SELECT 1 AS reflect -- java_method(x)"):
        assert box.plan("staff", sql).columns
    for sql in (
        "SELECT reflect('java.lang.System', 'lineSeparator')",
        "SELECT `reflect` ('java.lang.System', 'lineSeparator')",
        "SELECT '\\'', java_method /* x */ ('java.lang.System', 'lineSeparator')",
        "SELECT r'\\', try_reflect('java.lang.System', 'lineSeparator')",
    ):
        with pytest.raises(PermissionError):
            box.plan("staff", sql)


def test_saturation_looks_past_missing_steps(spark):
    log = [(0, 0, "execution", 0.5), (0, 0, "syntax", 1.0), (0, 10, "syntax", 1.0), (0, 30, "execution", 0.4), (0, 30, "syntax", 1.0)]
    rows = monitor.reward_saturation(spark.createDataFrame(log, "run int, step bigint, component string, value double"), 0.9)
    assert {r["logged"]: (r["flagged"], r["previous_goal"]) for r in rows.collect()} == {0: (False, None), 1: (False, 0.5), 3: (True, 0.5)}


def test_carried_values(spark):
    rows = [("a", 3, None), ("a", 1, 5), ("a", 200_000, 7), ("a", 400_000, None), ("b", 2, 1), ("a", 500_000, 9), (None, 1, 4), (None, 2, 5)]
    found = carried(spark.createDataFrame(rows, "k string, at bigint, v int"), ["k"], "at", "v", "before")
    assert {(r["k"], r["at"]): r["before"] for r in found.collect()} == {
        ("a", 1): None, ("a", 3): 5, ("a", 200_000): 5, ("a", 400_000): 7, ("a", 500_000): 7, ("b", 2): None, (None, 1): None, (None, 2): 4,
    }


def test_missing_groups_and_tiers(spark):
    rewarded = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, 7, 2.0)], "cid int, prompt_id int, reward double")
    found = {r["cid"]: r["advantage"] for r in rewards.group_advantage(rewarded).collect()}
    assert found == pytest.approx({1: -0.5**0.5, 2: 0.5**0.5, 3: 0.0})
    predictions = spark.createDataFrame([("m", None, True), ("m", "easy", False)], "method string, difficulty string, correct boolean")
    assert evaluate.eval_summary(predictions, ["method"]).first()["by_difficulty"] == {"unknown": 1.0, "easy": 0.0}


def test_absent_categories_and_tiers_count_zero(spark):
    rows = [("base", "SELECT 1", "nope"), ("base", "x", "SELECT 1"), ("new", "y", "SELECT 1")]
    failed = spark.createDataFrame(rows, "method string, pred_sql string, gold_sql string").withColumns(
        {"error": F.lit("e"), "n_rows": F.lit(0), "gold_rows": F.lit(0)}
    )
    found = {(r["method"], r["category"]): r["reduction"] for r in failures.category_by_method(failed, "base").collect()}
    assert found[("new", "execution_error")] == 1
    assert len(found) == 2 * len(fixed.FAILURE_CATEGORIES)
    predictions = spark.createDataFrame([("base", "easy", True), ("base", "hard", True), ("new", "easy", True)], "method string, difficulty string, correct boolean")
    deltas = {r["difficulty"]: r["delta"] for r in reports.method_delta(predictions, "base").collect()}
    assert deltas == {"easy": 0.0, "hard": -100.0, "overall": 0.0}


def test_components_without_a_weight_are_counted(spark):
    values = spark.createDataFrame([(1, "execution", 1.0), (1, "style", 5.0)], "cid int, component string, value double")
    assert rewards.reward_weighted_long(values, {"execution": 0.5}).first().asDict() == {"cid": 1, "reward": 0.5, "unweighted": 1}
