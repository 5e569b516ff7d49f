"""Text expressions on literal rows."""

import pytest
from pyspark.sql import functions as F

from sqltally.functions import fixed
from sqltally.functions import text as X


def one(spark, value, expression, kind="string"):
    """The expression's value for one literal."""
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, sql",
    [
        ("SELECT 1", "SELECT 1"),
        ("```sql\nSELECT 1\n```", "SELECT 1"),
        ("```\nSELECT 1\n```", "SELECT 1"),
        ("prose ```SQL   SELECT 1``` more ```sql\nSELECT 2```", "SELECT 1"),
        ("SELECT 1; some explanation after", "SELECT 1"),
        ("SELECT ';' FROM t", "SELECT '"),
        ("Here is the query:\nSELECT name FROM person", "Here is the query:\nSELECT name FROM person"),
        ("```sql\nSELECT 1", "```sql\nSELECT 1"),
        # A sql marker that never closes: the generic fence is not tried.
        ("```sql SELECT 1 `` ", "```sql SELECT 1 ``"),
        ("```\nSELECT 1", "```\nSELECT 1"),
        ("", ""),
        ("   \n  ", ""),
        (None, ""),
    ],
)
def test_extract_sql(spark, text, sql):
    assert one(spark, text, X.extract_sql) == sql


@pytest.mark.parametrize(
    "text, score",
    [
        ("SELECT count(*) FROM person WHERE age > 60", 1.0),
        ("SELECT T1.name FROM person AS T1 JOIN leads AS T2 ON T1.person_ID = T2.person_ID", 1.0),
        ("hello world not sql", 0.0),
        ("DROP TABLE x", 0.0),
        ("i selected one", 1.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_syntax_valid(spark, text, score):
    assert one(spark, text, X.syntax_valid) == score


@pytest.mark.parametrize(
    "text, score",
    [
        ("SELECT count(*) FROM person", 1.0),
        ("  select 1", 1.0),
        ("Here is the SQL: SELECT count(*) FROM person", 0.0),
        ("```sql\nSELECT 1\n```", 0.0),
        ("WITH x AS (SELECT 1) SELECT * FROM x", 0.0),
        ("i think", 0.0),
    ],
)
def test_format_compliance(spark, text, score):
    assert one(spark, text, X.format_compliance) == score


@pytest.mark.parametrize(
    "messages, text",
    [
        ([("assistant", "SELECT 1")], "SELECT 1"),
        ([("user", "ignored"), ("assistant", "a"), ("assistant", "b"), ("user", "c")], "b"),
        ([("user", "a"), ("system", "b")], "a b"),
        ([], ""),
        ([("assistant", None)], ""),
        (None, ""),
    ],
)
def test_completion_text_of_messages(spark, messages, text):
    kind = "array<struct<role:string,content:string>>"
    assert one(spark, messages, X.completion_text, kind) == text


def test_identifier_set(spark):
    def names(sql):
        return set(one(spark, sql, X.identifier_set))

    assert names("SELECT count(*) FROM person WHERE age > 60") == {"count", "person", "age"}
    assert names("SELECT T1.name FROM person AS T1 JOIN m AS T2 ON T1.person_ID = T2.person_ID") == {
        "t1", "t2", "name", "person", "m", "person_id",
    }
    assert names("SELECT a FROM t WHERE b = 'it''s c' -- d\n AND \"e\" = 1 /* f\n g */") == {"a", "t", "b"}
    assert names("") == set()


def test_schema_f1(spark):
    def f1(pred, gold):
        rows = spark.createDataFrame([(pred, gold)], "p string, g string")
        return rows.select(X.schema_f1(F.col("p"), F.col("g")).alias("v")).first()["v"]

    gold = "SELECT name FROM person WHERE age > 60"
    assert f1(gold, gold) == 1.0
    assert 0.0 < f1("SELECT name FROM person", gold) < 1.0
    assert f1("SELECT cost FROM budget_line", gold) == 0.0
    assert f1("", "") == 1.0
    assert f1("", gold) == 0.0


def test_normalise_value(spark):
    rows = spark.sql(
        "SELECT 1 AS i, 1.0D AS d, 0.1234567D AS r, true AS b, ' AbC\t' AS s, CAST(NULL AS int) AS n, 2.50BD AS m, 'None' AS t"
    )
    found = rows.select(*[X.normalise_value(f.name, f.dataType).alias(f.name) for f in rows.schema.fields]).first()
    assert found.asDict() == {
        "i": "1", "d": "1.0", "r": "0.123457", "b": "1", "s": "abc", "n": "none", "m": "2.5", "t": "none",
    }


@pytest.mark.parametrize(
    "struct, tier",
    [
        (None, "unknown"),
        ("null", "unknown"),
        ("{}", "easy"),
        ('{"where": [[0, "a"]]}', "easy"),
        ('{"where": [[0, "a"], "and", [1, "b"]]}', "medium"),
        ('{"where": [], "groupBy": ["a"], "having": [], "orderBy": ["asc", []], "limit": 0}', "medium"),
        ('{"union": {"where": []}, "limit": null}', "medium"),
        ('{"union": {"where": []}, "except": {"a": 1}}', "hard"),
        ('{"union": {"a": 1}, "except": {"a": 1}, "intersect": {"a": 1}}', "extra"),
        ('{"intersect": {}, "union": null, "except": ""}', "easy"),
        ('{"from": {"table_units": [["t", 1], ["t", 2], ["t", 3]]}}', "medium"),
        ('{"from": 7, "groupBy": null}', "easy"),
    ],
)
def test_difficulty(spark, struct, tier):
    assert one(spark, struct, X.difficulty) == tier


def test_order_by_anywhere(spark):
    assert one(spark, "SELECT a FROM (SELECT a FROM t order \n by a) x", X.is_ordered)
    assert not one(spark, "SELECT border, by FROM t", X.is_ordered)


def test_prompts(spark):
    row = (
        spark.createDataFrame([("How many?", "CREATE TABLE t (a int)")], "q string, s string")
        .select(X.prompt_messages(F.col("q"), F.col("s")).alias("p"))
        .withColumn("m", X.sft_messages(F.col("p"), F.lit("SELECT 1")))
        .first()
    )
    assert [m["role"] for m in row["m"]] == ["system", "user", "assistant"]
    assert row["p"][0]["content"] == fixed.SYSTEM_PROMPT
    assert row["p"][1]["content"] == (
        "### Database Schema:\nCREATE TABLE t (a int)\n\n### Question:\nHow many?\n\n### SQL:"
    )
    assert row["m"][2]["content"] == "SELECT 1"


def test_split_path(spark):
    row = spark.createDataFrame([("test", "db")], "s string, d string").select(
        X.split_path("/d/", F.col("s"), F.col("d")).alias("t"), X.split_path("/d", F.lit("dev"), F.col("d")).alias("v")
    ).first()
    assert tuple(row) == ("/d/test_database/db/db.sqlite", "/d/database/db/db.sqlite")


def test_schema_cut(spark):
    assert one(spark, "x" * 3500, X.cut_schema) == "x" * 3500
    assert one(spark, "é" * 3501, X.cut_schema) == "é" * 3500 + "\n-- (schema truncated)"
