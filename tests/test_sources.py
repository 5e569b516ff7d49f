"""Splits, schema texts and prediction files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sqltally.functions import fixed
from sqltally.session import kept, work_dir, work_folder
from sqltally.sources import schemas, splits


def record(n):
    return {
        "db_id": f"db{n % 3}",
        "question": f"q{n} é\n\"x\"",
        "query": f"SELECT {n}",
        "sql": {"where": [[0, n], "and"], "limit": None, "from": {"table_units": [["t", 1]]}},
    }


@pytest.fixture
def data(tmp_path):
    (tmp_path / "train.json").write_text(json.dumps([record(n) for n in range(5)], indent=1))
    (tmp_path / "train_others.json").write_text(json.dumps([record(n) for n in range(5, 8)]))
    (tmp_path / "dev.json").mkdir()
    for part in (1, 0, 2):
        rows = [record(10 * part + n) for n in range(part + 1)]
        (tmp_path / "dev.json" / f"part{part}.json").write_text(json.dumps(rows))
    return str(tmp_path)


def test_read_split(spark, data):
    rows = splits.read_split(spark, "train", data).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(8))
    assert [r["gold_sql"] for r in rows] == [f"SELECT {n}" for n in range(8)]
    assert rows[3]["question"] == record(3)["question"]
    # The parsed query stays raw text.
    assert json.loads(rows[3]["sql"]) == record(3)["sql"]
    assert splits.read_split(spark, "train", data, include_others=False).count() == 5


def test_part_files_are_numbered_in_name_order(spark, data):
    rows = splits.read_split(spark, "dev", data).orderBy("idx").collect()
    assert [r["gold_sql"] for r in rows] == [f"SELECT {n}" for n in (0, 10, 11, 20, 21, 22)]
    assert [r["idx"] for r in rows] == list(range(6))


def test_missing_second_part_and_unknown_split(spark, data, tmp_path):
    only = tmp_path / "only"
    only.mkdir()
    (only / "train.json").write_text(json.dumps([record(1)]))
    assert splits.read_split(spark, "train", str(only)).count() == 1
    with pytest.raises(ValueError):
        splits.read_split(spark, "validation", data)


def test_filtered_or_raw(spark, data, tmp_path):
    kept = str(tmp_path / "kept")
    assert splits.read_filtered_or_raw(spark, kept, data).count() == 8
    assert splits.read_filtered_or_raw(spark, None, data).count() == 8
    splits.write_filtered(splits.read_split(spark, "train", data).where("idx < 2"), kept)
    assert splits.read_filtered_or_raw(spark, kept, data).count() == 2


def test_read_predictions(spark, tmp_path):
    rows = [{"index": 0, "correct": True, "pred_sql": "SELECT 1"}, {"index": 1, "pred_error": "Timeout"}]
    (tmp_path / "wrapped.json").write_text(json.dumps({"model": "m", "total": 2, "predictions": rows}, indent=2))
    (tmp_path / "bare.json").write_text("\n " + json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("wrapped.json", "bare.json", "lines.jsonl"):
        found = splits.read_predictions(spark, str(tmp_path / name), lines=name.endswith("jsonl")).orderBy("index").collect()
        assert [(r["index"], r["correct"], r["pred_error"]) for r in found] == [(0, True, None), (1, None, "Timeout")]


def test_schema_text(spark):
    rows = spark.createDataFrame(
        [("a", 2, " CREATE TABLE y (b int)\n"), ("a", 1, "CREATE TABLE x (a int)"), ("a", 3, None), ("a", 4, ""), ("b", 1, "z" * 4000)],
        "db_id string, ord int, ddl string",
    )
    found = {r["db_id"]: r["schema_text"] for r in schemas.schema_text(rows).collect()}
    assert found["a"] == "CREATE TABLE x (a int)\n\nCREATE TABLE y (b int)"
    assert found["b"] == "z" * fixed.MAX_SCHEMA_CHARS + fixed.TRUNCATION_MARK


def test_many_short_statements(spark):
    rows = spark.range(5000).select(F.lit("a").alias("db_id"), F.col("id").alias("ord"), F.lit("x").alias("ddl"))
    text = schemas.schema_text(rows).first()["schema_text"]
    assert text == "\n\n".join("x" * 5000)[: fixed.MAX_SCHEMA_CHARS] + fixed.TRUNCATION_MARK


SCRIPT = """PRAGMA foreign_keys = ON;
  create table a (
  x int -- first
); trailing
INSERT INTO a VALUES (1);
CREATE TABLE b (y int);
CREATE TABLE c (
  z int
CREATE TABLE d (w int)
"""


SHOWN = """create table a (
  x int -- first
); trailing

CREATE TABLE b (y int);

CREATE TABLE c (
  z int
CREATE TABLE d (w int)
"""
# Repeated, the unfinished last statement runs on to the next semicolon.
SHOWN_TWICE = (
    SHOWN
    + """PRAGMA foreign_keys = ON;

  """
    + SHOWN
)


def test_schema_script(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "schema.sql").write_text(SCRIPT * (1 if name == "one" else 2))
    lines = schemas.read_script_lines(spark, str(tmp_path))
    found = {r["db_id"]: r["schema_text"] for r in schemas.parse_schema_script(lines).collect()}
    assert found == {"one": SHOWN.strip(), "two": SHOWN_TWICE.strip()}
    # The state is carried over block borders.
    kept = schemas.statement_lines(lines, block=2)
    assert kept.count() == schemas.statement_lines(lines).count()
    listed = spark.createDataFrame([("one", 0, "CREATE TABLE q (a int)")], "db_id string, ord int, ddl string")
    both = {r["db_id"]: r["schema_text"] for r in schemas.schema_text_or_script(listed, lines).collect()}
    assert both == {"one": "CREATE TABLE q (a int)", "two": SHOWN_TWICE.strip()}


def test_statements_of_tables_and_columns(spark, staff):
    found = schemas.schema_text(schemas.statements_of_tables(spark, staff)).first()["schema_text"]
    assert found.startswith("CREATE TABLE person (person_id int, name string, age double, born string)\n\nCREATE TABLE team")
    columns = spark.createDataFrame(
        [("d", "t", 0, 1, "b", "text"), ("d", "t", 0, 0, "a", "int"), ("d", "s", 1, 0, "c", "int")],
        "db_id string, tbl string, tbl_ord int, ord int, col string, type string",
    )
    text = schemas.schema_text(schemas.statements_of_columns(columns)).first()["schema_text"]
    assert text == "CREATE TABLE t (a int, b text)\n\nCREATE TABLE s (c int)"


def test_work_folder_is_deleted(spark, tmp_path):
    with work_folder(spark, str(tmp_path)) as folder:
        assert kept(spark.range(5), "numbers").count() == 5
        assert os.listdir(folder)
    assert not os.path.exists(folder)
    assert not work_dir(spark, "next").startswith(folder)
