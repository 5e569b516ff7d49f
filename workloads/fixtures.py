"""Inputs of the registered queries, derived from the given tables.

Each is one SQL text that means the same in Spark and in the checking engine. ``{orders}`` and the
like stand for a table: a DataFrame there, a view here.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Six completions per prompt. The reference SQL has four shapes over 25 nations.
COMPLETIONS = """
WITH prompts AS (
  SELECT o_orderkey AS cid, CAST(floor(o_orderkey / 6) AS BIGINT) AS prompt_id, o_orderkey % 6 AS gen
  FROM {orders}
), golds AS (
  SELECT cid, prompt_id, gen,
    CASE prompt_id % 4
      WHEN 0 THEN 'SELECT c_name FROM customer WHERE c_nationkey = ' || CAST(prompt_id % 25 AS STRING)
      WHEN 1 THEN 'SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = '
        || CAST(prompt_id % 25 AS STRING) || ' ORDER BY c_custkey'
      WHEN 2 THEN 'SELECT c_mktsegment, COUNT(*) FROM customer WHERE c_nationkey = '
        || CAST(prompt_id % 25 AS STRING) || ' GROUP BY c_mktsegment'
      ELSE 'SELECT n_name FROM nation WHERE n_nationkey = ' || CAST(prompt_id % 25 AS STRING)
    END AS gold_sql
  FROM prompts
)
SELECT cid, prompt_id, gen, gold_sql, 'warehouse' AS db_id,
  CASE
    WHEN gen = 0 THEN gold_sql
    WHEN gen = 1 THEN '```sql' || chr(10) || gold_sql || chr(10) || '```'
    WHEN gen = 2 THEN gold_sql || '; this lists the rows'
    WHEN gen = 3 THEN 'Here is the query:' || chr(10) || gold_sql
    WHEN gen = 4 AND prompt_id % 3 = 0 AND prompt_id % 4 < 2 THEN replace(gold_sql, 'WHERE', 'WHERE c_custkey > -1e1 AND')
    WHEN gen = 4 AND prompt_id % 3 = 0 THEN replace(gold_sql, 'SELECT', 'select')
    WHEN gen = 4 AND prompt_id % 3 = 1 AND prompt_id % 4 = 1 THEN gold_sql || ' DESC'
    WHEN gen = 4 THEN replace(gold_sql, ' = ', ' <> ')
    WHEN prompt_id % 3 = 0 THEN ''
    WHEN prompt_id % 3 = 1 THEN 'SELEKT name'
    ELSE 'SELECT nope FROM customer'
  END AS text
FROM golds
"""

# Two result sets per order, the second one damaged in three of four orders.
GOLD_ROWS = """
SELECT l_orderkey AS ex, CAST(l_partkey AS STRING) AS a, CAST(CAST(l_quantity AS BIGINT) AS STRING) AS b
FROM {lineitem}
"""
PRED_ROWS = """
SELECT l_orderkey AS ex, CAST(l_partkey AS STRING) AS a,
  CAST(CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 4 = 2 THEN 1 ELSE 0 END AS STRING) AS b
FROM {lineitem} WHERE NOT (l_orderkey % 4 = 1 AND l_linenumber = 1)
UNION ALL
SELECT l_orderkey, CAST(l_partkey AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING)
FROM {lineitem} WHERE l_orderkey % 4 = 3
"""

# Questions with reference SQL: some of it fails, some finds nothing (nations 25 to 29).
EXAMPLES = """
SELECT doc_id AS idx, source AS db_id, text AS question,
  CASE
    WHEN doc_id % 41 = 7 THEN 'SELECT nope FROM customer'
    WHEN doc_id % 4 = 0 THEN 'SELECT c_custkey, c_name FROM customer WHERE c_nationkey = '
      || CAST(doc_id % 30 AS STRING) || ' ORDER BY c_custkey'
    WHEN doc_id % 4 = 1 THEN 'SELECT COUNT(*) FROM orders WHERE o_custkey % 30 = ' || CAST(doc_id % 30 AS STRING)
    WHEN doc_id % 4 = 2 THEN 'SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = '
      || CAST(doc_id % 30 AS STRING) || ' ORDER BY s_suppkey'
    ELSE 'SELECT o_orderpriority, COUNT(*) FROM orders WHERE o_custkey = ' || CAST(doc_id % 30 AS STRING)
      || ' GROUP BY o_orderpriority ORDER BY o_orderpriority'
  END AS gold_sql,
  CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split
FROM {documents}
"""

# The same rows with databases that hold one row only, and databases no training row belongs to.
FEWSHOT = """
SELECT doc_id AS idx,
  CASE WHEN doc_id % 26 = 0 THEN 'new_' || source
       WHEN doc_id % 9 = 0 THEN 'rare_' || CAST(doc_id AS STRING) ELSE source END AS db_id,
  text AS question, 'SELECT ' || CAST(doc_id AS STRING) AS gold_sql,
  CASE WHEN doc_id % 13 = 0 THEN 'dev' ELSE 'train' END AS split
FROM {documents}
"""

STATEMENTS = """
SELECT source AS db_id, doc_id AS ord,
  '  CREATE TABLE d' || CAST(doc_id AS STRING) || ' (' || text || ')' || chr(10) AS ddl
FROM {documents}
"""

SCRIPTS = """
SELECT source AS db_id, doc_id,
  '-- table ' || CAST(doc_id AS STRING) || chr(10) || ' create table d' || CAST(doc_id AS STRING) || ' ('
  || chr(10) || text || chr(10) || ');' || chr(10) || 'INSERT INTO d VALUES (1);' AS script
FROM {documents}
"""

SQL_STRUCTS = """
SELECT o_orderkey AS idx,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 17 = 3 THEN 'not json' WHEN o_orderkey % 17 = 5 THEN '[1]' ELSE
    '{{"where": ' || CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[[0, "a"]]' ELSE '[[0, "a"], "and", [1, "b"]]' END
    || ', "groupBy": ' || CASE WHEN o_orderkey % 2 = 0 THEN '[]' ELSE '["c"]' END
    || ', "having": [], "orderBy": ' || CASE WHEN o_orderkey % 5 = 0 THEN '["asc"]' ELSE '[]' END
    || ', "limit": ' || CASE WHEN o_orderkey % 5 = 0 THEN '3' ELSE 'null' END
    || ', "intersect": null, "except": null, "union": '
    || CASE WHEN o_orderkey % 7 = 0 THEN '{{"where": []}}' ELSE 'null' END
    || ', "from": {{"table_units": ' || CASE WHEN o_orderkey % 4 = 0 THEN '[["t", 1], ["t", 2]]' ELSE '[["t", 1]]' END
    || '}}}}'
  END AS sql
FROM {orders}
"""

# Three methods judged on every order; every 13th verdict is missing.
PREDICTIONS = """
SELECT method, idx,
  CASE idx % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'extra' END AS difficulty,
  CASE WHEN idx % 13 = 5 THEN NULL ELSE (idx * 7 + k * 3) % 10 < 5 + k END AS correct,
  CASE WHEN idx % 10 = 3 THEN 'test' ELSE 'dev' END AS split,
  CAST(floor(idx / 10) AS BIGINT) % 20 AS step
FROM (
  SELECT 'zero_shot' AS method, 0 AS k, o_orderkey AS idx FROM {orders}
  UNION ALL SELECT 'few_shot', 1, o_orderkey FROM {orders}
  UNION ALL SELECT 'tuned', 2, o_orderkey FROM {orders}
) m
"""

REWARD_LOG = """
SELECT user_id % 3 AS run, event_id AS step, ts, value, user_id,
  CASE event_type WHEN 'view' THEN 'execution' WHEN 'click' THEN 'success' WHEN 'error' THEN 'syntax'
    WHEN 'purchase' THEN 'schema_f1' ELSE 'format' END AS component
FROM {events}
"""

# Candidates that try to do damage, with one harmless text among them.
HOSTILE = """
SELECT o_orderkey AS cid, 'warehouse' AS db_id,
  CASE o_orderkey % 6
    WHEN 0 THEN 'DROP TABLE customer'
    WHEN 1 THEN 'DELETE FROM orders WHERE o_custkey = ' || CAST(o_custkey % 25 AS STRING)
    WHEN 2 THEN 'SELECT 1) x; DROP VIEW customer; SELECT (1'
    WHEN 3 THEN 'INSERT INTO nation VALUES (1, ''x'', 2)'
    WHEN 4 THEN 'SELECT reflect(''java.lang.System'', ''lineSeparator'')'
    ELSE 'SELECT n_name FROM nation WHERE n_regionkey = ' || CAST(o_custkey % 6 AS STRING) || ' -- reflect(all) of them'
  END AS sql
FROM {orders}
"""

# One runaway product among quick candidates.
RUNAWAY = (
    "SELECT count(*) FROM lineitem a, lineitem b, lineitem c "
    "WHERE a.l_quantity + b.l_quantity * c.l_quantity > 3"
)
MIXED_SPEED = (
    """
SELECT o_orderkey AS cid, 'warehouse' AS db_id,
  CASE WHEN o_orderkey % 100 = 7 THEN '"""
    + RUNAWAY
    + """'
    ELSE 'SELECT r_name FROM region WHERE r_regionkey = ' || CAST(o_orderkey % 6 AS STRING) END AS sql
FROM {orders}
"""
)

# Results of many thousands of rows: equal ones, the same rows in another order, and others.
LARGE_RESULTS = """
WITH asked AS (
  SELECT n_nationkey AS cid, n_nationkey % 2 AS kind, CAST(floor(n_nationkey / 2) AS BIGINT) % 5 AS gen, CAST(n_nationkey % 3 AS STRING) AS k
  FROM {nation}
), golds AS (
  SELECT cid, kind, gen, k, 'warehouse' AS db_id,
    CASE kind WHEN 0 THEN 'SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_suppkey % 5 <> ' || k
      ELSE 'SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> ' || k || ' ORDER BY o_orderkey' END AS gold_sql
  FROM asked
)
SELECT cid, cid AS prompt_id, kind, gen, db_id, gold_sql,
  CASE
    WHEN gen = 0 THEN replace(gold_sql, '<> ' || k, '> ' || k || CASE kind WHEN 0 THEN ' OR l_suppkey % 5 < ' ELSE ' OR o_custkey % 4 < ' END || k)
    WHEN gen = 1 AND kind = 0 THEN gold_sql || ' ORDER BY l_partkey, l_orderkey'
    WHEN gen = 1 THEN gold_sql || ' DESC'
    WHEN gen = 2 AND kind = 0 THEN gold_sql || ' AND l_quantity < 25 UNION ALL ' || gold_sql || ' AND l_quantity >= 25'
    WHEN gen = 2 THEN replace(gold_sql, 'ORDER BY', 'ORDER BY o_custkey,')
    WHEN gen = 3 AND kind = 0 THEN gold_sql || ' UNION ALL SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber = 1'
    WHEN gen = 3 THEN gold_sql || ' + 0'
    WHEN kind = 0 THEN replace(gold_sql, 'l_quantity FROM', 'l_quantity + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END FROM')
    ELSE replace(gold_sql, 'WHERE', 'WHERE o_orderkey > 3 AND')
  END AS text
FROM golds
"""

# Conversations of which two in three end with an answer of SQL, right or wrong.
CHATS = """
SELECT conv_id, turn, role, text FROM {conversations}
UNION ALL
SELECT conv_id, max(turn) + 1, 'assistant',
  CASE conv_id % 3 WHEN 1 THEN '```sql' || chr(10) || 'SELECT r_name FROM region WHERE r_regionkey = ' || CAST(conv_id % 5 AS STRING) || chr(10) || '```'
    ELSE 'SELECT r_name FROM region WHERE r_regionkey = ' || CAST((conv_id + 1) % 5 AS STRING) END
FROM {conversations} WHERE conv_id % 3 > 0 GROUP BY conv_id
"""

# One table of two columns per document, as rows of metadata.
COLUMNS = """
SELECT source AS db_id, 'm' || CAST(doc_id AS STRING) AS tbl, doc_id AS tbl_ord, 0 AS ord, 'a' AS col, 'int' AS type FROM {documents}
UNION ALL
SELECT source, 'm' || CAST(doc_id AS STRING), doc_id, 1, lang, 'text' FROM {documents}
"""

FIXTURES = {
    "chats": CHATS,
    "columns_of": COLUMNS,
    "large_results": LARGE_RESULTS,
    "completions": COMPLETIONS,
    "gold_rows": GOLD_ROWS,
    "pred_rows": PRED_ROWS,
    "examples": EXAMPLES,
    "fewshot": FEWSHOT,
    "statements": STATEMENTS,
    "scripts": SCRIPTS,
    "sql_structs": SQL_STRUCTS,
    "predictions": PREDICTIONS,
    "reward_log": REWARD_LOG,
    "hostile": HOSTILE,
    "mixed_speed": MIXED_SPEED,
}


def names_in(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names_in(sql)})


def fixture_sql(name: str) -> str:
    """The same derivation as a common table expression for the checking engine."""
    sql = FIXTURES[name]
    return f"{name} AS ({sql.format(**{t: t for t in names_in(sql)})})"


def warehouse(sf_dir: str) -> dict[str, dict[str, str]]:
    """The database the candidates read."""
    return {"warehouse": {name: f"{sf_dir}/{name}.parquet" for name in TABLES[:7]}}
