"""The same answers in plain SQL, written independently of the operators.

Candidate runs cannot be repeated inside one statement. Their oracles work out from the design of
the inputs which rows each text must return, and compare those as sorted lists.
"""

from __future__ import annotations

from sqltally.functions import fixed

from .fixtures import FIXTURES, fixture_sql
from .queries import CONSTRUCTS

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


C = fixture_sql("completions")
EX = fixture_sql("examples")
PR = fixture_sql("predictions")
LOG = fixture_sql("reward_log")

# --- text ------------------------------------------------------------------------------------------

_FENCE = r"'(?is)```sql[ \t\n\r\f\v]*(.*?)```'"
_ANY = r"'(?s)```[ \t\n\r\f\v]*(.*?)```'"
EXTRACTED = f"""extracted AS (
  SELECT *, {trim("split_part(body, ';', 1)")} AS pred_sql FROM (
    SELECT *, CASE
      WHEN contains(lower(t), '```sql') THEN
        CASE WHEN regexp_matches(t, {_FENCE}) THEN regexp_extract(t, {_FENCE}, 1) ELSE t END
      WHEN contains(t, '```') THEN CASE WHEN regexp_matches(t, {_ANY}) THEN regexp_extract(t, {_ANY}, 1) ELSE t END
      ELSE t END AS body
    FROM (SELECT *, {trim('text')} AS t FROM completions)
  )
)"""

KEYWORDS = [w for w in fixed.SQL_STOP_WORDS if w not in fixed.AGGREGATE_NAMES]


def identifiers(x: str, drop: list[str] = KEYWORDS) -> str:
    bare = f"""regexp_replace({x}, '''[^'']*''|"[^"]*"|--[^\\n]*|(?s:/\\*.*?\\*/)', ' ', 'g')"""
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({bare}), '\\b[a-z_][a-z0-9_]*')), "
        f"lambda w: NOT list_contains({quoted(drop)}, w))"
    )


def joined(x: str) -> str:
    return f"coalesce(array_to_string(list_sort({x}), ' '), '')"


def f1(pred: str, gold: str) -> str:
    hits = f"CAST(len(list_intersect({pred}, {gold})) AS DOUBLE)"
    return f"""CASE WHEN len({pred}) = 0 AND len({gold}) = 0 THEN 1.0::DOUBLE
      WHEN len({pred}) = 0 OR len({gold}) = 0 OR {hits} = 0 THEN 0.0::DOUBLE
      ELSE 2 * ({hits} / len({pred})) * ({hits} / len({gold}))
        / (({hits} / len({pred})) + ({hits} / len({gold}))) END"""


SYNTAX = "CAST(contains(upper(text), 'SELECT') AS INT)::DOUBLE"
FORMAT = f"""CAST(starts_with(upper(pred_sql), 'SELECT') AND NOT contains(text, '```')
  AND NOT regexp_matches(lower({trim('text')}), '{fixed.PROSE_OPENING}') AS INT)::DOUBLE"""

# --- what each completion must lead to ---------------------------------------------------------------

# Rows each reference shape finds for nation n, as sorted lists: with "=" and with "<>".
ANSWERS = """answers AS (
  SELECT 0 AS shape, n.n_nationkey AS n,
    coalesce(list_sort(list(c_name) FILTER (c_nationkey = n_nationkey)), []) AS eq,
    coalesce(list_sort(list(c_name) FILTER (c_nationkey <> n_nationkey)), []) AS ne
  FROM nation n, customer c GROUP BY n_nationkey
  UNION ALL
  SELECT 1, n_nationkey,
    coalesce(list_sort(list(c_custkey || '|' || c_acctbal) FILTER (c_nationkey = n_nationkey)), []),
    coalesce(list_sort(list(c_custkey || '|' || c_acctbal) FILTER (c_nationkey <> n_nationkey)), [])
  FROM nation n, customer c GROUP BY n_nationkey
  UNION ALL
  SELECT 2, n,
    coalesce(list_sort(list(c_mktsegment || '|' || eq) FILTER (eq > 0)), []),
    coalesce(list_sort(list(c_mktsegment || '|' || ne) FILTER (ne > 0)), [])
  FROM (SELECT n_nationkey AS n, c_mktsegment, count(*) FILTER (c_nationkey = n_nationkey) AS eq,
          count(*) FILTER (c_nationkey <> n_nationkey) AS ne
        FROM nation, customer GROUP BY ALL) GROUP BY n
  UNION ALL
  SELECT 3, a.n_nationkey,
    coalesce(list_sort(list(b.n_name) FILTER (a.n_nationkey = b.n_nationkey)), []),
    coalesce(list_sort(list(b.n_name) FILTER (a.n_nationkey <> b.n_nationkey)), [])
  FROM nation a, nation b GROUP BY a.n_nationkey
)"""

EXPECTED = """expected AS (
  SELECT e.*, len(a.eq) AS gold_rows,
    CASE WHEN wrong THEN len(a.ne) WHEN failed THEN NULL ELSE len(a.eq) END AS n_rows,
    CASE WHEN failed THEN 'error' WHEN len(CASE WHEN wrong THEN a.ne ELSE a.eq END) = 0 THEN 'empty' ELSE 'ok' END AS status,
    CASE WHEN failed THEN false WHEN wrong THEN a.eq = a.ne WHEN reversed THEN len(a.eq) <= 1 ELSE true END AS matched
  FROM (
    SELECT *, gen IN (3, 5) AS failed,
      gen = 4 AND contains(text, ' <> ') AS wrong,
      gen = 4 AND ends_with(text, ' DESC') AS reversed
    FROM extracted
  ) e JOIN answers a ON a.shape = e.prompt_id % 4 AND a.n = e.prompt_id % 25
)"""

PHASE1 = f"CAST(matched AS INT)::DOUBLE + 0.2::DOUBLE * {SYNTAX}"


def scored(select: str, *more: str) -> str:
    return with_(C, EXTRACTED, ANSWERS, EXPECTED, *more, select=select)


_STOP = fixed.SQL_STOP_WORDS
_AGG = " OR ".join(f"contains(p, '{m}') OR contains(g, '{m}')" for m in fixed.AGGREGATE_MARKERS)
FAILED = f"""failed AS (
  SELECT *, CASE
      WHEN NOT contains(p, 'SELECT') THEN 'syntax_error'
      WHEN status = 'error' THEN 'execution_error'
      WHEN list_sort({identifiers('pred_sql', _STOP)}) <> list_sort({identifiers('gold_sql', _STOP)}) THEN 'wrong_table'
      WHEN {_AGG} THEN 'wrong_aggregation'
      WHEN contains(p, 'ORDER BY') <> contains(g, 'ORDER BY') THEN 'wrong_order'
      WHEN contains(p, 'WHERE') <> contains(g, 'WHERE') THEN 'wrong_filter'
      WHEN contains(p, 'JOIN') <> contains(g, 'JOIN') THEN 'wrong_join'
      WHEN n_rows = 0 AND gold_rows > 0 THEN 'empty_result'
      ELSE 'other' END AS category,
    CASE WHEN NOT contains(p, 'SELECT') THEN 'Syntax Error' WHEN status = 'error' THEN 'Execution Error'
      ELSE 'Wrong Result' END AS category3
  FROM (SELECT *, upper(pred_sql) AS p, upper(gold_sql) AS g FROM expected WHERE NOT matched)
)"""


def failed(select: str, *more: str) -> str:
    return scored(select, FAILED, *more)


def dimension(name: str, words: list[str]) -> str:
    return f"{name} AS (SELECT unnest({quoted(words)}) AS category, unnest(range({len(words)})) AS ord)"


def category_table(column: str, words: list[str]) -> tuple[str, str]:
    return (
        dimension("dim", words),
        f"""counted AS (SELECT d.category, d.ord, count(f.cid) AS n FROM dim d
            LEFT JOIN failed f ON f.{column} = d.category GROUP BY ALL)""",
    )


# What each reference SQL of the examples must return.
OUTCOMES = """judged AS (
  SELECT e.*, CASE
    WHEN idx % 41 = 7 THEN NULL
    WHEN idx % 4 = 0 THEN (SELECT count(*) FROM customer WHERE c_nationkey = idx % 30)
    WHEN idx % 4 = 1 THEN 1
    WHEN idx % 4 = 2 THEN (SELECT count(*) FROM supplier WHERE s_nationkey = idx % 30)
    ELSE (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = idx % 30) END AS n_rows
  FROM examples e
)"""

GOLD_JSON = """result_rows AS (
  SELECT 0 AS shape, c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos,
    '["' || c_custkey || '","' || lower(c_name) || '"]' AS cells FROM customer
  UNION ALL
  SELECT 1, k, 0, '["' || count(*) FILTER (o_custkey % 30 = k) || '"]' FROM orders, range(30) r(k) GROUP BY k
  UNION ALL
  SELECT 2, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1,
    '["' || s_suppkey || '","' || lower(s_name) || '"]' FROM supplier
  UNION ALL
  SELECT 3, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1,
    '["' || lower(o_orderpriority) || '","' || n || '"]'
  FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_custkey < 30 GROUP BY ALL)
), chunks AS (
  SELECT shape, n, CAST(pos // 500 AS BIGINT) AS chunk, '[' || string_agg(cells, ',' ORDER BY pos) || ']' AS body
  FROM result_rows GROUP BY ALL
), cached AS (
  SELECT DISTINCT gold_sql, n_rows, coalesce(chunk, 0) AS chunk, coalesce(body, '[]') AS gold_result
  FROM judged LEFT JOIN chunks ON shape = idx % 4 AND n = idx % 30 WHERE n_rows IS NOT NULL
)"""

REASON = "CASE WHEN n_rows IS NULL THEN 'error' WHEN n_rows = 0 THEN 'empty_result' END"


def cut(x: str) -> str:
    return f"CASE WHEN length({x}) > 3500 THEN left({x}, 3500) || chr(10) || '-- (schema truncated)' ELSE {x} END"


SCHEMA = f"""schemas AS (
  SELECT db_id, {cut('ddl')} AS schema_text FROM (
    SELECT db_id, string_agg({trim('ddl')}, chr(10) || chr(10) ORDER BY ord) AS ddl FROM statements GROUP BY db_id)
)"""
ST = fixture_sql("statements")
FS = fixture_sql("fewshot")

SYSTEM = "'" + fixed.SYSTEM_PROMPT.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
NL = "chr(10)"


def user(schema: str, demos: str = "''") -> str:
    return (
        f"'### Database Schema:' || {NL} || {schema} || {NL} || {NL} || {demos} || '### Question:' || {NL} "
        f"|| question || {NL} || {NL} || '### SQL:'"
    )


DEMOS = """pool AS (SELECT idx, db_id, question, gold_sql FROM fewshot WHERE split = 'train'),
targets AS (SELECT DISTINCT db_id FROM fewshot),
ranked AS (
  SELECT t.db_id, row_number() OVER (PARTITION BY t.db_id ORDER BY (p.db_id = t.db_id) DESC, p.idx) - 1 AS rk,
    p.idx AS demo_idx, p.db_id AS demo_db, p.question, p.gold_sql
  FROM targets t, pool p
)"""

OK = "coalesce(correct, false)"
EXACT = "avg(CAST({0} AS INT)::DOUBLE)".format(OK)

TIER = """
        CASE WHEN sql IS NULL OR left(sql, 1) <> chr(123) THEN 'unknown' ELSE (
          SELECT CASE WHEN s <= 1 THEN 'easy' WHEN s <= 3 THEN 'medium' WHEN s <= 6 THEN 'hard' ELSE 'extra' END FROM (SELECT
            json_array_length({0}, '$.where') + least(json_array_length({0}, '$.groupBy'), 1)
            + least(json_array_length({0}, '$.having'), 1) + least(json_array_length({0}, '$.orderBy'), 1)
            + CASE WHEN json_type({0}, '$.limit') <> 'NULL' THEN 1 ELSE 0 END
            + CASE WHEN json_type({0}, '$.intersect') <> 'NULL' THEN 3 ELSE 0 END
            + CASE WHEN json_type({0}, '$.union') <> 'NULL' THEN 3 ELSE 0 END
            + CASE WHEN json_type({0}, '$.except') <> 'NULL' THEN 3 ELSE 0 END
            + json_array_length({0}, '$.from.table_units') - 1 AS s)) END""".format("CASE WHEN left(sql, 1) = chr(123) THEN sql END")

# Columns of each construct in order, as comparable texts: numbers with a fraction are rounded to six places.
CONSTRUCT_COLUMNS = {
    "q_where": ["o_orderkey", "lower(o_orderstatus)", "round(o_totalprice, 6)"],
    "q_inner_join": ["lower(c_name)", "o_orderkey", "lower(n_name)"],
    "q_outer_join": ["c_custkey", "o_orderkey"],
    "q_group": ["lower(l_returnflag)", "lower(l_linestatus)", "n", "qty", "first_ship", "round(top_price, 6)", "round(avg_discount, 6)"],
    "q_having": ["o_custkey", "n"],
    "q_distinct": ["lower(c_mktsegment)", "nations"],
    "q_order_limit": ["o_orderkey", "round(o_totalprice, 6)"],
    "q_union": ["nation"],
    "q_intersect": ["partkey"],
    "q_except": ["custkey"],
    "q_in_subquery": ["c_custkey", "lower(c_name)"],
    "q_exists": ["s_suppkey", "lower(s_name)"],
    "q_scalar_subquery": ["p_partkey", "p_size"],
    "q_case": ["lower(band)", "n"],
}


def construct(name: str, sql: str) -> str:
    cells = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'none')" for c in CONSTRUCT_COLUMNS[name])
    place = "row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1" if name == "q_order_limit" else "NULL::BIGINT"
    return f"SELECT count(*) OVER () AS n_rows, {place} AS pos, {cells} AS row FROM ({sql}) q"


# A statement begins with CREATE TABLE and runs to the first line with a semicolon.
SCRIPT_PARTS = [
        """lines AS (SELECT db_id, doc_id * 1000000 + generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
             FROM (SELECT db_id, doc_id, string_split(script, chr(10)) AS l FROM scripts))""",
        f"""marked AS (SELECT *,
             max(CASE WHEN starts_with(upper({trim('line')}), 'CREATE TABLE') THEN line_no END)
               OVER (PARTITION BY db_id ORDER BY line_no) AS opened,
             max(CASE WHEN contains(line, ';') THEN line_no END)
               OVER (PARTITION BY db_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
             FROM lines)""",
        f"""texts AS (SELECT db_id, {trim("string_agg(line || CASE WHEN contains(line, ';') THEN chr(10) ELSE '' END, chr(10) ORDER BY line_no)")} AS ddl
             FROM marked WHERE opened > coalesce(ended, -1) GROUP BY db_id)""",
]

STREAMED = """
        SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, run, component, n, mean FROM (
          SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, user_id % 3 AS run, event_type AS component,
            count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "read_split": with_(EX, select="""
        SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, db_id, question, gold_sql, split
        FROM examples WHERE split = 'dev'"""),
    "read_split_others": with_(EX, select="""
        SELECT row_number() OVER (ORDER BY CAST(idx % 3 = 0 AS INT), idx) - 1 AS idx, CAST(idx % 3 = 0 AS INT) AS part,
          db_id, question, gold_sql FROM examples WHERE split = 'train'"""),
    "read_schema_text": with_(ST, SCHEMA, select="SELECT db_id, schema_text FROM schemas"),
    "parse_schema_file": with_(fixture_sql("scripts"), *SCRIPT_PARTS, select=f"SELECT db_id, {cut('ddl')} AS schema_text FROM texts"),
    "schema_text_or_script": with_(fixture_sql("scripts"), fixture_sql("columns_of"), f"""given AS ({FIXTURES["statements"].format(documents="documents")})""",
        """statements AS (
          SELECT db_id, ord, ddl FROM given WHERE ascii(right(db_id, 1)) % 3 = 0
          UNION ALL
          SELECT db_id, tbl_ord, 'CREATE TABLE ' || tbl || ' (' || string_agg(col || ' ' || type, ', ' ORDER BY ord) || ')'
          FROM columns_of WHERE ascii(right(db_id, 1)) % 3 = 1 GROUP BY db_id, tbl, tbl_ord)""",
        SCHEMA, *SCRIPT_PARTS, select=f"""
        SELECT db_id, schema_text FROM schemas UNION ALL
        SELECT db_id, {cut('ddl')} FROM texts WHERE db_id NOT IN (SELECT db_id FROM schemas)"""),
    "read_filtered_or_raw": with_(EX, select="""
        SELECT 'filtered' AS found, idx, db_id, question, gold_sql, split FROM examples
        UNION ALL
        SELECT 'raw', row_number() OVER (ORDER BY idx) - 1, db_id, question, gold_sql, split FROM examples
        WHERE split = 'train'"""),
    "read_predictions": with_(PR, select='SELECT idx AS "index", method AS db_id, difficulty, correct FROM predictions'),
    "write_filtered": with_(EX, OUTCOMES, GOLD_JSON, select="""
        SELECT idx, db_id, gold_sql, split, j.n_rows, chunk, gold_result FROM judged j JOIN cached USING (gold_sql)
        WHERE j.n_rows > 0"""),
    "write_eval": with_(PR, select=f"""
        SELECT split, method AS mode, count(*) AS total, count(*) FILTER ({OK}) AS correct, {EXACT} AS overall_ex
        FROM predictions GROUP BY ALL"""),
    "cache_gold_result": with_(EX, OUTCOMES, GOLD_JSON, select="SELECT gold_sql, n_rows, chunk, gold_result FROM cached"),
    "load_examples": with_(EX, ST, SCHEMA, select=f"""
        SELECT idx, db_id, db_id || '.sqlite' AS db_file, gold_sql, {user('schema_text')} AS user_text FROM (
          SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, db_id, question, gold_sql FROM examples WHERE split = 'train')
        JOIN schemas USING (db_id)"""),
    "evaluate_run": scored(f"""
        SELECT e.cid AS idx, 'gen' || gen AS mode, matched AS correct, {TIER} AS difficulty, status = 'error' AS failed,
          CAST(sum(CAST(matched AS INT)) OVER (PARTITION BY gen) AS BIGINT) AS right
        FROM expected e JOIN sql_structs s ON s.idx = e.cid""", fixture_sql("sql_structs")),
    # projections and filters
    "completion_text": """
        SELECT conv_id, coalesce(
          arg_max(text, turn) FILTER (role = 'assistant'),
          string_agg(text, ' ' ORDER BY turn)) AS completion_text
        FROM conversations GROUP BY conv_id""",
    "extract_sql": with_(C, EXTRACTED, select="SELECT cid, pred_sql FROM extracted"),
    "syntax_valid": with_(C, select=f"SELECT cid, {SYNTAX} AS syntax FROM completions"),
    "format_compliance": with_(C, EXTRACTED, select=f"SELECT cid, {FORMAT} AS format FROM extracted"),
    "identifier_set": with_(C, select=f"SELECT cid, {joined(identifiers('text'))} AS identifiers FROM completions"),
    "schema_f1": with_(C, EXTRACTED, select=f"""
        SELECT cid, round({f1('p', 'g')}, 9) AS schema_f1
        FROM (SELECT cid, {identifiers('pred_sql')} AS p, {identifiers('gold_sql')} AS g FROM extracted)"""),
    "normalise_value": """
        SELECT o_orderkey, lower(CAST(round(o_totalprice / 8, 6) AS VARCHAR)) AS price, lower(o_orderpriority) AS priority,
          CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END AS large,
          coalesce(lower(nullif(o_orderstatus, 'F')), 'none') AS status, CAST(o_orderkey AS VARCHAR) AS key_text
        FROM orders""",
    "prompt_messages": with_(EX, ST, SCHEMA, select=f"""
        SELECT idx, 2::BIGINT AS n, 'system' AS role0, {SYSTEM} AS system_text, 'user' AS role1,
          {user('schema_text')} AS user_text
        FROM examples JOIN schemas USING (db_id)"""),
    "sft_messages": with_(EX, select="SELECT idx, 'system user assistant' AS roles, gold_sql AS answer FROM examples"),
    "program_examples": with_(EX, ST, SCHEMA, select="""
        SELECT idx, question, schema_text AS db_schema, gold_sql AS sql_query, db_id,
          '/data/corpus/database/' || db_id || '/' || db_id || '.sqlite' AS db_path
        FROM examples JOIN schemas USING (db_id)"""),
    "split_path": with_(PR, select="""
        SELECT method, idx, split, '/data/corpus/' || CASE WHEN split = 'test' THEN 'test_database' ELSE 'database' END
          || '/' || method || '/' || method || '.sqlite' AS db_path FROM predictions"""),
    "keep_runnable": with_(EX, OUTCOMES, select="SELECT idx, db_id, n_rows FROM judged WHERE n_rows > 0"),
    "drop_reason": with_(EX, OUTCOMES, select=f"SELECT idx, {REASON} AS reason FROM judged WHERE {REASON} IS NOT NULL"),
    "failures_only": with_(PR, select="SELECT method, idx FROM predictions WHERE correct IS NOT true"),
    "difficulty": with_(fixture_sql("sql_structs"), select=f"SELECT idx, {TIER} AS difficulty FROM sql_structs"),
    "failure_class": failed("SELECT cid, category FROM failed"),
    "failure_class3": failed("SELECT cid, category3 AS category FROM failed"),
    # candidate execution
    "run_candidates": scored("SELECT DISTINCT pred_sql AS sql, status, n_rows FROM expected"),
    "guard_readonly": with_(fixture_sql("hostile"), select="""
        SELECT cid, CASE WHEN cid % 6 < 5 THEN 'error' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status,
          CASE WHEN cid % 6 = 5 THEN n END AS n_rows
        FROM (SELECT cid, (SELECT count(*) FROM nation WHERE n_regionkey = o_custkey % 6) AS n
              FROM hostile JOIN orders ON cid = o_orderkey)"""),
    "time_limit": with_(fixture_sql("mixed_speed"), select="""
        SELECT cid, CASE WHEN slow THEN 'timeout' WHEN cid % 6 < 5 THEN 'ok' ELSE 'empty' END AS status,
          CASE WHEN slow THEN 'Timeout' END AS error, CASE WHEN NOT slow THEN CAST(cid % 6 < 5 AS BIGINT) END AS n_rows
        FROM (SELECT cid, cid % 100 = 7 AS slow FROM mixed_speed)"""),
    "outcome_table": scored("SELECT cid, status, n_rows FROM expected"),
    # joins
    "attach_difficulty": with_(PR, fixture_sql("sql_structs"), select=f"""
        SELECT p.method, p.idx, {TIER} AS difficulty
        FROM predictions p JOIN sql_structs s ON s.idx = p.idx"""),
    "attach_schema": with_(EX, ST, SCHEMA, select="SELECT idx, db_id, schema_text FROM examples JOIN schemas USING (db_id)"),
    "attach_gold": with_(EX, OUTCOMES, GOLD_JSON, select="""
        SELECT idx, c.n_rows AS gold_rows, chunk, gold_result FROM examples LEFT JOIN cached c USING (gold_sql)"""),
    "fewshot_demos": with_(FS, DEMOS, select="SELECT db_id, rk, demo_idx, demo_db FROM ranked WHERE rk < 5"),
    "fewshot_prompt": with_(FS, ST, SCHEMA, DEMOS, f"""texts AS (
          SELECT db_id, string_agg('Question: ' || question || {NL} || 'SQL: ' || gold_sql || {NL} || {NL}, '' ORDER BY rk) AS demos
          FROM ranked WHERE rk < 3 GROUP BY db_id)""", select=f"""
        SELECT idx, {user("coalesce(schema_text, '')", f"'### Examples:' || {NL} || demos")} AS user_text
        FROM fewshot JOIN texts USING (db_id) LEFT JOIN schemas USING (db_id) WHERE split = 'dev'"""),
    "split_leak_db": with_(FS, select="""
        SELECT db_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM fewshot
        GROUP BY db_id HAVING count(DISTINCT split) > 1"""),
    "split_leak_question": with_(EX, f"""keyed AS (
          SELECT *, lower(trim(regexp_replace(question, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS q FROM examples)""", select="""
        SELECT idx, db_id FROM keyed WHERE split = 'dev' AND q IN (SELECT q FROM keyed WHERE split = 'train')"""),
    "discordant_methods": with_(PR, select=f"""
        SELECT a.idx, CASE WHEN a.ok THEN 'few_shot' ELSE 'tuned' END AS solved_by
        FROM (SELECT idx, {OK} AS ok FROM predictions WHERE method = 'few_shot') a
        JOIN (SELECT idx, {OK} AS ok FROM predictions WHERE method = 'tuned') b USING (idx) WHERE a.ok <> b.ok"""),
    # aggregations
    "result_match": with_(fixture_sql("gold_rows"), fixture_sql("pred_rows"), select="""
        SELECT o_orderkey AS ex, coalesce(g.rows, []) = coalesce(p.rows, []) AS matched FROM orders
        LEFT JOIN (SELECT ex, list_sort(list(a || '|' || b)) AS rows FROM gold_rows GROUP BY ex) g ON g.ex = o_orderkey
        LEFT JOIN (SELECT ex, list_sort(list(a || '|' || b)) AS rows FROM pred_rows GROUP BY ex) p ON p.ex = o_orderkey"""),
    "execution_accuracy": scored("SELECT cid, CAST(matched AS INT)::DOUBLE AS execution FROM expected"),
    "execution_accuracy_cached": scored("SELECT cid, CAST(matched AS INT)::DOUBLE AS execution FROM expected"),
    "execution_accuracy_large": with_(fixture_sql("large_results"), """sizes AS (
          SELECT k, (SELECT count(*) FROM lineitem WHERE l_suppkey % 5 <> k) AS items, (SELECT count(*) FROM orders WHERE o_custkey % 4 <> k) AS orders
          FROM range(3) t(k))""", select="""
        SELECT cid, CASE kind WHEN 0 THEN items ELSE orders END AS gold_rows,
          CAST((kind = 0 AND gen < 3) OR (kind = 1 AND gen IN (0, 3)) AS INT)::DOUBLE AS execution
        FROM large_results JOIN sizes ON k = cid % 3"""),
    "execution_success": scored("SELECT cid, CAST(status <> 'error' AS INT)::DOUBLE AS success FROM expected"),
    "reward_phase1": scored(f"SELECT cid, round({PHASE1}, 6) AS reward FROM expected"),
    "reward_phase2": scored(f"""
        SELECT cid, execution, success, syntax, round(f, 9) AS schema_f1, format,
          round(execution + 0.2::DOUBLE * success + 0.2::DOUBLE * syntax + 0.2::DOUBLE * f + 0.1::DOUBLE * format, 6) AS reward
        FROM (SELECT cid, CAST(matched AS INT)::DOUBLE AS execution, CAST(status <> 'error' AS INT)::DOUBLE AS success,
                {SYNTAX} AS syntax, {f1('p', 'g')} AS f, {FORMAT} AS format
              FROM (SELECT *, {identifiers('pred_sql')} AS p, {identifiers('gold_sql')} AS g FROM expected))"""),
    "reward_custom_component": with_(C, EXTRACTED, select=f"""
        SELECT cid, syntax, round(brevity, 9) AS brevity, round(0.2::DOUBLE * syntax + 0.2::DOUBLE * f + 2.0::DOUBLE * brevity, 6) AS reward FROM (
          SELECT cid, {SYNTAX} AS syntax, {f1('p', 'g')} AS f, 1.0::DOUBLE / (1.0::DOUBLE + length(text)) AS brevity
          FROM (SELECT *, {identifiers('pred_sql')} AS p, {identifiers('gold_sql')} AS g FROM extracted))"""),
    "score_messages": with_(fixture_sql("chats"), select="""
        SELECT conv_id AS cid, length(coalesce(arg_max(text, turn) FILTER (role = 'assistant'), string_agg(text, ' ' ORDER BY turn))) AS chars,
          CAST(conv_id % 3 = 1 AS INT)::DOUBLE AS execution, CAST(conv_id % 3 > 0 AS INT)::DOUBLE AS success
        FROM chats GROUP BY conv_id"""),
    "reward_weighted_long": with_(LOG, select="""
        SELECT user_id, round(sum(value * CASE component WHEN 'execution' THEN 1.0::DOUBLE WHEN 'format' THEN 0.1::DOUBLE
          ELSE 0.2::DOUBLE END), 4) AS reward, 0::BIGINT AS unweighted FROM reward_log GROUP BY user_id"""),
    "filter_report": with_(EX, OUTCOMES, select="""
        SELECT count(*) AS original, count(*) FILTER (n_rows > 0) AS kept, count(*) FILTER (coalesce(n_rows, 0) = 0) AS removed,
          count(*) FILTER (n_rows = 0) AS empty_result, 0::BIGINT AS timeout, count(*) FILTER (n_rows IS NULL) AS error
        FROM judged"""),
    "ex_overall": with_(PR, select=f"""
        SELECT method, count(*) AS total, count(*) FILTER ({OK}) AS correct, {EXACT} AS ex FROM predictions GROUP BY ALL"""),
    "ex_by_difficulty": with_(PR, select=f"""
        SELECT method, difficulty, count(*) AS total, count(*) FILTER ({OK}) AS correct, {EXACT} AS ex
        FROM predictions GROUP BY ALL"""),
    "eval_summary": with_(PR, select="""
        SELECT method, count(*) AS total, count(*) FILTER ({0}) AS correct, {1} AS overall_ex, {2}
        FROM predictions GROUP BY method""".format(
            OK, EXACT, ", ".join(f"{EXACT} FILTER (difficulty = '{t}') AS {t}" for t in fixed.TIERS))),
    "failure_counts": failed(
        "SELECT category, n, round(100 * n / (SELECT sum(n) FROM counted)::DOUBLE, 6) AS pct FROM counted",
        *category_table("category", fixed.FAILURE_CATEGORIES)),
    "failure_share3": failed(
        "SELECT category, n, round(100 * n / (SELECT sum(n) FROM counted)::DOUBLE, 6) AS pct FROM counted",
        *category_table("category3", fixed.COARSE_CATEGORIES)),
    "method_by_difficulty": with_(PR, select="SELECT difficulty, {0} FROM predictions GROUP BY difficulty".format(
        ", ".join(f"100 * {EXACT} FILTER (method = '{m}') AS {m}" for m in ("zero_shot", "few_shot", "tuned")))),
    "method_delta": with_(PR, f"""tiers AS (
          SELECT method, difficulty, {EXACT} * 100 AS ex FROM predictions GROUP BY ALL
          UNION ALL SELECT method, 'overall', {EXACT} * 100 FROM predictions GROUP BY ALL)""", select="""
        SELECT m.method, difficulty, round(m.ex, 9) AS ex, round(m.ex - b.ex, 9) AS delta
        FROM tiers m JOIN (SELECT difficulty, ex FROM tiers WHERE method = 'zero_shot') b USING (difficulty)
        WHERE m.method <> 'zero_shot'"""),
    "devset_accuracy": with_(PR, select=f"SELECT method, count(*) AS evaluated, {EXACT} AS accuracy FROM predictions GROUP BY ALL"),
    "exact_vs_execution": scored("""
        SELECT gen, count(*) AS total, avg(CAST(lower(pred_sql) = lower(gold_sql) AS INT)::DOUBLE) AS exact_match,
          avg(CAST(matched AS INT)::DOUBLE) AS execution_accuracy FROM expected GROUP BY gen"""),
    "accuracy_ci": with_(PR, select="""
        SELECT *, round(1.96::DOUBLE * sqrt(ex * (1 - ex) / total), 9) AS half_width FROM (
          SELECT method, difficulty, count(*) AS total, count(*) FILTER ({0}) AS correct, {1} AS ex
          FROM predictions GROUP BY ALL)""".format(OK, EXACT)),
    "condition_table": with_(PR, select=f"""
        SELECT method, {EXACT} FILTER (split = 'dev') AS dev, {EXACT} FILTER (split = 'test') AS test
        FROM predictions GROUP BY method"""),
    "category_by_method": failed("""
        SELECT c.method, c.category, c.n, coalesce(b.n, 0) - c.n AS reduction
        FROM counted c LEFT JOIN counted b ON b.category = c.category AND b.method = 'gen4'""",
        dimension("dim", fixed.FAILURE_CATEGORIES), """counted AS (
          SELECT m.method, d.category, count(f.cid) AS n FROM (SELECT DISTINCT 'gen' || gen AS method FROM failed) m
          CROSS JOIN dim d LEFT JOIN failed f ON 'gen' || f.gen = m.method AND f.category = d.category GROUP BY ALL)"""),
    "metric_by_setting": with_(PR, f"""curve AS (
          SELECT method, split, step, {EXACT} AS ex FROM predictions GROUP BY ALL)""", """ranked AS (
          SELECT *, row_number() OVER (PARTITION BY method, split ORDER BY ex DESC, step) AS by_ex,
            row_number() OVER (PARTITION BY method, split ORDER BY step DESC) AS by_step FROM curve)""", select="""
        SELECT method, split, count(*) AS points, max(ex) FILTER (by_step = 1) AS final_ex, max(ex) AS best_ex,
          max(step) FILTER (by_ex = 1) AS best_step FROM ranked GROUP BY ALL"""),
    "threshold_gate": with_(PR, select=f"""
        SELECT method, difficulty, step, count(*) AS total, count(*) FILTER ({OK}) AS correct, {EXACT} AS ex
        FROM predictions GROUP BY ALL HAVING {EXACT} >= 0.7::DOUBLE"""),
    # windows and samples
    "running_ex": with_(PR, select=f"""
        SELECT method, batch, processed, solved, solved / processed::DOUBLE AS ex FROM (
          SELECT method, CAST(idx // 8 AS BIGINT) AS batch,
            CAST(count(*) OVER w AS BIGINT) AS processed, CAST(sum(CAST({OK} AS INT)) OVER w AS BIGINT) AS solved,
            row_number() OVER (PARTITION BY method, idx // 8 ORDER BY idx DESC) AS last
          FROM predictions WINDOW w AS (PARTITION BY method ORDER BY idx)) WHERE last = 1"""),
    "top_failures": failed("""
        SELECT category, n, rk, cid, 'Prompt ' || prompt_id AS question, left(gold_sql, 80) AS gold_sql, left(pred_sql, 80) AS pred_sql FROM (
          SELECT f.*, t.n, row_number() OVER (PARTITION BY category ORDER BY cid) AS rk
          FROM failed f JOIN (SELECT * FROM counted WHERE n > 0 ORDER BY n DESC, ord LIMIT 3) t USING (category))
        WHERE rk <= 2""", *category_table("category", fixed.FAILURE_CATEGORIES)),
    "group_advantage": scored(f"""
        SELECT cid, prompt_id, round(CASE WHEN max(r) OVER w = min(r) OVER w THEN 0.0::DOUBLE
          ELSE (r - avg(r) OVER w) / stddev_samp(r) OVER w END, 6) AS advantage
        FROM (SELECT *, {PHASE1} AS r FROM expected) WINDOW w AS (PARTITION BY prompt_id)"""),
    "no_signal_groups": scored(f"""
        SELECT gen, count(*) AS n, round(min(r), 6) AS reward
        FROM (SELECT *, {PHASE1} AS r FROM expected) GROUP BY 1 HAVING min(r) = max(r)"""),
    "stratified_sample": with_(PR, select="""
        SELECT method, difficulty, idx, rk FROM (
          SELECT *, row_number() OVER (PARTITION BY method, difficulty ORDER BY md5(CAST(idx AS VARCHAR)), idx) AS rk
          FROM predictions WHERE correct IS NOT true) WHERE rk <= 50"""),
    "mixed_batches": with_(PR, select="""
        SELECT method, idx, difficulty,
          CAST((row_number() OVER (PARTITION BY method, difficulty ORDER BY md5(CAST(idx AS VARCHAR)), idx) - 1)
          % greatest(CAST(ceil(count(*) OVER (PARTITION BY method) / 32.0) AS BIGINT), 1) AS BIGINT) AS batch
        FROM predictions"""),
    "converged": with_(PR, f"""points AS (SELECT method, step, {EXACT} AS ex FROM predictions GROUP BY ALL)""", select="""
        SELECT method, step, ex, coalesce(ex - lag(ex, 1) OVER w < 0.01::DOUBLE
          AND lag(ex, 1) OVER w - lag(ex, 2) OVER w < 0.01::DOUBLE, false) AS converged
        FROM points WINDOW w AS (PARTITION BY method ORDER BY step)"""),
    "reward_by_step": with_(LOG, """means AS (
          SELECT run, CAST(step // 10 AS BIGINT) AS logged, component, count(*) AS n, avg(value) AS m
          FROM reward_log GROUP BY ALL)""", select="""
        SELECT run, logged, component, n, round(m, 6) AS mean, round(m / sum(m) OVER (PARTITION BY run, logged), 6) AS share
        FROM means"""),
    "reward_saturation": with_(LOG, """means AS (
          SELECT run, CAST(step // 10 AS BIGINT) AS logged, avg(value) FILTER (component = 'syntax') AS w,
            avg(value) FILTER (component = 'execution') AS g
          FROM reward_log WHERE component IN ('syntax', 'execution') GROUP BY ALL)""", select="""
        SELECT run, logged, coalesce(w >= 50 AND g <= p, false) AS flagged, round(w, 6) AS watched_mean,
          round(g, 6) AS goal_mean, round(p, 6) AS previous_goal
        FROM (SELECT *, lag(g IGNORE NULLS) OVER (PARTITION BY run ORDER BY logged) AS p FROM means)"""),
    # sorts, limits, set operations
    "head_rows": with_(EX, select="SELECT idx, db_id, gold_sql FROM examples ORDER BY idx LIMIT 10"),
    "positional_split": with_(EX, select="""
        SELECT idx, CASE WHEN idx < (SELECT floor(0.8::DOUBLE * count(*)) FROM examples) THEN 'train' ELSE 'dev' END AS part
        FROM examples"""),
    "ordered_categories": failed("SELECT category, n FROM counted", *category_table("category", fixed.FAILURE_CATEGORIES)),
    "append_rows": with_(EX, select="SELECT idx, db_id, split FROM examples"),
    "identifier_diff": with_(C, EXTRACTED, select=f"""
        SELECT cid, {joined('list_filter(g, lambda w: NOT list_contains(p, w))')} AS missing,
          {joined('list_filter(p, lambda w: NOT list_contains(g, w))')} AS extra
        FROM (SELECT cid, {identifiers('pred_sql', _STOP)} AS p, {identifiers('gold_sql', _STOP)} AS g FROM extracted)"""),
    "identifier_overlap": with_(C, EXTRACTED, select=f"""
        SELECT cid, {joined('list_intersect(p, g)')} AS shared
        FROM (SELECT cid, {identifiers('pred_sql')} AS p, {identifiers('gold_sql')} AS g FROM extracted)"""),
    "rows_minus": with_(fixture_sql("gold_rows"), fixture_sql("pred_rows"), select="""
        SELECT *, 'gold' AS side FROM (SELECT * FROM gold_rows EXCEPT ALL SELECT * FROM pred_rows)
        UNION ALL
        SELECT *, 'pred' FROM (SELECT * FROM pred_rows EXCEPT ALL SELECT * FROM gold_rows)"""),
    # SQL constructs: the rows of the very candidate text, as the comparison sees them
    **{name: construct(name, sql) for name, sql in CONSTRUCTS.items()},
    "q_cross_runaway": "SELECT 'timeout' AS status, 'Timeout' AS error FROM lineitem GROUP BY 1, 2",
    # stream: every window of the log, open ones included
    "reward_by_step_stream": STREAMED,
    "reward_stream_resumed": STREAMED,
    "score_stream": with_(C, EXTRACTED, select=f"""
        SELECT cid, pred_sql, {SYNTAX} AS syntax, {FORMAT} AS format, round({f1('p', 'g')}, 9) AS schema_f1
        FROM (SELECT *, {identifiers('pred_sql')} AS p, {identifiers('gold_sql')} AS g FROM extracted)"""),
}
