"""Scoring expressions over completion and SQL text.

Every function takes and returns a ``Column``, so the expressions run inside whole-stage code
generation, push through projections and work unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

# One explicit class of blanks: "\s" differs between regex dialects.
BLANKS = " \t\n\r\f\x0b"

SQL_FENCE = r"(?is)```sql[ \t\n\r\f\x0B]*(.*?)```"
ANY_FENCE = r"(?s)```[ \t\n\r\f\x0B]*(.*?)```"
ORDER_BY = r"(?i)\bORDER\s+BY\b"
# String literals, quoted names and comments carry no bare identifiers.
QUOTED_OR_COMMENT = r"'[^']*'|\"[^\"]*\"|--[^\n]*|(?s:/\*.*?\*/)"
# Words a query begins with, behind blanks and parentheses; a comment or a variable may hide one. For Java and Python.
QUERY_START = (
    r"(?iu)^[ \t\n\r\f\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff(]*"
    r"(?:(?:select|with|values|table|from|map|reduce)(?![0-9A-Za-z_])|--|/\*|\$\{)"
)
# The boundary keeps the exponent of a number such as 1e5 from counting as a name.
IDENTIFIER = r"\b[a-z_][a-z0-9_]*"

KEYWORDS = [w for w in fixed.SQL_STOP_WORDS if w not in fixed.AGGREGATE_NAMES]

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression used in several branches of a CASE is otherwise evaluated again in each of them,
    and again in what is built on top.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove blanks at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def completion_text(messages: Column) -> Column:
    """Text of a completion held as an array of ``{role, content}`` messages.

    The last assistant message; without one, all contents joined by a space.
    """
    assistant = F.filter(messages, lambda m: m["role"] == "assistant")
    everything = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    last = F.try_element_at(assistant, F.lit(-1))
    return F.when(F.size(assistant) > 0, F.coalesce(last["content"], F.lit(""))).otherwise(
        F.coalesce(everything, F.lit(""))
    )


def extract_sql(text: Column) -> Column:
    """SQL inside a completion: the first closed fence if any, up to the first semicolon."""
    whole = strip(F.coalesce(text, F.lit("")))

    def inside(pattern: str) -> Column:
        return F.when(F.regexp_like(whole, F.lit(pattern)), F.regexp_extract(whole, pattern, 1)).otherwise(whole)

    body = (
        F.when(~F.contains(whole, F.lit("```")), whole)
        .when(F.contains(F.lower(whole), F.lit("```sql")), inside(SQL_FENCE))
        .otherwise(inside(ANY_FENCE))
    )
    return strip(F.substring_index(body, ";", 1))


def has_select(sql: Column) -> Column:
    """True when the text is not blank and mentions SELECT anywhere."""
    return F.contains(F.upper(F.coalesce(sql, F.lit(""))), F.lit("SELECT"))


def begins_as_query(sql: Column) -> Column:
    """Whether a text begins as a query does; prose rarely does, and what does not is none."""
    return F.regexp_like(F.coalesce(sql, F.lit("")), F.lit(QUERY_START))


def syntax_valid(text: Column) -> Column:
    return has_select(text).cast("double")


def format_compliance(text: Column, sql: Column | None = None) -> Column:
    """1.0 for a completion that is bare SQL: starts with SELECT, no fence, no prose opening."""
    text = F.coalesce(text, F.lit(""))
    sql = extract_sql(text) if sql is None else sql
    bare = (
        F.startswith(F.upper(sql), F.lit("SELECT"))
        & ~F.contains(text, F.lit("```"))
        & ~F.regexp_like(F.lower(strip(text)), F.lit(fixed.PROSE_OPENING))
    )
    return bare.cast("double")


def identifier_set(sql: Column) -> Column:
    """Distinct lowercase identifiers of a SQL text, keywords left out, function names kept."""
    bare = F.lower(F.regexp_replace(F.coalesce(sql, F.lit("")), QUOTED_OR_COMMENT, " "))
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0)))
    # A set lookup per word; an array of keywords would be hashed again for every row.
    return F.filter(found, lambda word: ~word.isin(KEYWORDS))


def schema_names(identifiers: Column) -> Column:
    """Identifiers without aggregate function names: tables, columns and aliases."""
    return F.filter(identifiers, lambda word: ~word.isin(fixed.AGGREGATE_NAMES))


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of two identifier sets; two empty sets agree fully."""

    def f1(c: Column) -> Column:
        precision, recall = c["hits"] / c["pred"], c["hits"] / c["gold"]
        return (
            F.when((c["pred"] == 0) & (c["gold"] == 0), 1.0)
            .when((c["pred"] == 0) | (c["gold"] == 0) | (c["hits"] == 0), 0.0)
            .otherwise(2 * precision * recall / (precision + recall))
        )

    def sizes(s: Column) -> Column:
        hits = F.size(F.array_intersect(s["pred"], s["gold"])).cast("double")
        return F.struct(hits.alias("hits"), F.size(s["pred"]).alias("pred"), F.size(s["gold"]).alias("gold"))

    sets = F.struct(pred.alias("pred"), gold.alias("gold"))
    return let(sets, lambda s: let(sizes(s), f1))


def schema_f1(pred_sql: Column, gold_sql: Column) -> Column:
    return set_f1(identifier_set(pred_sql), identifier_set(gold_sql))


def is_ordered(gold_sql: Column) -> Column:
    """Row order counts when the reference SQL says ORDER BY anywhere, subqueries included."""
    return F.regexp_like(gold_sql, F.lit(ORDER_BY))


def normalise_sql(name: str, data_type: T.DataType) -> str:
    """SQL expression for the text under which the values of column ``name`` are compared.

    Fractions are rounded to six places; decimals count as fractions and booleans as 0/1,
    the only two forms the scored dialect has for them. A decimal with more digits than a double
    holds keeps all of them.
    """
    fraction = f"lower(cast(round(cast({name} as double), 6) as string))"
    if isinstance(data_type, T.DecimalType):
        back = f"try_cast(cast({name} as double) as {data_type.simpleString()})"
        text = f"CASE WHEN {back} <=> {name} THEN {fraction} ELSE cast(round({name}, 6) as string) END"
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = fraction
    elif isinstance(data_type, T.BooleanType):
        text = f"cast(cast({name} as int) as string)"
    else:
        blanks = ", ".join(f"chr({ord(b)})" for b in BLANKS)
        text = f"btrim(lower(cast({name} as string)), concat({blanks}))"
    return f"coalesce({text}, 'none')"


def normalise_value(name: str, data_type: T.DataType) -> Column:
    return F.expr(normalise_sql(name, data_type))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_text(question: Column, schema_text: Column, demo_text: Column | None = None) -> Column:
    parts = [F.lit(fixed.SCHEMA_HEADING), F.coalesce(schema_text, F.lit("")), F.lit("\n\n")]
    if demo_text is not None:
        parts += [F.lit(fixed.EXAMPLES_HEADING), F.coalesce(demo_text, F.lit(""))]
    parts += [F.lit(fixed.QUESTION_HEADING), question, F.lit("\n\n" + fixed.SQL_HEADING)]
    return F.concat(*parts)


def prompt_messages(question: Column, schema_text: Column, demo_text: Column | None = None) -> Column:
    """System and user message of one example; with demonstrations for a few-shot prompt."""
    return F.array(
        message("system", F.lit(fixed.SYSTEM_PROMPT)),
        message("user", user_text(question, schema_text, demo_text)),
    )


def sft_messages(prompt: Column, gold_sql: Column) -> Column:
    return F.array_append(prompt, message("assistant", gold_sql))


def cut_schema(text: Column) -> Column:
    limit = fixed.MAX_SCHEMA_CHARS
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(fixed.TRUNCATION_MARK))
    ).otherwise(text)


def split_path(data_dir: str, split: Column, db_id: Column) -> Column:
    """Where a database lives: test databases sit in a folder of their own."""
    folder = F.when(split == "test", F.lit("test_database")).otherwise(F.lit("database"))
    return F.concat_ws("/", F.lit(data_dir.rstrip("/")), folder, db_id, F.concat(db_id, F.lit(".sqlite")))


def difficulty(sql_json: Column) -> Column:
    """Tier of a parsed-SQL struct held as raw JSON text, which is parsed once; what is no JSON object has no tier."""
    def count(parsed: Column, path: str) -> Column:
        return F.coalesce(F.array_size(F.try_variant_get(parsed, path, "array<variant>")), F.lit(0))

    def point(condition: Column, points: int = 1) -> Column:
        return F.when(condition, points).otherwise(0)

    def present(parsed: Column, path: str) -> Column:
        empty = ["", "{}", "[]", "0", "false"]
        found = F.try_variant_get(parsed, path, "string")
        return found.isNotNull() & ~found.isin(*empty)

    def score(parsed: Column) -> Column:
        return (
            count(parsed, "$.where")
            + point(count(parsed, "$.groupBy") > 0)
            + point(count(parsed, "$.having") > 0)
            + point(count(parsed, "$.orderBy") > 0)
            + point(F.try_variant_get(parsed, "$.limit", "string").isNotNull())
            + point(present(parsed, "$.intersect"), 3)
            + point(present(parsed, "$.union"), 3)
            + point(present(parsed, "$.except"), 3)
            + F.greatest(count(parsed, "$.from.table_units") - 1, F.lit(0))
        )

    def tier(points: Column) -> Column:
        named = F.when(points.isNull(), fixed.UNKNOWN_TIER)
        for name, limit in fixed.TIER_LIMITS.items():
            named = named.when(points <= limit, name)
        return named.otherwise(fixed.TOP_TIER)

    is_object = F.startswith(F.ltrim(sql_json, F.lit(BLANKS)), F.lit("{"))
    scored = let(F.try_parse_json(F.when(is_object, sql_json)), lambda p: F.when(p.isNotNull(), score(p)))
    return let(scored, tier)
