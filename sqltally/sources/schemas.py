"""Schema text of databases, as prompts show it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators.running import running

# Characters of a piece that can still show: one more than fit, so that the cut is seen.
MAX_PIECE = fixed.MAX_SCHEMA_CHARS + 1


def _shown(pieces: DataFrame, order: str, separator: str) -> DataFrame:
    """``db_id, schema_text``: the pieces ``(db_id, order, text)`` joined in order and cut.

    A running total of characters tells where each piece begins. Only pieces that begin before the cut are brought
    together, so a database of any size gathers a few thousand characters.
    """
    sized = pieces.withColumn("size", (F.length("text") + len(separator)).cast("bigint"))
    placed = running(sized, ["db_id"], order, {"upto": "size"})
    begun = placed.where(F.col("upto") - F.col("size") <= MAX_PIECE)
    listed = F.sort_array(F.collect_list(F.struct(F.col(order), F.left("text", F.lit(MAX_PIECE)).alias("text"))))
    return begun.groupBy("db_id").agg(
        X.cut_schema(F.array_join(F.transform(listed, lambda p: p["text"]), separator)).alias("schema_text")
    )


def schema_text(statements: DataFrame) -> DataFrame:
    """``db_id, schema_text`` from ``statements(db_id, ord, ddl)``.

    Statements are stripped, joined by a blank line in ``ord`` order (whole numbers, unique per database) and cut.
    """
    usable = statements.where(F.col("ddl") != "").select("db_id", "ord", X.strip(F.col("ddl")).alias("text"))
    return _shown(usable, "ord", "\n\n")


def statements_of_tables(spark: SparkSession, databases: Mapping[str, Mapping[str, str | DataFrame]]) -> DataFrame:
    """CREATE TABLE statements written from the schemas of the databases' tables."""
    rows = []
    for db_id, tables in databases.items():
        for ord_, (name, table) in enumerate(tables.items()):
            frame = spark.read.parquet(table) if isinstance(table, str) else table
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
            rows.append((db_id, ord_, f"CREATE TABLE {name} ({columns})"))
    return spark.createDataFrame(rows, "db_id string, ord bigint, ddl string")


def statements_of_columns(columns: DataFrame) -> DataFrame:
    """CREATE TABLE statements from a metadata table ``(db_id, tbl, tbl_ord, ord, col, type)``."""
    listed = F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(" ", "col", "type").alias("text"))))
    body = F.array_join(F.transform(listed, lambda c: c["text"]), ", ")
    return (
        columns.groupBy("db_id", "tbl", F.col("tbl_ord").alias("table_ord"))
        .agg(F.concat(F.lit("CREATE TABLE "), F.first("tbl"), F.lit(" ("), body, F.lit(")")).alias("ddl"))
        .select("db_id", F.col("table_ord").alias("ord"), "ddl")
    )


def read_script_lines(spark: SparkSession, path: str) -> DataFrame:
    """``db_id, line_no, line`` of the ``schema.sql`` script in each database folder."""
    scripts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return scripts.select(
        folder.alias("db_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))


def statement_lines(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Lines of ``lines(db_id, line_no, line)`` inside a CREATE TABLE statement.

    A statement runs from a line that opens with CREATE TABLE to the first line with a semicolon:
    a line is inside when the last opening at or before it comes after the last semicolon line
    strictly before it.
    """
    opens = F.startswith(F.upper(X.strip(F.col("line"))), F.lit("CREATE TABLE"))
    ends = F.contains("line", F.lit(";"))
    marked = lines.select(
        "db_id",
        "line_no",
        "line",
        F.when(opens, F.col("line_no")).alias("opened"),
        F.when(ends, F.col("line_no")).alias("ended"),
        # "Before this line" for the semicolon: the half step keeps a line's own out of its range.
        (2 * F.col("line_no") + 1).alias("at"),
    )
    events = marked.select("db_id", "at", "line_no", "line", "opened", F.lit(None).cast("bigint").alias("ended")).union(
        marked.where(F.col("ended").isNotNull()).select(
            "db_id",
            (F.col("at") + 1).alias("at"),
            F.lit(None).cast("bigint"),
            F.lit(None).cast("string"),
            F.lit(None).cast("bigint"),
            "ended",
        )
    )
    state = running(events, ["db_id"], "at", {"last_open": "opened", "last_end": "ended"}, "max", 2 * block)
    inside = F.col("last_open") > F.coalesce("last_end", F.lit(-1))
    return state.where(F.col("line_no").isNotNull() & inside).select("db_id", "line_no", "line")


def parse_schema_script(lines: DataFrame) -> DataFrame:
    """``db_id, schema_text`` from script lines; a blank line follows each statement.

    Blanks at both ends go before the cut: those before the first opening, those after the last line that is not blank.
    """
    inside = statement_lines(lines)
    ends = inside.groupBy(F.col("db_id").alias("_db")).agg(
        F.min("line_no").alias("_first"), F.max(F.when(~X.is_blank(F.col("line")), F.col("line_no"))).alias("_last")
    )
    place, blanks = F.col("line_no"), F.lit(X.BLANKS)
    line = F.when(place == F.col("_first"), F.ltrim("line", blanks)).otherwise(F.col("line"))
    gap = F.when(F.contains("line", F.lit(";")), F.lit("\n")).otherwise(F.lit(""))
    text = F.when(place == F.col("_last"), F.rtrim(line, blanks)).otherwise(F.concat(line, gap))
    trimmed = inside.join(ends, inside["db_id"].eqNullSafe(ends["_db"])).where(place <= F.col("_last"))
    return _shown(trimmed.select("db_id", "line_no", text.alias("text")), "line_no", "\n")


def schema_text_or_script(statements: DataFrame, lines: DataFrame) -> DataFrame:
    """Schema text from statements; databases without any fall back to their script."""
    listed = schema_text(statements)
    scripted = parse_schema_script(lines).join(listed.select("db_id"), "db_id", "left_anti")
    return listed.unionByName(scripted)
