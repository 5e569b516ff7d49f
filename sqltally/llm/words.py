"""Text pieces that several operators share. A word is a run of characters other than the six ASCII blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.session import ship_package

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of words; empty for a null or blank text."""
    bare = F.btrim(body(text), F.lit(BLANKS))
    return F.when(bare != "", F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    bare = F.btrim(body(text), F.lit(BLANKS))
    return F.when(bare != "", F.size(F.split(bare, BLANK_RUN))).otherwise(0).cast("bigint")


def learns(doc_id: Column) -> Column:
    """Rows that learners may read: crc32 of the id's decimal text is not 2 modulo 4. A null id never learns."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
